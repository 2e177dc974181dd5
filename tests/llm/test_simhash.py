import random

import xxhash

from tests.llm.helpers import ODD, documents
from veldspar.llm import simhash


def slow_fingerprint(text):
    out, words = "", []
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if c in " \t\n\r\x0b\x0c":
            words.append(out)
            out = ""
        else:
            out += c
    words = [w for w in [*words, out] if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def slow_classes(rows, radius=4):
    """Union of every pair within the radius; rows of (doc_id, fingerprint)."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    classes = {}
    for i, (doc, _) in enumerate(rows):
        classes.setdefault(find(i), []).append(doc)
    return [min([d for d in classes[find(i)] if d is not None], default=None) for i in range(len(rows))]


def compare(spark, rows):
    got = sorted(map(tuple, simhash.near_duplicates(documents(spark, rows)).collect()), key=str)
    prints = [(r[0], slow_fingerprint(r[1])) for r in rows]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(prints, slow_classes(prints))), key=str)
    assert got == want


def test_fingerprint_matches_the_definition():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 70, 300):
        text = " ".join(rng.choice(["Alpha", "beta", "É", "x\t", "😀", " y"]) for _ in range(n))
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_odd_rows(spark):
    compare(spark, ODD)


def test_empty_table_and_extra_columns(spark):
    from pyspark.sql import functions as F

    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    df = documents(spark, [(1, "a b c d e"), (2, "a b c d e")]).withColumns({"fp": F.lit(7), "node": F.lit("x"), "component_id": F.lit(0)})
    assert sorted(map(tuple, simhash.near_duplicates(df).select("doc_id", "component_id").collect())) == [(1, 1), (2, 1)]


def test_near_copies_chain_and_unrelated(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(500)]
    base = [rng.choice(words) for _ in range(150)]
    rows = []
    for i in range(60):
        base = list(base)
        base[rng.randrange(150)] = rng.choice(words)
        rows.append((i, " ".join(base)))
    rows += [(100 + i, " ".join(rng.choice(words) for _ in range(90))) for i in range(60)]
    compare(spark, rows)


def test_hot_buckets_are_cut_without_losing_links(spark, monkeypatch):
    """Random codes around few centres, chunks of 8: links equal brute force."""
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(6)]
    codes = set()
    for _ in range(500):
        code = rng.choice(centres)
        for _ in range(rng.randrange(5)):
            code ^= 1 << rng.randrange(64)
        codes.add(code)
    rows = [(i, c) for i, c in enumerate(codes)]
    df = spark.createDataFrame([(i, c - (1 << 64) if c >> 63 else c) for i, c in rows], "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.link(df).collect()}
    assert [got[i] for i, _ in rows] == slow_classes(rows)


def test_longer_keys_lose_no_link(spark):
    rng = random.Random(5)
    codes = []
    for _ in range(60):
        base = rng.getrandbits(64)
        codes += [base] + [base ^ sum(1 << b for b in rng.sample(range(64), rng.choice([2, 4, 5, 6]))) for _ in range(4)]
    rows = [(c - (1 << 64) if c >> 63 else c, i) for i, c in enumerate(codes)]
    df = spark.createDataFrame(rows, "fp long, node long")
    want = slow_classes([(i, c) for i, c in enumerate(codes)])
    for equal in (2, 3, 4, 6):
        root = list(range(len(codes)))
        edges = simhash.links(df, equal=equal).collect()
        for _ in range(len(codes)):
            for e in edges:
                root[e.a] = root[e.b] = min(root[e.a], root[e.b])
        assert root == want
    assert [simhash._equal(n, 4) for n in (0, 10**8, 10**9, 10**10)] == [2, 2, 3, 4]
