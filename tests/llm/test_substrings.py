import hashlib
import random
import time

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, documents
from veldspar.llm import substrings as ss


def slow(rows, length=50):
    least = {}
    big = 1 << 63
    texts = [((d if d is not None else big), (t or "").encode()) for d, t in rows]
    for d, t in texts:
        for i in range(len(t) - length + 1):
            s = t[i : i + length]
            least[s] = min(least.get(s, big), d)
    out = []
    for (d, t), (doc, _) in zip(texts, rows):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if least[t[i : i + length]] < d:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(rng):
    passages = ["".join(rng.choice("abcdé \n") for _ in range(rng.randint(30, 140))) for _ in range(12)]
    rows = []
    for i in range(160):
        parts = []
        for _ in range(rng.randint(0, 6)):
            p = rng.choice(passages)
            cut = rng.randint(0, 40)
            parts.append(rng.choice([p, p[cut:], p[: len(p) - cut], "".join(rng.choice("xyz ") for _ in range(60)), "ab" * rng.randint(1, 60)]))
        rows.append((rng.randint(0, 120), "".join(parts)))
    return rows


def run(spark, rows, **how):
    out = ss.deduplicate(documents(spark, rows), **how)
    got = out.select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), "kept_sha256", "kept").collect()
    for r in got:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
    return sorted((tuple(r)[:5] for r in got), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    rows = corpus(rng) + [(None, rows_text) for rows_text in ["abc" * 40, "abc" * 40]]
    assert run(spark, rows, block=3000, shard=4000, bucket=20_000, memory=1000) == slow(rows)


def test_production_sizes_give_the_same(spark):
    rows = corpus(random.Random(2))
    got = sorted(map(tuple, ss.digests(documents(spark, rows)).collect()), key=str)
    assert got == slow(rows)


def test_odd_rows_and_empty_table(spark):
    rows = [r[:2] for r in ODD if r[0] != 8] + [(20, "\x00" * 120), (21, "\x00" * 70 + "q"), (22, "x" * 55)]
    assert run(spark, rows) == slow(rows)
    assert ss.digests(documents(spark, [])).count() == 0
    df = documents(spark, [(1, "a" * 60), (2, "a" * 55)]).withColumns({"block": F.lit(1), "shard": F.lit(2), "kept": F.lit(3)})
    assert sorted(r.n_removed for r in ss.digests(df).collect()) == [0, 55]


def test_anchors_depend_on_the_string_alone():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 100, 5000).astype(np.uint8)
    ends = np.array([2000, 2030, 5000])
    anchor, doc, first, count = ss.records(text, ends, *ss.runs(text, ends))
    assert set(doc.tolist()) == {0, 2}
    starts = np.concatenate([np.arange(f, f + c) for f, c in zip(first, count)])
    want = [i for i in range(4951) if i + 50 <= 2000 or i >= 2030]
    assert starts.tolist() == want
    assert (np.repeat(anchor, count) == ss._anchors_at(text, starts, 50)).all()


def test_stretches_that_share_less_than_a_wide_anchor_do_not_meet():
    """What two documents share by chance, a few words, brings none of their records together."""
    rng = np.random.default_rng(3)
    texts, ends = rng.integers(97, 123, (2, 300, 90)).astype(np.uint8), np.cumsum(np.full(300, 90))
    texts[1, :, 30:54] = texts[0, :, 40:64]
    here, there = (ss.records(t.ravel(), ends, *ss.runs(t.ravel(), ends))[0] for t in texts)
    assert not len(np.intersect1d(here, there))
    texts[1, :, 20:70] = texts[0, :, 31:81]
    there, doc, first, count = ss.records(texts[1].ravel(), ends, *ss.runs(texts[1].ravel(), ends))
    holds = (first <= doc * 90 + 20) & (doc * 90 + 20 < first + count)
    assert holds.sum() == 300 and np.isin(there[holds], here).all()


def test_a_block_deals_its_anchors_to_thousands_of_shards_in_one_pass():
    """Shards grow with the corpus; a pass over the anchors for each would make the time grow with its square."""
    rng = np.random.default_rng(5)
    text, pack = rng.integers(97, 123, 2_000_000).astype(np.uint8), ss.zstandard.ZstdCompressor().compress
    runs = ss.runs(text, np.array([len(text)]))
    row = {"block": 1, "doc_ids": [7], "sizes": [len(text)], "blob": pack(text.tobytes()), "counts": pack(runs[0].tobytes()), "offsets": pack(runs[1].tobytes())}
    block = ss.Block(row)

    def seconds(shards):
        of = (block.anchors % np.uint64(shards)).astype(np.int64)
        bits = {n: b"\xff" * (c // 8 + 1) for n, c in enumerate(np.bincount(of).tolist()) if n % 2}
        took = []
        for _ in range(3):
            began = time.process_time()
            shared = block.shared(bits, shards)
            took.append(time.process_time() - began)
        assert (shared == (of % 2 == 1)[block.which]).all()
        return min(took)

    assert seconds(4000) < 6 * seconds(40) + 0.03


def test_block_ids_fall_into_their_bucket(spark):
    for buckets in (1, 7):
        for task in (0, 5, 300):
            numbers = ss._block_ids(task, buckets)
            ids = [next(numbers) for _ in range(4)]
            df = spark.createDataFrame([(i,) for i in ids], "b long")
            assert {r[0] for r in df.select(F.pmod(F.hash("b"), F.lit(buckets))).collect()} == {task % buckets}


def test_a_hot_anchor_far_larger_than_memory_spills_and_is_exact(monkeypatch):
    """One anchor in ten thousand different stretches: arrays and queues go to disk, the result is that of brute force."""
    rng = random.Random(6)
    core = b"the anchor that every stretch of this shard shares"
    made = {bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 30))) + core + bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 30))) for _ in range(10_000)}
    stretches = sorted(made)
    least = np.array([rng.randint(0, 500) for _ in stretches])
    spilled, close = [], ss.sx.Queue.close
    monkeypatch.setattr(ss.sx.Queue, "close", lambda q: (spilled.append(q.spilled), close(q)))
    monkeypatch.setattr(ss, "_anchors_at", lambda text, begins, length: np.zeros(len(begins), np.uint64))
    monkeypatch.setattr(ss, "PART", 1000)
    monkeypatch.setattr(ss.sx, "IN_MEMORY", 1 << 30)
    offset, best = ss.smallest_holder(stretches, least, memory=1 << 14)
    assert sum(map(len, stretches)) > 40 * (1 << 14) and sum(spilled) > sum(map(len, stretches))
    low = {}
    for s, d in zip(stretches, least.tolist()):
        for i in range(len(s) - 49):
            low[s[i : i + 50]] = min(low.get(s[i : i + 50], 1 << 62), d)
    for n, s in enumerate(stretches):
        assert best[offset[n] : offset[n + 1]].tolist() == [low[s[i : i + 50]] for i in range(len(s) - 49)]
