import inspect
import random

import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, documents
from veldspar.functions.shared import texts_of
from veldspar.llm import rules, simhash

SPACE = " \t\n\r\x0b\x0c"


def slow(text):
    text = text or ""
    words, now = [], ""
    for c in text + " ":
        if c in SPACE:
            words += [now] if now else []
            now = ""
        else:
            now += c
    lines, dup, seen = text.split("\n"), 0, set()
    for line in lines:
        if line.strip(SPACE):
            dup += line in seen
            seen.add(line)
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    n = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))
    return (*n, n[0] < 20 or 100 * n[4] > 30 * n[0])


def test_counts_match_brute_force(spark):
    rng = random.Random(5)
    rows = list(ODD)
    for i in range(60):
        words = [rng.choice(["a", "b", "é#", "|", "\n", "c\n", "\x0b", " "]) for _ in range(rng.randrange(80))]
        rows.append((100 + i, " ".join(words)))
    got = sorted(map(tuple, rules.rate(documents(spark, rows)).drop("kept").collect()), key=str)
    assert got == sorted(((r[0], *slow(r[1])) for r in rows), key=str)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def corpus(rng):
    rows = [(i, prose(rng, 120), "en", f"s{i % 3}") for i in range(300)]
    rows += [(1000 + i, prose(rng, 100).replace(" ", "### "), "en", f"s{i % 3}") for i in range(9)]
    rows += [(2000 + i, prose(rng, 100).upper(), "en", "s1") for i in range(9)]
    rows += [(3000 + i, "same words " * 30, "en", "s2") for i in range(3)]
    return rows


def test_verdict_keeps_ordinary_documents_and_drops_outliers(spark):
    got = {r.doc_id: r.kept for r in rules.rate(documents(spark, corpus(random.Random(6)))).collect()}
    assert all(got[i] for i in range(300))
    assert not any(v for k, v in got.items() if k >= 1000)


def test_every_metric_rejects_beyond_the_base_rules(spark):
    rng = random.Random(9)
    lines = lambda n, same: "\n".join([prose(rng, 12) for _ in range(n)] + ["one line that is here again"] * same)
    some = prose(rng, 10)
    odd = {
        "symbol": prose(rng, 100).replace(" ", " # ", 30),
        "upper": prose(rng, 60) + prose(rng, 60).upper(),
        "mark": prose(rng, 100).replace(" ", "! ", 30),
        "dup_line": lines(12, 9),
        "repeat": f"{prose(rng, 25)} {some} {prose(rng, 25)} {some}",
        "word_length": prose(rng, 100).replace(" ", "", 40),
    }
    rows = [(i, prose(rng, 120), "en", "s") for i in range(300)] + [(1000 + i, lines(10, 2), "en", "s") for i in range(5)]
    rows += [(5000 + i, t, "en", "s") for i, t in enumerate(odd.values())]
    got = {r.doc_id: r for r in rules.rate(documents(spark, rows)).collect()}
    assert not any(got[5000 + i].base_failed for i in range(len(odd)))
    assert [k for i, k in enumerate(odd) if got[5000 + i].kept] == []
    assert all(r.kept for k, r in got.items() if k < 5000)


def test_thresholds_follow_the_group(spark):
    """A source whose ordinary documents carry symbols keeps them; elsewhere the same text is an outlier."""
    rng = random.Random(7)
    marked = lambda: prose(rng, 100).replace(" ", " |# ")
    rows = [(i, prose(rng, 100), "en", "plain") for i in range(200)] + [(1000 + i, marked(), "en", "tables") for i in range(200)]
    rows += [(5000, marked(), "en", "plain")]
    got = {r.doc_id: r.kept for r in rules.rate(documents(spark, rows)).collect()}
    assert got.pop(5000) is False and all(got.values())


def test_small_and_null_groups_take_the_wider_threshold(spark):
    rng = random.Random(8)
    rows = [(i, prose(rng, 80), "en", "s") for i in range(100)] + [(500, prose(rng, 80), None, None), (501, prose(rng, 80).upper(), None, None), (502, prose(rng, 80), "de", "t")]
    got = {r.doc_id: r.kept for r in rules.rate(documents(spark, rows)).collect()}
    assert got[500] and got[502] and not got[501]


def test_filter_keeps_columns_and_agrees_with_rate(spark):
    df = documents(spark, [*corpus(random.Random(6)), *ODD]).withColumns({"fences": F.lit("x"), "m": F.lit(1), "_v_m": F.lit(2), "kept": F.lit(None).cast("int")})
    out = rules.filter_documents(df)
    assert out.columns == df.columns
    kept = rules.rate(df).where("kept").select("doc_id").collect()
    assert sorted(str(r[0]) for r in out.select("doc_id").collect()) == sorted(str(r[0]) for r in kept)


def test_empty_table(spark):
    assert rules.rate(documents(spark, [])).count() == 0
    assert rules.filter_documents(documents(spark, [])).count() == 0


def test_thresholds_do_not_depend_on_partitions(spark):
    df = documents(spark, corpus(random.Random(6))).withColumn("m", rules._measured("text"))
    found = [sorted(map(tuple, rules.thresholds(df.repartition(n), "m").collect())) for n in (3, 8, 17)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 3


def test_quantiles_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, prose(rng, 60) + " #" * rng.randrange(0, 9), rng.choice(["en", "de"]), rng.choice(["a", None])) for i in range(400)]
    df = documents(spark, rows).withColumn("m", rules._measured("text"))
    own = rules.fences(rules.sketches(df, "m"), ["lang", "source"]).collect()
    assert sum(r.n for r in own) == 400
    for r in own:
        texts = [t for _, t, lang, source in rows if (lang, source) == (r.lang, r.source)]
        share = sorted(t.count("#") / len(t.replace(" ", "")) for t in texts)
        at = lambda x: int(share[-(-len(share) * x // 100) - 1] * 2048) / 2048
        want = at(50) + 4 * max(at(75) - at(25), min(at(90) - at(50), 0.015), 0.01)
        assert abs(r.f[0] - want) < 1e-9


def test_a_batch_is_not_python_objects_at_once():
    """Texts are read in the rules' and the fingerprints' functions a few hundred rows at a time."""
    import tracemalloc

    texts = pa.array([f"{i} " * 2000 for i in range(4000)] + [None, ""])
    assert list(texts_of(texts)) == texts.to_pylist() and list(texts_of(texts.slice(3990), 5)) == texts.slice(3990).to_pylist() and not list(texts_of(texts.slice(0, 0)))
    tracemalloc.start()
    assert sum(len(t or "") for t in texts_of(texts)) == sum(len(str(i)) + 1 for i in range(4000)) * 2000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < texts.nbytes / 3
    for module in (rules, simhash):
        assert "texts_of(" in inspect.getsource(module) and "to_pylist()" not in inspect.getsource(module)
