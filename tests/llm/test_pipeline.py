import random
from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm.helpers import ODD, documents
from tests.llm.test_mixing import words
from tests.llm.test_pii import slow
from tests.llm.test_rules import prose
from tests.llm.test_simhash import slow_classes, slow_fingerprint
from veldspar.llm import mixing, pieces, rules


def corpus():
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randint(40, 160)), "en", "big" if i < 200 else "small") for i in range(260)]
    for i in range(30):  # near copies: one word more
        rows.append((1000 + i, rows[i][1] + " extra", "en", "big"))
    rows += [(2000 + i, rows[3][1], "en", "small") for i in range(20)]
    rows += [(3000 + i, prose(rng, 60).upper() + "!! " * 40, "en", "big") for i in range(5)]
    rows += [(4000 + i, prose(rng, 60) + f" mail me at jo{i}@site.org or +49 30 1234{i}67 ok", "en", "small") for i in range(8)]
    return rows


def redacted(text):
    out, at = "", 0
    for a, b, kind in sorted((a, -b, k) for k, a, b in slow(text)):
        if -b <= at:
            continue
        if a >= at:
            out += text[at:a] + f"[{kind.upper()}]"
        at = -b
    return out + text[at:]


def test_run_against_brute_force(spark, tmp_path):
    rows = corpus() + [(r[0] and 9000 + r[0], *r[1:]) for r in ODD]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in rules.rate(documents(spark, rows)).where("kept").collect()}
    rows = [r for r in rows if r[0] in kept]
    classes = slow_classes([(r[0], slow_fingerprint(r[1])) for r in rows])
    rows = [r for r, c in zip(rows, classes) if r[0] == c]
    assert 255 < len(rows) < 320
    want = {r[0]: redacted(r[1]) for r in rows}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    vocabulary = pieces.load()
    copies, used = Counter(), defaultdict(int)
    for r in out:
        text = vocabulary.decode(b"".join(i.to_bytes(4, "little") for i in r.piece_ids))
        assert text == want[r.doc_id]
        copies[r.doc_id] += 1
        used[r.source] += words(text)
    assert set(copies) == set(want)  # no clean document is lost
    totals = defaultdict(int)
    for r in rows:
        totals[r[3]] += words(want[r[0]])
    assert used["big"] == totals["big"] and 1.2 * totals["small"] < used["small"] <= mixing.MAX_REPEATS * totals["small"]


def test_every_stage_keeps_its_columns_and_takes_odd_and_empty_tables(spark):
    from pyspark.sql import functions as F

    for rows in (ODD, []):
        df = documents(spark, rows).withColumns({"fp": F.lit(1), "component_id": F.lit("x"), "_v_kept": F.lit(2), "spans": F.lit(3), "pass": F.lit(4), "c0": F.lit(5)})
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, "")
            assert out.columns == df.columns, name
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, df, "").count() == len(rows)


def test_near_duplicates_keep_one_row_each(spark):
    rows = [(5, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (9, "p q r s t u"), (None, "a b c d e"), (7, None), (8, "")]
    out = corpus_pipeline.near_duplicates(spark, documents(spark, rows), "").collect()
    assert sorted(str(r.doc_id) for r in out) == ["2", "7", "9", "None"]


def test_entry_registers_the_pipeline():
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and "op3_simhash_near_dedup" in entry.queries()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "pii", "temperature_mixing", "sentencepiece"]
