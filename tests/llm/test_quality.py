import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, documents
from veldspar.llm import gbdt, quality

SF = "/root/testdata/sf0.01"


def is_held(doc):
    return zlib.crc32(str(doc).encode()) % 3 == 1


def test_windows_reach_the_end_of_the_text():
    at = {name: n for n, name in enumerate(quality.STATISTICS)}
    for n in (1, 30, 59, 60, 61, 75, 90, 91, 119, 150, 200):
        clean = [f"word{i}" for i in range(n)]
        plain = quality.statistics(" ".join(clean))
        for place in {0, n // 2, n - 1}:
            junk = quality.statistics(" ".join([*clean[:place], "#A#A#", *clean[place + 1 :]]))
            for name in ("upper", "symbols", "worst_upper", "worst_symbols"):
                assert junk[at[name]] > plain[at[name]]
    tail = quality.statistics(" ".join([f"word{i}" for i in range(60)] + ["same"] * 30))
    assert tail[at["worst_distinct"]] == 61 / 90


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = quality.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(out) > 80 and all(is_held(r.doc_id) for r in out)
    assert np.mean([r.predicted == r.quality for r in out]) > 0.95
    assert quality.classify(docs, labels).count() == docs.count()


def test_held_out_labels_are_never_learned(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["AB!", "cd", "ef"]) for _ in range(30)) if i % 2 else " ".join(rng.choice(["gh", "cd", "ij"]) for _ in range(30))) for i in range(300)]
    docs = documents(spark, rows)
    schema = "doc_id long, quality int, toxic int"
    honest = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(300)], schema)
    lied = spark.createDataFrame([(i, int(i % 2 == 0) ^ is_held(i), 0) for i in range(300)], schema)
    a, b = (sorted(map(tuple, quality.classify(docs, x).collect())) for x in (honest, lied))
    assert a == b
    assert all(p == int(d % 2 == 0) and h == is_held(d) for d, h, _, p in a)


def test_sample_is_bounded(spark, monkeypatch):
    seen = []
    real = gbdt.fit
    monkeypatch.setattr(gbdt, "fit", lambda x, y, **k: (seen.append(len(x)), real(x, y, **k))[1])
    rows = [(i % 50, f"w{i} a b") for i in range(400)]
    labels = spark.createDataFrame([(i % 50, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    quality.fit(documents(spark, rows), labels, sample=10)
    assert seen == [10]


def test_odd_rows(spark):
    docs = documents(spark, ODD).withColumns({"y": F.lit("q"), "score": F.lit(1), "held_out": F.lit(2)})
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    assert [r.held_out for r in out if r.doc_id is None] == [False]
    assert all(r.score == 0.5 for r in quality.classify(docs, labels.where("false")).collect())
    assert quality.classify(documents(spark, []), labels).count() == 0


def slow_score(text, trees):
    """One tree after another, node by node."""
    x = quality.statistics(text)
    margin = trees.bias
    for t in range(len(trees.leaf)):
        node = 0
        while node < trees.cut.shape[1]:
            node = 2 * node + (2 if x[trees.feature[t, node]] > trees.cut[t, node] else 1)
        margin += trees.leaf[t, node - trees.cut.shape[1]]
    return 1 / (1 + np.exp(-margin))


def test_scores_match_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    some = documents(spark, [*((r.doc_id, r.text) for r in docs.where("doc_id % 9 = 0").collect()), *(r[:2] for r in ODD)])
    trees = quality.fit(docs, labels)
    texts = [(str(r.doc_id), r.text) for r in some.collect()]
    got = sorted((str(r.doc_id), round(r.score, 9), r.predicted) for r in quality.score(some, trees).collect())
    want = [(d, slow_score(t, trees)) for d, t in texts]
    assert got == sorted((d, round(p, 9), int(p >= 0.5)) for d, p in want)
