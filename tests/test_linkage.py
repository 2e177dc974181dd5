import math
import random

import pytest
from pyspark.sql import functions as F

from veldspar.operators import components, linkage, resolve


def drawn(rng, n, share=0.2):
    """Pairs whose levels follow known chances, and whether each is a match."""
    rows = []
    for i in range(n):
        match = rng.random() < share
        name = rng.choices([0, 1, 2], [0.05, 0.15, 0.8] if match else [0.8, 0.15, 0.05])[0]
        phone = rng.choices([0, 1], [0.1, 0.9] if match else [0.97, 0.03])[0]
        town = None if rng.random() < 0.3 else rng.choices([0, 1], [0.2, 0.8] if match else [0.9, 0.1])[0]
        rows.append((i, 1_000_000 + i, name, phone, town, match))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "a long, b long, name int, phone int, town int, truth boolean")


def test_chances_are_found_again(spark):
    w = linkage.train(frame(spark, drawn(random.Random(1), 20_000)), ["name", "phone", "town"])
    assert abs(w.share - 0.2) < 0.02
    assert abs(w.m["name"][2] - 0.8) < 0.05 and abs(w.u["name"][0] - 0.8) < 0.05
    assert abs(w.m["phone"][1] - 0.9) < 0.05 and abs(w.u["phone"][1] - 0.03) < 0.02 and abs(w.m["town"][1] - 0.8) < 0.05


def test_training_matches_a_pair_by_pair_version(spark):
    rows, fields = drawn(random.Random(2), 300), ["name", "phone", "town"]
    found = linkage.train(frame(spark, rows), fields, rounds=5)
    patterns = [r[2:5] for r in rows]
    levels = {f: sorted({p[i] for p in patterns if p[i] is not None}) for i, f in enumerate(fields)}
    share = 0.1
    m = {f: {v: (k + 1) / sum(range(1, len(ls) + 1)) for k, v in enumerate(ls)} for f, ls in levels.items()}
    u = {f: {v: (len(ls) - k) / sum(range(1, len(ls) + 1)) for k, v in enumerate(ls)} for f, ls in levels.items()}
    for _ in range(5):
        sure = []
        for p in patterns:
            yes, no = share, 1 - share
            for f, v in zip(fields, p):
                if v is not None:
                    yes, no = yes * m[f][v], no * u[f][v]
            sure.append(yes / (yes + no))
        share = sum(sure) / len(sure)
        for i, f in enumerate(fields):
            met = [(p[i], s) for p, s in zip(patterns, sure) if p[i] is not None]
            m[f] = {v: sum(s for x, s in met if x == v) / sum(s for _, s in met) for v in levels[f]}
            u[f] = {v: sum(1 - s for x, s in met if x == v) / sum(1 - s for _, s in met) for v in levels[f]}
    assert math.isclose(found.share, share, rel_tol=1e-9)
    assert all(math.isclose(found.m[f][v], m[f][v], rel_tol=1e-9) and math.isclose(found.u[f][v], u[f][v], rel_tol=1e-9) for f in fields for v in levels[f])


def test_links_make_clusters(spark):
    pairs = frame(spark, drawn(random.Random(3), 5000))
    links = linkage.trained_links(pairs, ["name", "phone", "town"])
    judged = pairs.join(links, ["a", "b"], "left").select("truth", F.col("probability").isNotNull().alias("linked")).collect()
    assert sum(r.truth == r.linked for r in judged) > 0.97 * len(judged)
    assert components.connected_components(links.select("a", "b")).where("component < node").count() == links.count()
    entities = pairs.select(F.col("a").alias("entity_id")).unionByName(pairs.select(F.col("b").alias("entity_id")))
    assert resolve.clusters(entities, links.select("a", "b")).where("cluster <> entity_id").count() == links.count()


def test_nothing_to_learn_from(spark, monkeypatch):
    empty = frame(spark, [])
    assert linkage.train(empty, ["name", "phone"]).share == 0.1 and linkage.trained_links(empty, ["name"]).count() == 0
    never = frame(spark, [(1, 2, 1, 0, None, True), (3, 4, 0, 0, None, False)])
    assert linkage.train(never, ["name", "town"]).m["town"] == {}
    monkeypatch.setattr(linkage, "PATTERNS", 1)
    with pytest.raises(ValueError, match="combinations"):
        linkage.train(never, ["name"])


def test_levels(spark):
    assert [spark.range(1).select(F.expr(linkage.level_sql(f"cast({v} as double)"))).first()[0] for v in ("0.2", "0.7", "0.95", "1.0", "null")] == [0, 1, 2, 3, None]
