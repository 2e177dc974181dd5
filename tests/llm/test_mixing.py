import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, documents
from veldspar.llm import mixing


def words(text):
    return max(1, len(re.findall(r"[^\x20\x09-\x0D]+", text or "")))


def corpus(rng, sizes):
    rows, n = [], 0
    for s, size in enumerate(sizes):
        for _ in range(size):
            rows.append((n, "w " * rng.randint(1, 30), "en", f"s{s}"))
            n += 1
    return rows


def slow_exponent(totals, max_repeats, entropy, budget=None):
    total = sum(totals)
    p = [t / total for t in totals]

    def weights(a):
        z = sum(x**a for x in p)
        return [x**a / z for x in p]

    def h(w):
        return -sum(x * math.log(x) for x in w)

    for k in range(200_001):
        a = k / 200_000
        w = weights(a)
        b = budget or max(t / x for t, x in zip(totals, w))
        if max(x * b / t for t, x in zip(totals, w)) <= max_repeats + 1e-9 and h(w) <= max(entropy * math.log(len(p)), h(p)) + 1e-12:
            return a
    return 1.0


@pytest.mark.parametrize(("repeats", "entropy", "budget"), [(2.0, 1.0, None), (100.0, 0.8, None), (1.5, 1.0, 3000)])
def test_exponent_matches_a_fine_scan(spark, repeats, entropy, budget):
    totals = [4000, 900, 300, 120]
    df = spark.createDataFrame([(t,) for t in totals], "t long")
    assert abs(mixing.exponent(df, budget, repeats, entropy) - slow_exponent(totals, repeats, entropy, budget)) < 2e-5


def test_every_document_once_and_quotas_met(spark):
    rows = corpus(random.Random(1), [300, 60, 20])
    out = mixing.mix(documents(spark, rows)).collect()
    seen = Counter(r.doc_id for r in out)
    assert set(seen) == {r[0] for r in rows}
    totals, got, largest = Counter(), Counter(), defaultdict(int)
    for r in rows:
        totals[r[3]] += words(r[1])
        largest[r[3]] = max(largest[r[3]], words(r[1]))
    for r in out:
        assert r.mix_tokens == words(r.text) and 0 <= r.mix_place < 1
        got[r.source] += r.mix_tokens
    share = {r.source: r.mix_weight for r in out}
    a = slow_exponent([totals[s] for s in sorted(totals)], mixing.MAX_REPEATS, mixing.ENTROPY)
    for s in totals:
        quota = totals["s0"] ** (1 - a) * totals[s] ** a
        assert quota - largest[s] <= got[s] <= quota + 1
        assert max(c for d, c in seen.items()) <= math.ceil(mixing.MAX_REPEATS)
    assert abs(sum(share.values()) - 1) < 1e-9


def test_places_are_prefix_sums_of_each_pass(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    rows = corpus(random.Random(2), [200, 30])
    out = mixing.mix(documents(spark, rows)).collect()
    by = defaultdict(list)
    for r in out:
        by[r.source, r.mix_pass].append(r)
    orders = {}
    for (s, k), group in by.items():
        group.sort(key=lambda r: r.mix_place)
        quota = None
        at = 0
        for r in group:
            if quota is None and len(group) > 1:
                quota = group[0].mix_tokens / (group[1].mix_place - group[0].mix_place)
            total = sum(words(x[1]) for x in rows if x[3] == s)
            assert abs(r.mix_place * quota - (k * total + at)) < 1e-3 * quota
            at += r.mix_tokens
        orders[s, k] = [r.doc_id for r in group]
        assert len(set(orders[s, k])) == len(group)
    assert orders["s1", 0][: len(orders["s1", 1])] != orders["s1", 1]


def test_budget(spark):
    rows = corpus(random.Random(3), [300, 60])
    out = mixing.mix(documents(spark, rows), budget=1000).collect()
    used = sum(r.mix_tokens for r in out)
    assert 1000 - 60 <= used <= 1001
    with pytest.raises(ValueError, match="more than"):
        mixing.mix(documents(spark, rows), budget=10**7)


def test_odd_rows_and_columns(spark):
    df = documents(spark, ODD).withColumns({"mix_key": F.lit(1), "t": F.lit(2), "block": F.lit(3), "pass": F.lit(4), "before": F.lit(5), "m_source": F.lit("q")})
    out = mixing.mix(df)
    assert out.columns[: len(df.columns)] == df.columns
    got = Counter(str(r.doc_id) for r in out.collect())
    assert all(got[str(d)] >= n for d, n in Counter(str(r[0]) for r in ODD).items())
    assert mixing.mix(documents(spark, [])).count() == 0
    assert mixing.realised(documents(spark, [(1, "a b")])).collect()[0].asDict() == {"doc_id": 1, "source": "s", "n_tokens": 2, "weight": 1.0, "pass": 0, "place": 0.0}


def test_quotas_of_nothing_give_nothing(spark):
    df = documents(spark, [(i, "w " * 10, "en", f"s{i % 3}") for i in range(30)])
    assert mixing.mix(df, budget=1).count() == 0
    whole = mixing.mix(df, budget=300)  # as many passes as fit, nothing left over
    assert whole.count() == 30 and {r.mix_pass for r in whole.collect()} == {0}


def test_a_partial_pass_leaves_out_what_is_longer_than_itself(spark):
    long_only = documents(spark, [(i, "w " * 4000, "en", "a") for i in range(3)])
    assert mixing.mix(long_only, budget=50).count() == 0
    rows = [(i, "w " * 4000, "en", "a") for i in range(40)] + [(100 + i, "w " * (1 + i % 7), "en", "a") for i in range(60)]
    out = mixing.mix(documents(spark, rows), budget=50).collect()
    assert all(r.doc_id >= 100 for r in out) and 50 - 7 <= sum(r.mix_tokens for r in out) <= 50


def test_partial_pass_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    rows = corpus(random.Random(5), [300, 40])
    out = mixing.mix(documents(spark, rows), budget=2000).collect()
    for s in ("s0", "s1"):
        mine = sorted((r for r in out if r.source == s), key=lambda r: r.mix_place)
        total = sum(words(r[1]) for r in rows if r[3] == s)
        quota = round(mine[0].mix_weight * 2000)
        passes, rest = divmod(quota, total)
        assert all(sum(r.mix_tokens for r in mine if r.mix_pass == k) == total for k in range(passes))
        last = sum(r.mix_tokens for r in mine if r.mix_pass == passes)
        assert last <= rest < last + max(words(r[1]) for r in rows)
        at = 0
        for r in mine:  # places are prefix sums without gaps, across blocks and spans
            assert abs(r.mix_place * quota - at) < 1e-6 * max(1, quota)
            at += r.mix_tokens
