from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from veldspar.functions import shared
from veldspar.operators import audit, governance, names_etl, places_lookup, relate, review
from veldspar.sources import files

ENT = "doc_id long, entity_id long, text string, entity_type string, confidence double, start int, end int, metadata map<string,string>"


def ents(spark, *rows):
    return spark.createDataFrame([(1, i, t, k, c, s, s + len(t), {}) for i, (t, k, c, s) in enumerate(rows)], ENT)


def test_groups_and_relationships(spark):
    df = ents(spark, ("Ann Bo", "PERSON", 0.9, 0), ("0803", "PHONE", 0.8, 20), ("Zed", "PERSON", 0.7, 400), ("1234", "NATIONAL_ID", 0.95, 500))
    got = sorted((r.source_text, r.target_text, r.relation, r.confidence) for r in relate.relationships(relate.gap_groups(df)).collect())
    assert got == [("Ann Bo", "0803", "HAS_PHONE", 0.9), ("Zed", "1234", "HAS_ID", 0.7)]
    docs = spark.createDataFrame([(1, "Ann Bo here. x" + " " * 10 + "0803 " + "y" * 380 + "Zed")], "doc_id long, text string")
    parts = docs.select(F.expr(relate.sentences_sql("text")).alias("s")).first().s
    assert [(p.start, p.end) for p in parts] == [(0, 11), (13, 412)] or parts[0].end == 11
    by = {r.text: r.grp for r in relate.sentence_groups(df, docs).collect()}
    assert by["Ann Bo"] == 0 and by["0803"] == 1 and by["1234"] == -1


def test_graph_and_overlaps(spark):
    df = ents(spark, ("Ann", "PERSON", 0.9, 0), ("Lagos", "LOCATION", 0.9, 10), ("Bob", "PERSON", 0.9, 500), ("Accra", "LOCATION", 0.9, 510), ("Ann", "PERSON", 0.9, 600))
    loc = spark.createDataFrame([("Lagos", "NG", 1.0), ("Accra", "GH", 1.0)], "name string, country string, confidence double")
    met = {(r.a, r.b) for r in relate.located(df, loc).collect()}
    assert met == {(0, "location_Lagos_NG"), (2, "location_Accra_GH"), (4, "location_Accra_GH")}
    pairs = relate.cooccurrences(df).count()
    assert pairs == 9  # the two Anns are not a pair
    nodes, edges = relate.graph(df, locations=loc)
    assert nodes.count() == 7 and edges.where("relation = 'LOCATED_AT'").count() == 3
    a = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (2, 0, 5)], "doc_id long, start int, end int")
    b = spark.createDataFrame([(1, 4, 6)], "doc_id long, start int, end int")
    assert relate.outside(a, b).count() == 1


def test_nearest_places(spark):
    gaz = files.gazetteer(spark)
    names = spark.createDataFrame([("Lagos",), ("cape town city",), ("Qqqq",), ("",)], "name string")
    got = {r.asked: r.place for r in relate.nearest_place(names, gaz).collect()}
    assert got["Lagos"] == "lagos" and got["cape town city"] == "cape town" and "Qqqq" not in got
    points = gaz.select(F.col("name").alias("id"), "lat", "lng")
    near = {(r.a, r.b) for r in relate.nearby(points, points, 60).where("a < b").collect()}
    assert ("Johannesburg", "Soweto") in near and ("Johannesburg", "Pretoria") in near and ("Accra", "Lagos") not in near


def test_audit(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1 + i % 3), "policy" if i % 2 else "detection", f"h{i % 2}", "PII-2-NIN", "mask" if i % 2 else None, "NDPA-2023", "s.30" if i > 2 else "", {"Text": "leak", "k": "v"}) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, timestamp timestamp, event_type string, document_hash string, category string, action string, statute_id string, statute_reference string, metadata map<string,string>")
    audit.append(df, f"{tmp_path}/log")
    back = spark.read.parquet(f"{tmp_path}/log")
    assert back.count() == 10 and back.first().metadata == {"k": "v"}
    assert [r.id for r in audit.query(back, event_type="policy", since=datetime(2024, 1, 2), limit=2).collect()] == [1, 5]
    (row,) = audit.policy_counts(back).collect()
    assert (row.n, row.statute_reference) == (5, "s.30")
    text = audit.report(back)
    assert "Total events: 10" in text and "| NDPA-2023 | PII-2-NIN | mask | 5 | s.30 |" in text and "| detection | 5 |" in text
    assert "No audit events" in audit.report(back.where("false")) and "leak" not in audit.export(df).first().event
    plan = audit.query(back, event_type="policy")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,policy)]" in plan


def test_review(spark):
    ids = spark.createDataFrame([(1, 2, 0.72, ["x"]), (2, 3, 0.95, ["x"]), (3, 2, 0.2, ["x"]), (4, 1, 0.9, [])], "cluster long, sources int, confidence double, match_reasons array<string>")
    members = spark.createDataFrame([(1, 1), (1, 5), (2, 2), (2, 6), (2, 7), (3, 3), (3, 8), (4, 4)], "cluster long, entity_id long")
    routed = review.route(ids, members)
    assert review.stats(routed).first().asDict() == {"total": 4, "pending": 1, "approved": 0, "rejected": 0, "escalated": 0, "auto_approved": 2, "auto_rejected": 1}
    one = review.pending(routed).first().id
    log = lambda *s: spark.createDataFrame([(one, i, x, "me", "") for i, x in enumerate(s)], "id string, seq int, status string, reviewer string, notes string")
    assert review.decide(routed, log("escalated", "approved")).where(F.col("id") == one).first().status == "approved"
    with pytest.raises(Exception, match="cannot set"):
        review.decide(routed, log("approved", "rejected")).collect()
    with pytest.raises(Exception, match="cannot set"):
        review.decide(routed, log("escalated", "escalated")).collect()


def test_governance(spark):
    ev = spark.createDataFrame([(1, "nin", "12345678901"), (1, "bvn", "22100987654"), (1, "sa_id", "8001015009087"), (1, "email", "a@b.co"), (1, "title", "Dr"), (2, "city", "Lagos")], "doc_id long, label string, text string")
    pii = spark.createDataFrame([(1, "EMAIL", "a@b.co"), (1, "CREDIT_CARD", "4111111111111111")], "doc_id long, pii_type string, text string")
    got = {r.doc_id: r for r in governance.assess(governance.findings(ev, pii)).collect()}
    assert (got[1].high, got[1].medium, got[1].low, got[1].dpia_required, got[1].consent_status) == (3, 2, 0, True, "required") and len(got[1].required_actions) == 4
    assert got[2].required_actions == [] and got[2].consent_status == "not_applicable"
    with_consent = governance.assess(governance.findings(ev, consent=True), consent=True).where("doc_id = 1").first()
    assert with_consent.consent_status == "obtained" and len(with_consent.required_actions) == 2


def raw(spark, *rows):
    at = datetime(2024, 1, 1)
    return spark.createDataFrame([("wikidata", f"Q{i}", "CC0", n, k, c, "en", e, at) for i, (n, k, c, e) in enumerate(rows)], names_etl.RAW)


def test_names(spark):
    df = raw(spark, (" 'Adéọlá (given name)", "given", "NG", 3), ("ADEOLA", "given", "GH", 5), ("Bello", "family", "NG", 1), ("Bello", "family", "NG", 2))
    again = names_etl.dedupe(df.unionByName(df))
    assert sorted(r.evidence_count for r in again.collect()) == [2, 4, 6, 10]
    normal = names_etl.normalize(df)
    first = normal.where("source_id = 'Q0'").first()
    assert (first.name_display, first.name_ascii_key, first.had_diacritics, first.was_trimmed, first.script) == ("Adéọlá", "adeola", True, True, "latin_extended")
    lex = {r.name_ascii_key: r for r in names_etl.lexicon(normal).collect()}
    assert (lex["adeola"].name_nfc, lex["adeola"].countries, lex["adeola"].total_evidence_count, lex["adeola"].occurrence_count) == ("ADEOLA", "GH|NG", 8, 2)
    assert names_etl.unique_names(names_etl.lexicon(normal)).count() == 2
    bad = names_etl.invalid(raw(spark, ("", "nick", "ng", 0)))
    assert len(bad.first().errors) == 4


def test_candidates_and_publication(spark):
    groups = names_etl.groups_table(spark, {"west_african": [["Diallo", "Jallow"]], "cross_linguistic": [["Peter", "Pierre"]]})
    normal = names_etl.normalize(raw(spark, ("Diallo", "family", "SN", 9), ("Díallo", "family", "ML", 2), ("Petter", "given", "KE", 1), ("Zzyzx", "given", "KE", 1)))
    got = {(r.canonical, r.variant): r for r in names_etl.candidates(normal, groups).collect()}
    assert set(got) == {("Diallo", "Díallo"), ("Peter", "Petter")}
    assert got["Diallo", "Díallo"].suggested_tradition == "west_african" and got["Peter", "Petter"].confidence >= 0.7
    assert got["Diallo", "Díallo"].candidate_id.startswith("cand_") and len(got["Diallo", "Díallo"].candidate_id) == 21
    rows = names_etl.candidates(normal, groups).withColumn("status", F.lit("approved"))
    after = names_etl.apply_approved(groups, rows)
    assert after.where("canonical = 'Peter'").count() == 3 and after.count() == 6
    with pytest.raises(Exception, match="provenance"):
        names_etl.apply_approved(groups, rows.withColumn("source", F.lit(""))).collect()
    reg = names_etl.registry(rows.limit(0).withColumn("applied_at", F.lit("x")), rows, "2024-01-01")
    published = after.select("canonical", "variant", F.lit("t").alias("tradition"), "file")
    rich = names_etl.enriched(published, reg)
    assert rich.where("source <> ''").count() == 2 and names_etl.stats(published, rich).first().rows_with_provenance == 2
    assert names_etl.bundle_counts(rows).first().approved == 2


def test_places(spark):
    df = spark.createDataFrame([(0, "Dentist near St Thomas' Hospital in SW1, or at SE1 7EH. I drive a Nissan Leaf"), (1, "nothing")], "i int, text string")
    got = df.select(F.expr(places_lookup.mentions_sql("text")).alias("m"), F.expr(places_lookup.categories_sql("text")).alias("c")).collect()
    assert [(m.text, m.kind) for m in got[0].m][:2] == [("SE1 7EH", "postcode"), ("SW1", "postcode")] and any(m.kind == "landmark" for m in got[0].m)
    assert got[0].c == ["dentist", "hospital", "ev_charger"] and got[1].m == []
    rows = spark.createDataFrame([(f"p{i}", "dentist", "SE1 7EH", 100 * i, f"ask Dr Jane Roe on 020 7946 0958 or j{i}@x.org") for i in range(5)], "id string, kind string, anchor string, distance_m int, note string")
    safe = places_lookup.redact(rows, ["note"]).first()
    assert safe.note == "ask [REDACTED:STAFF_NAME] on [REDACTED:STAFF_PHONE] or [REDACTED:EMAIL]" and safe.redacted_fields == ["note"]
    assert places_lookup.redact(rows, ["note"], "NG").first().redacted_fields == []
    page = places_lookup.directory(rows, "dental", 2, "2").collect()
    assert [r.id for r in page] == ["p2", "p3"] and page[0].total_estimate == 5 and page[0].next_cursor == "4"
    with pytest.raises(places_lookup.UpstreamError):
        places_lookup.directory(rows, "casino", 1)
    found = places_lookup.anchored(df, rows)
    assert found.where("status = 'ok'").count() == 5 + 1 - 1 or found.where("status = 'ok'").count() == 5
    assert found.where("i = 1").first().status == "no jurisdiction"
    assert places_lookup.compliance(places_lookup.redact(rows, ["note"])).first().policy == "uk_gdpr_v0_hardcoded"
    assert places_lookup.canonical_addresses(spark.createDataFrame([("x",)], "raw string")).first().match_weight == 0.0


def test_self_pairs_of_a_hot_block(spark):
    rows = [("hot", i, f"t{i % 7}") for i in range(40)] + [("cold", 100 + i, "t") for i in range(3)] + [(None, 200, "t"), (None, 201, "t")]
    df = spark.createDataFrame(rows, "block string, id long, text string")
    got = sorted((r.block, r.a.id, r.b.id) for r in shared.self_pairs(df, ["block"], "id", chunk=6).collect())
    want = sorted((x, i, j) for x, i, _ in rows for y, j, _ in rows if x == y and x is not None and i < j)
    assert got == want
    assert shared.self_pairs(df.limit(0), ["block"], "id").count() == 0


def test_locations_across_cells(spark):
    rows = [(1, k, t, e, 0.9, at, at + 1, m) for k, (t, e, at, m) in enumerate([
        ("Ada", "PERSON", 199, None), ("Lagos", "LOCATION", 200, None), ("Lagos", "LOCATION", 399, None), ("Lagos", "LOCATION", 400, {"patient_id": "7"}),
        ("Ben", "PERSON", 5000, {"patient_id": "7"}), ("Cy", "PERSON", 601, {"patient_id": ""}), ("Kano", "LOCATION", 802, {"patient_id": ""})])]
    df = spark.createDataFrame(rows, ENT)
    places = spark.createDataFrame([("Lagos", "NG", 0.8), ("Kano", "NG", 0.8)], "name string, country string, confidence double")
    got = sorted((r.a, r.b) for r in relate.located(df, places).collect())
    assert got == [(0, "location_Lagos_NG"), (4, "location_Lagos_NG")]


def test_sessions_of_fractional_times(spark, tmp_path):
    import duckdb

    from veldspar.plans import registry

    at = lambda micros: datetime.fromtimestamp(1_704_067_200 + micros // 10**6, UTC).replace(tzinfo=None, microsecond=micros % 10**6)
    gap = 21600 * 10**6
    # gaps that rounding lengthens, shortens, leaves; halves; an event whose number is smaller than that of the one before in its second
    times = {1: [400_000, gap + 600_000], 2: [600_000, gap + 1_400_000], 3: [0, gap + 499_999], 4: [0, gap + 500_000], 5: [500_000, gap + 1_500_000], 6: [0, 2 * gap, 2 * gap + 100_000]}
    rows = [(100 * u - i, at(t), u) for u, ts in times.items() for i, t in enumerate(ts)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(tuple(r) for r in registry.queries()["gap_sessions"](spark, str(tmp_path)).collect())
    with duckdb.connect() as db:
        db.execute(f"create view events as from '{tmp_path}/events.parquet/*.parquet'")
        assert got == sorted(db.execute(registry.oracle_sql()["gap_sessions"]).fetchall())
    assert [g for u, _, g in got if u < 6] == [1, 0, 0, 0, 0, 0, 0, 0, 1, 0]
