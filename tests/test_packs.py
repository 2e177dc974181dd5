import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from veldspar.functions import crypto
from veldspar.operators import entities, jurisdictions, requests
from veldspar.plans import documents, names_job
from veldspar.sources import files, sparql


def one(spark, sql):
    return spark.range(1).select(F.expr(sql)).first()[0]


def test_profiles():
    assert jurisdictions.available() == ["GH", "KE", "NG", "ZA"]
    p = jurisdictions.profile("ng")
    assert p["phones"]["calling_code"] == "234" and p["statute"] == "NDPA-2023" and "PII-2-NIN" in p["categories"] and "NG_BVN" in p["identifiers"]
    with pytest.raises(ValueError):
        jurisdictions.profile("FR")


def test_networks(spark):
    cases = [("NG", "0803 555 7890", "MTN"), ("NG", "+234 805 555 7890", "Glo"), ("NG", "0700 000 0000", None), ("GH", "+233 24 555 1234", "MTN"), ("KE", "0722 000 111", "Safaricom"), ("ZA", "063 111 2222", "MTN"), ("ZA", "082 111 2222", "Vodacom")]
    for code, phone, want in cases:
        assert one(spark, jurisdictions.network_sql(f"'{phone}'", code)) == want, phone
    assert one(spark, jurisdictions.strict_phone_sql("'0803-555-7890'", "NG")) == "+2348035557890"
    assert one(spark, jurisdictions.strict_phone_sql("'+234 803 555 7890'", "NG")) == "+2348035557890" and one(spark, jurisdictions.strict_phone_sql("'0700 000 0000'", "NG")) is None
    assert jurisdictions.network_table(spark).where("country = 'ZA'").count() == 17


def test_pack_identifiers(spark):
    got = one(spark, jurisdictions.pack_ids_sql("'BVN 22100987654, nin 12345678901, tin 1234567890, 9876543210'", "NG"))
    assert {(r.id_type, r.value, r.confidence) for r in got} == {("BVN", "22100987654", 0.95), ("NIN", "12345678901", 1.0), ("TIN", "1234567890", 0.8), ("TIN", "9876543210", 0.8)}
    assert one(spark, jurisdictions.pack_ids_sql("'number 1234567890 alone'", "NG")) == []
    assert [r.id_type for r in one(spark, jurisdictions.pack_ids_sql("'8001015009087 8001015009080'", "ZA"))] == ["NATIONAL_ID"]


def fake(query):
    offset = int(query.rsplit("OFFSET ", 1)[1])
    if "wd:Q115" in query:
        raise OSError("down")
    found = [{"n": {"value": f"http://x/Q{offset + i}"}, "label": {"value": f"Name{offset + i}", "xml:lang": "en"}} for i in range(2 if offset < 4 else 1)]
    return json.dumps({"results": {"bindings": [*found, *found[:1]] if offset == 4 else found}})


def test_sparql_source(spark):
    df = sparql.names(spark, {"NG": "Q1033"}, fake, limit=2, pages=9, wait=0.0)
    rows = df.collect()
    # two pages of two, then one of two bindings for the same name, then a short one
    assert df.rdd.getNumPartitions() == 4 and {r.name_type for r in rows} == {"given", "family"} and {r.mode for r in rows} == {"person", "entity"}
    assert {r.name for r in rows} >= {"Name0", "Name1", "Name2", "Name3", "Name4"}
    with pytest.raises(Exception, match="down"):
        sparql.names(spark, {"ET": "Q115"}, fake, tries=2, wait=0.0).collect()


def test_model_proposals(spark):
    text = "Ann Bo lives in Lagos"
    answer = '```json\n{"entities": [{"text": "Ann Bo", "type": "person", "start": 5, "end": 9, "confidence": 7}, {"text": "lagos", "label": "CITY"}, {"text": "Nobody", "type": "person"}, {"text": "Ann", "type": "planet"}]}\n```'
    df = spark.createDataFrame([(text, answer), (text, "no json"), (text, None)], "t string, a string")
    got = [r.e for r in df.select(F.expr(entities.proposals_sql("t", "a")).alias("e")).collect()]
    assert [(e.text, e.entity_type, e.start, e.end, e.confidence) for e in got[0]] == [("Ann Bo", "PERSON", 0, 6, 1.0), ("lagos", "LOCATION", 16, 21, 0.7)]
    assert got[1] == [] and got[2] == []
    merged = entities.extract(spark.createDataFrame([(text + ", a@b.co",)], "text string"), model=lambda t: F.expr(f"cast(array(named_struct('text', 'Ann Bo', 'entity_type', 'PERSON', 'confidence', 0.9D, 'start', 0, 'end', 6, 'source', 'llm', 'metadata', cast(map() as map<string,string>))) as array<{entities.ENTITY}>)")).first().entities
    assert [e.text for e in merged] == ["Ann Bo", "a@b.co"]


def test_receipts_and_bundles(spark):
    seed = bytes(range(32))
    r = requests.receipt({"place_count": 2}, seed)
    assert crypto.check_jws(r["jws"])["payload"] == r["payload_preview"]
    events = spark.createDataFrame([(1, "policy", {"text": "x", "k": "v"})], "id long, event_type string, metadata map<string,string>")
    found = crypto.check_jws(requests.signed_bundle(events, seed))
    assert found["valid"] and found["payload"]["count"] == 1 and '"x"' not in found["payload"]["events"][0]
    with pytest.raises(ValueError):
        requests.signed_bundle(events, seed, most=0)


def test_documents_to_identities(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ring +234 803 555 7890 or a@b.co"), (2, "again +234-803-555-7890 today"), (3, None)], "doc_id long, text string")
    r = documents.resolve_documents(docs, redact="mask")
    merged = r.identities.where("sources > 1").collect()
    assert [m.entity_type for m in merged] == ["PHONE"] and merged[0].sources == 2
    assert r.texts.where("doc_id = 1").first().text == "ring **** or ****" and r.entry.count() == 3
    assert r.nodes.where("kind = 'resolved'").count() == 1 and r.edges.where("relation = 'SAME_AS'").count() == 2
    files.export(entities.extract(docs), f"{tmp_path}/csv", "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").count() == 3
    with pytest.raises(ValueError):
        files.export(docs, str(tmp_path), "xml")


def test_names_job(spark, tmp_path):
    from veldspar.operators import names_etl

    at = datetime(2024, 1, 1)
    raw = spark.createDataFrame([("wikidata", "Q1", "CC0", n, "given", "NG", "en", 1, at) for n in ("Adeola", "Adéọlá", "Bello")], names_etl.RAW)
    counts = names_job.build(spark, raw, str(tmp_path)).first()
    assert counts.total == 1 and spark.read.parquet(f"{tmp_path}/lexicon").count() == 2
    with pytest.raises(ValueError, match="name_type"):
        names_job.build(spark, raw.withColumn("name_type", F.lit("nick")), str(tmp_path))
