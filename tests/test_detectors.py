import re

import pytest
from pyspark.sql import functions as F

from veldspar.data import identifiers
from veldspar.functions import spans
from veldspar.operators import addresses, detectors


def run(spark, texts, **how):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    out = detectors.detect(df, **how).orderBy("id").collect()
    for r in out:
        for d in r.detections:
            assert d.text == r.text[d.start : d.end]
    return [[(d.category, d.text, d.confidence, d.metadata) for d in r.detections] for r in out]


def test_phones(spark):
    texts = [
        "Contact: +234 803 555 7890.", "Call 0803 555 7890", "NG +234 803 555 7890 and KE +254 712 345678",
        "Bill Date: 2026-03-15", "Amount Due: NGN 45,750.00", "Account No: 0145-2367-8901", "NIN 12345678901 and BVN 22156789012",
        "twice 08035557890 and +2348035557890", None, "",
    ]
    got = run(spark, texts, jurisdiction="NG", packages=["core"])
    assert [[m["international"] for *_, m in row] for row in got] == [["+2348035557890"], ["+2348035557890"], ["+2348035557890", "+254712345678"], [], [], [], [], ["+2348035557890"], [], []]
    assert got[0][0][:3] == ("PII-3-PHONE", "+234 803 555 7890", 0.9) and got[2][1][3]["country"] == "KE"
    again = run(spark, texts[7:8], packages=["core"], **{"repeats": True})
    assert len(again[0]) == 2


def test_addresses_of_networks(spark):
    texts = ["Server at 8.8.8.8 responded", "LAN: 192.168.1.1 and 10.0.0.1", "Bad addr 256.1.1.1 here", "Partial 1.2.3 not enough",
             "Updated to version 1.2.3.4 yesterday", "Released v1.2.3.4 today", "Routed via 2001:db8::1 today", "Connect to fe80::1%eth0 now",
             "Mapped: ::ffff:192.0.2.1", "Local: ::1", "octal 010.1.1.1", "at 12:30:45 we met"]
    got = run(spark, texts, packages=["ip"])
    assert [len(row) for row in got] == [1, 2, 0, 0, 0, 0, 1, 1, 2, 1, 0, 0]
    assert [m["private"] for *_, m in got[1]] == ["true", "true"] and got[0][0][3]["private"] == "false"
    assert got[7][0][3]["zone"] == "eth0" and got[8][0][3]["ipv4_mapped"] == "true"


def test_digital_identities(spark):
    texts = ["Owner did:key:z6MkpTHR8VNsBxYAAWHut2Geadd9jSrnQ", "Domain: did:web:example.com", "Custom: did:fakebrand:abc123def456", "Format: did:method:identifier",
             "Bad: 0x742d35Cc6634C0532925a3b844Bc9e7595f0bEb", "Ok: 0x742d35Cc6634C0532925a3b844Bc9e7595f0bEb7", "btc 1BvBMSEYstWetqTFn5Au4m4GFg7xJaNVN2 and bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"]
    got = run(spark, texts, packages=["digital_id"])
    assert [[c for _, _, c, _ in row] for row in got] == [[1.0], [1.0], [0.7], [], [], [0.9], [0.85, 0.9]]
    assert got[6][1][3]["network"] == "mainnet" and got[0][0][3]["method"] == "key"


def test_identifiers(spark):
    texts = ["His SA ID is 8001015009087 and NIN is 12345678901", "Card: GHA-123456789-0", "RC123456 and BVN 22100987654", "A012345678Z 12345678 1234567", "8001015009080", "29001011234567 in Egypt", "nothing"]
    got = run(spark, texts, packages=["africa"])
    assert got[0][0][0] == "PII-2-NATIONAL_ID" and got[0][0][2] == 1.0 and got[0][0][3]["gender"] == "male" and got[0][0][3]["date_of_birth"] == "1980-01-01"
    assert got[0][1][:3] == ("PII-2-NIN", "12345678901", 0.75)
    assert got[1][0][:2] == ("PII-2-GHANA_CARD", "GHA-123456789-0")
    assert [r[:2] for r in got[2]] == [("PII-2-RC", "RC123456"), ("PII-2-BVN", "22100987654")]
    assert [r[1] for r in got[3]] == ["A012345678Z", "12345678", "1234567"] and got[3][1][0] == "PII-2-NHIF"
    assert all(r[0] != "PII-2-NATIONAL_ID" for r in got[4])
    assert got[5][0][3]["governorate_code"] == "12"
    assert [r[0] for r in run(spark, ["ABCDEFGHIJKLM ok"], packages=["africa"])[0]] == ["PII-2-SSNIT"]
    assert run(spark, ["ET-AB-1234"], packages=["africa"])[0][0][0] == "PII-2-KEBELE_ID"
    alone = run(spark, ["NIN 12345678901", "RC 123456 Ltd, AAA-12345678901"], packages=["ng"])
    assert alone[0] == [("PII-2-NIN", "12345678901", 0.6, {})]
    assert [r[:3] for r in alone[1]] == [("PII-2-RC", "RC 123456", 0.95), ("PII-2-DRIVERS_LICENCE", "AAA-12345678901", 0.9)]


def test_money(spark):
    got = run(spark, ["The total is ₦500,000 or KSh 50,000", "Price: 1,500.50 DH", "paid 1.500,50 FCFA? no, 500 naira", "NGN 45,750.00", "12 people"], packages=["money"])
    assert [[(m["currency"], float(m["amount"])) for *_, m in row] for row in got] == [[("NGN", 500000.0), ("KES", 50000.0)], [("MAD", 1500.5)], [("XOF", 1500.5), ("NGN", 500.0)], [("NGN", 45750.0)], []]


def test_names_and_places(spark):
    got = run(spark, ["fatima met Mohammed in Cape Town near JOBURG", "Lagosians"], packages=["names", "locations"])
    assert [r[1] for r in got[0]] == ["fatima", "Mohammed", "Cape Town", "JOBURG"]
    assert got[0][3][3]["canonical_name"] == "Johannesburg" and got[1] == []


ADDRESSES = [
    ("7B Allen Avenue, Ikeja, Lagos, Nigeria", {"street_number": "7B", "street": "Allen Avenue", "neighborhood": "Ikeja", "city": "Lagos", "country": "NG"}),
    ("12 Long Street, Cape Town, 8001, South Africa", {"street": "Long Street", "city": "Cape Town", "postal_code": "8001", "country": "ZA"}),
    ("P.O. Box 1234, Sandton, Johannesburg, 2196", {"plot": "P.O. Box 1234", "city": "Johannesburg", "neighborhood": "Sandton", "postal_code": "2196", "country": "ZA"}),
    ("12 Kingsway Street, Accra, GA-039-2345", {"city": "Accra", "postal_code": "GA-039-2345", "country": "GH"}),
    ("turn behind the Total filling station 4 Ring Road, Accra", {"anchor": "behind the Total filling station 4", "anchor_type": "commercial", "street": "Ring Road", "city": "Accra"}),
]


@pytest.mark.parametrize(("text", "want"), ADDRESSES)
def test_address_grammar(text, want):
    (found,) = addresses.addresses(text)
    parts = found["components"]
    assert {k: parts[k] for k in want if k != "anchor"} == {k: v for k, v in want.items() if k != "anchor"}
    assert text[found["start"] : found["end"]].strip() == found["raw"]


def test_no_address(spark):
    assert addresses.addresses("Just some text with no address at all.") == [] and addresses.addresses(None) == []
    got = run(spark, [ADDRESSES[0][0], "x"], packages=["addr"])
    assert got[0][0][0] == "PII-4-ADDRESS" and got[0][0][3]["city"] == "Lagos" and got[0][0][2] == 0.85 and got[1] == []


def test_jurisdictions(spark):
    texts = ["I'm at SE1 7EH right now.", "Office is in EC2A area", "Visiting Bamako, Mali next week", "That patient is a malingerer per the chart", "", "code 123456 here"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    got = [r.j for r in df.select("id", F.expr(addresses.jurisdiction_sql("t")).alias("j")).orderBy("id").collect()]
    assert [(j.code, j.confidence) for j in got] == [("GB", 0.95), ("GB", 0.85), ("ML", 0.99), ("XX", 0.0), ("XX", 0.0), ("NG", 0.7)]
    votes = df.select(F.expr(addresses.vote_sql("t")).alias("v")).collect()
    assert {v.v for v in votes} == {""}


def test_routing_and_plan(spark):
    got = run(spark, ["Customer Adesola Okonkwo, NIN 12345678901, phone 0803 555 7890, in Lagos."], jurisdiction="NG")
    assert {r[0] for r in got[0]} == {"PII-2-NIN", "PII-3-PHONE", "PII-4-LOCATION"}
    assert run(spark, ["x"], packages=["no such"]) == [[]]
    df = spark.createDataFrame([("a",)], "text string")
    plan = detectors.detect(df, packages=["africa", "core", "digital_id", "money", "names", "locations", "contact"])._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_matches_are_searched_once_a_text(spark):
    """One match, several, none, at either end, after characters beyond the 16-bit plane; pieces are made for texts with a match only."""
    texts = ["12", "ab", "", None, "\U0001f600 12 x", "12\U0001f600 345 6", "a1b22c" * 150, "1\n2"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    sql = spans.matches("coalesce(text, '')", "[0-9]+")
    got = [[(m.start, m.end, m.m) for m in r.s] for r in df.select("id", F.expr(sql).alias("s")).orderBy("id").collect()]
    assert got == [[(m.start(), m.end(), m[0]) for m in re.finditer("[0-9]+", t or "")] for t in texts]
    assert sql.index("split(") > sql.index("size(")


def test_identifier_formats_run_on_all_cores(spark, tmp_path):
    """A small file is dealt over the cores; of a text's formats only those found make arrays."""
    from veldspar.plans import registry

    spark.range(1, 41).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    found = registry.queries()["identifier_formats"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() >= 5 * spark.sparkContext.defaultParallelism
    assert found.groupBy("k").count().where("count = 30").count() == 40
    assert detectors.identifier_sql("text").count(" then transform(") >= len(identifiers.ORDER["africa"].split())
