import hashlib

import pytest

from veldspar.operators import detectors, entities, policy


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")


def applied(spark, text, found, statute="NDPA-2023", **how):
    rows = [(text, [(c, text[a:b], a, b, 0.9, "d", "x", None, {}) for c, a, b in found])]
    df = spark.createDataFrame(rows, f"text string, detections array<{detectors.spans.DETECTION}>")
    return policy.apply(df, policy.load(statute), **how).first()


def test_actions(spark):
    text = "Customer Adesola Okonkwo, NIN 12345678901, phone 0803 555 7890."
    r = applied(spark, text, [("PII-1-NAME", 9, 24), ("PII-2-NIN", 30, 41), ("PII-3-PHONE", 49, 62)], salt="s")
    assert [o.action for o in r.policy_outcomes] == ["tokenize", "mask", "tokenize"] and "[NIN]" in r.redacted_text
    token = hashlib.blake2b(b"sAdesola Okonkwo", digest_size=4).hexdigest()
    assert r.policy_outcomes[0].applied_value == f"NAME_{token}" and f"NAME_{token}, NIN [NIN]" in r.redacted_text
    same = applied(spark, "Alice and Alice", [("PII-1-NAME", 0, 5), ("PII-1-NAME", 10, 15)], salt="test").policy_outcomes
    assert same[0].applied_value == same[1].applied_value
    assert applied(spark, "Acme RC123456 supplies widgets.", [("PII-2-RC", 5, 13)]).redacted_text == "Acme RC123456 supplies widgets."
    assert applied(spark, "at 10.1.2.3 ok", [("PII-8-IP_ADDRESS", 3, 11)]).redacted_text == "at 10.1.2.0/24 ok"
    assert applied(spark, "on 1985-03-14", [("PII-4-ADDRESS", 3, 13)]).redacted_text == "on 1985"
    assert applied(spark, "card 4111 x", [("PII-5-CARD", 5, 9)]).redacted_text == "card  x"
    assert applied(spark, "odd thing", [("PII-9-ODD", 0, 3)]).policy_outcomes[0].statute_reference == "NDPA-2023 s.30"


def test_overlaps(spark):
    found = [("PII-2-NIN", 0, 11), ("PII-3-PHONE", 0, 11)]
    r = applied(spark, "08031234567 hello", found)
    assert r.redacted_text == "[NIN] hello" and [o.superseded_by for o in r.policy_outcomes] == [None, "det:0:11"]
    assert "hello" not in applied(spark, "08031234567 hello", found, overlap="splice").redacted_text
    with pytest.raises(ValueError):
        applied(spark, "x", [], overlap="no")


def test_statutes(spark):
    assert policy.available() == ["GHANA-DPA", "KENYA-DPA", "NDPA-2023", "POPIA"]
    assert policy.table(spark).count() == 27 + 21 + 22 + 21
    with pytest.raises(ValueError):
        policy.Statute("X", "XX", "1", "", {"PII-1-NAME": ("burn", "high", None, None)})
    with pytest.raises(ValueError):
        policy.Statute("X", "XX", "1", "", {"PII-1-NAME": ("mask", "huge", None, None)})
    with pytest.raises(FileNotFoundError):
        policy.load("NOPE")


def test_redaction_strategies(spark):
    df = entities.personal_data(frame(spark, ["mail a@b.co or 4111 1111 1111 1111", "nothing", None]))
    for strategy, want in (("mask", "mail **** or ****"), ("remove", "mail  or "), ("placeholder", "mail <EMAIL> or <CREDIT_CARD>"), ("hash", f"mail {hashlib.sha256(b'a@b.co').hexdigest()[:8]} or {hashlib.sha256(b'4111 1111 1111 1111').hexdigest()[:8]}")):
        got = [r.redacted_text for r in policy.redact(df, strategy=strategy).orderBy("id").collect()]
        assert got[0] == want and got[1] == "nothing"
    with pytest.raises(ValueError):
        policy.redact(df, strategy="paint")


def test_entities(spark):
    texts = ["ISBN 978-0-306-40615-7 on 2024-05-17, see https://x.org/a and a@b.co, pay $1,200.50 or ₦500 to +234 803 555 7890", "ISBN 0-306-40615-2 or 0306406153", "NIN 12345678901 by 3 May 2021"]
    got = [[(e.entity_type, e.text) for e in r.entities] for r in entities.extract(frame(spark, texts)).orderBy("id").collect()]
    assert ("ISBN", "ISBN 978-0-306-40615-7") in got[0] and ("DATE", "2024-05-17") in got[0] and ("EMAIL", "a@b.co") in got[0]
    assert {("MONEY", "$1,200.50"), ("MONEY", "₦500"), ("PHONE", "+234 803 555 7890"), ("URL", "https://x.org/a")} <= set(got[0])
    assert ("ISBN", "ISBN 0-306-40615-2") in got[1]
    assert ("NATIONAL_ID", "12345678901") in got[2] and not any(k == "PHONE" for k, _ in got[2]) and ("DATE", "3 May 2021") in got[2]
    only = entities.extract(frame(spark, texts), types=["email"]).orderBy("id").first().entities
    assert [e.entity_type for e in only] == ["EMAIL"]


def test_evidence(spark):
    texts = ["Dr. Fatima Abdullahi met us, NIN 12345678901, account number: 123456789012", "Patient: Jordan Wells, born 1980-01-02", "met Mohammed Diallo Bah there", "Senior Software Engineer at 10:30 AM", "nothing here", None]
    rows = entities.evidence(frame(spark, texts)).orderBy("id").collect()
    got = [[(e.label, e.text) for e in r.evidence] for r in rows]
    assert {("person", "Fatima Abdullahi"), ("first_name", "Fatima"), ("last_name", "Abdullahi"), ("nin", "12345678901"), ("account_number", "123456789012")} <= set(got[0])
    assert {e.country_hint for e in rows[0].evidence if e.label in ("person", "first_name")} <= {"NG", ""}
    assert ("person", "Jordan Wells") in got[1] and ("date", "1980-01-02") in got[1]
    assert ("person", "Mohammed Diallo Bah") in got[2]
    assert ("occupation", "Senior Software Engineer") in got[3] and ("time", "10:30 AM") in got[3]
    assert got[4] == [] and got[5] == []
    for r in rows:
        for e in r.evidence:
            assert r.text[e.start : e.end].strip() == e.text
            if e.label == "person":
                assert e.confidence in (0.6, 0.55)


def test_adjudication(spark):
    kind = f"array<{entities.EVIDENCE}>"
    ev = lambda label, a, b, c, status="", source="regex": ("t", label, c, a, b, source, "", status, {})
    cases = [
        ([ev("nin", 0, 5, 0.5, "format_valid")], [ev("person", 0, 9, 0.99)], ["nin"]),
        ([ev("swift_bic", 0, 5, 0.5)], [ev("person", 2, 9, 0.99)], ["swift_bic"]),
        ([ev("date", 0, 5, 0.5)], [ev("person", 2, 9, 0.6)], ["person"]),
        ([ev("date", 0, 5, 0.6)], [ev("person", 2, 9, 0.6), ev("city", 5, 7, 0.1)], ["date", "city"]),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], f"i int, a {kind}, b {kind}")
    out = df.selectExpr("i", f"{entities.adjudicate_sql('a', 'b')} as e").orderBy("i").collect()
    assert [[e.label for e in r.e] for r in out] == [w for *_, w in cases]


def test_sensitive_and_tagged(spark):
    df = frame(spark, ["Mail a@b.co, card 4111 1111 1111 1111, NIN 12345678901"])
    got = {s.label: s for s in entities.sensitive(df).first().sensitive}
    assert got["nin"].redaction == "mask" and got["email"].redaction == "mask" and "phone_number" in got
    tagged = policy.tagged(spark.createDataFrame([("Jordan Wells", [("Jordan", "first_name", 0, 6), ("Wells", "last_name", 7, 12)])], "text string, evidence array<struct<text:string,label:string,start:int,end:int>>"))
    assert tagged.first().tagged_text == "<first_name>Jordan</first_name> <last_name>Wells</last_name>"


def test_level_two(spark):
    out = entities.detect(frame(spark, ["a@b.co and 4111 1111 1111 1111"])).first().entities
    assert [e.entity_type for e in out][0] == "EMAIL" and all(x.start <= y.start for x, y in zip(out, out[1:]))
    refused = {len(r.text): r for r in entities.detect(frame(spark, ["see www.example.com " * 3, "see www.b.org"]), longest=20, error="error").collect()}
    assert refused[60].entities == [] and "exceeds" in refused[60].error and refused[13].error is None and len(refused[13].entities) == 1
