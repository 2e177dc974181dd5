import json
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veldspar.functions import crypto, similarity
from veldspar.functions.shared import checkpointed
from veldspar.operators import audit, policy, requests
from veldspar.plans.process import Options, outcomes, process
from veldspar.sources import files, render
from veldspar.streaming import jobs

SEED = bytes(range(32))


def test_rfc_8032_vectors():
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    assert crypto.public_key(seed).hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"
    signature = crypto.sign_bytes(seed, b"")
    assert signature.hex().startswith("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e06522490155")
    assert crypto.verify_bytes(crypto.public_key(seed), b"", signature) and not crypto.verify_bytes(crypto.public_key(seed), b"x", signature)
    seed = bytes.fromhex("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb")
    assert crypto.sign_bytes(seed, b"\x72").hex().startswith("92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da")


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=40))
def test_base58_round_trip(data):
    assert crypto.unbase58(crypto.base58(data)) == data


def test_tokens():
    did = crypto.did_of(crypto.public_key(SEED))
    assert did.startswith("did:key:z6Mk") and crypto.key_of(did) == crypto.public_key(SEED)
    token = crypto.jws({"b": 1, "a": "x"}, SEED, did)
    assert crypto.check_jws(token)["payload"] == {"a": "x", "b": 1}
    head, body, sig = token.split(".")
    assert not crypto.check_jws(f"{head}.{crypto.b64(b'{}')}.{sig}")["valid"] and not crypto.check_jws("a.b")["valid"]
    detached = crypto.jws(b"raw", SEED, did, detached=True)
    assert crypto.check_jws(detached, payload=b"raw")["valid"] and not crypto.check_jws(detached, payload=b"no")["valid"] and not crypto.check_jws(detached)["valid"]
    assert crypto.check_jws(crypto.jws("x", SEED))["error"] == "no public key" and crypto.check_jws(crypto.jws("x", SEED, "k"), resolver=lambda k: crypto.public_key(SEED))["valid"]


def test_selective_disclosure():
    whole = crypto.issue({"name": "Ann", "age": 40, "country": "NG"}, SEED, hide=["name", "age"], expires=2_000_000_000)
    assert crypto.check_credential(whole, now=1.0)["claims"]["name"] == "Ann"
    part = crypto.present(whole, ["age"])
    claims = crypto.check_credential(part, now=1.0)["claims"]
    assert claims["age"] == 40 and "name" not in claims and claims["country"] == "NG"
    assert crypto.check_credential(part)["valid"] is (datetime.now().timestamp() < 2_000_000_000)
    assert crypto.check_credential(part, now=3e9)["error"] == "expired" and crypto.check_credential(part, vct="Other", now=1.0)["error"].startswith("type")
    other = crypto.issue({"name": "Bob"}, SEED).split("~")[1]
    assert not crypto.check_credential(part + other + "~", now=1.0)["valid"]
    assert crypto.issue({"a": 1}, SEED) == crypto.issue({"a": 1}, SEED)


def test_multiples_of_points():
    """Out of tables as by doublings; a batch by one key costs few additions."""
    numbers = [0, 1, 2, 255, 256, 2**252, crypto._L - 1, crypto._L, 2**255 - 1]
    for multiples in (crypto._Multiples(crypto._BASE, 8), crypto._Multiples(crypto._times(7, crypto._BASE))):
        assert [crypto._pack(multiples(n)) for n in numbers] == [crypto._pack(crypto._times(n, multiples.point)) for n in numbers]
    token = crypto.issue({"name": "Ann"}, SEED, hide=["name"])
    key, added = crypto.public_key(SEED), []
    for _ in range(3):
        assert crypto.check_credential(token, key)["valid"]
    plain = crypto._add
    try:
        crypto._add = lambda p, q: added.append(1) or plain(p, q)
        assert crypto.issue({"name": "Ann"}, SEED, hide=["name"]) == token and crypto.check_credential(token, key)["valid"]
    finally:
        crypto._add = plain
    assert len(added) < 10


def test_verification_refuses_other_spellings():
    """A signature's point above the modulus, off the curve or with the wrong sign, and keys that are no points."""
    key, good = crypto.public_key(SEED), crypto.sign_bytes(SEED, b"m")
    assert crypto.verify_bytes(key, b"m", good) and not crypto.verify_bytes(key, b"n", good)
    for point in (b"\xff" * 32, (2).to_bytes(32, "little"), good[:31] + bytes([good[31] ^ 128])):
        assert not crypto.verify_bytes(key, b"m", point + good[32:])
    assert not crypto.verify_bytes(b"\xff" * 32, b"m", good) and not crypto.verify_bytes(key, b"m", good[:32] + (int.from_bytes(good[32:], "little") + crypto._L).to_bytes(32, "little"))


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def test_process(spark):
    df = process(docs(spark, "NIN 12345678901 and 0803 555 7890 at 8.8.8.8", "nothing", None), Options(jurisdiction="NG"))
    a, b, c = df.orderBy("doc_id").collect()
    assert "[NIN]" in a.redacted_text and "8.8.8.0/24" in a.redacted_text and "PHONE_" in a.redacted_text
    assert {(d.category, d.sensitivity_tier) for d in a.detections} == {("PII-2-NIN", "high"), ("PII-3-PHONE", "moderate"), ("PII-8-IP_ADDRESS", "low")}
    assert b.redacted_text == "nothing" and b.policy_outcomes == [] and c.detections == [] and a.statute_version == "v1.0"
    assert outcomes(df, "doc_id").count() == 3 and audit.events_of(df.withColumn("timestamp", F.current_timestamp())).count() == 6
    plain = process(docs(spark, "NIN 12345678901"), Options()).first()
    assert plain.statute_id is None and plain.redacted_text == "NIN 12345678901"
    with pytest.raises(TypeError):
        Options().but(colour=1)
    assert Options(jurisdiction="KE").but(salt="x").describe()["statute"] == "KENYA-DPA"


def test_signed_documents(spark):
    df = process(docs(spark, "NIN 12345678901"), Options(jurisdiction="NG"))
    did = crypto.did_of(crypto.public_key(SEED))
    env = requests.envelope(df, did, "kyc", "2024-01-01T00:00:00+00:00", "2030-01-01T00:00:00+00:00")
    row = env.first()
    body = json.loads(row.envelope)
    assert list(body) == sorted(body) and "12345678901" not in row.envelope and body["redacted_text"] == "NIN [NIN]"
    tokens = checkpointed(env.select(crypto.signed(F.col("envelope"), SEED, did).alias("token")))
    now = datetime(2025, 1, 1)
    assert requests.accept(tokens, purposes=["kyc"], jurisdictions=["NG"], now=now).first().accepted
    assert requests.accept(tokens, purposes=["ads"], now=now).first().reason == "purpose" and requests.accept(tokens, jurisdictions=["KE"], now=now).first().reason == "jurisdiction"
    assert requests.accept(tokens, now=datetime(2031, 1, 1)).first().reason == "expired"
    assert not requests.accept(tokens.select(F.concat("token", F.lit("x")).alias("token"))).first().accepted


def test_subject_requests(spark):
    req = spark.createDataFrame([(1, "NDPA-2023", "access", "Ann", "NIN", "1", "a@b.co", "", None)], "request_id int, statute string, request_type string, name string, identifier_label string, identifier_value string, contact string, purpose string, deadline_days int")
    to = spark.createDataFrame([(1, "Bank", None), (1, "Telco", "Road 1")], "request_id int, organization string, address string")
    rows = requests.drafts(to, req, "2024-01-01").orderBy("organization").collect()
    assert [str(r.deadline) for r in rows] == ["2024-01-31"] * 2 and "NDPA-2023 s.34" in rows[0].letter_text and "[Address on file]" in rows[0].letter_text
    with pytest.raises(Exception, match="no sue request"):
        requests.drafts(to, req.withColumn("request_type", F.lit("sue")), "2024-01-01").collect()


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one \r\ntwo\n\n\n\nthree  ")
    assert files.texts(spark, f"{tmp_path}/a.txt").first().text == "one\ntwo\n\nthree"
    (tmp_path / "b.exe").write_text("x")
    with pytest.raises(Exception, match="no plain-text"):
        files.texts(spark, f"{tmp_path}/b.exe").collect()
    (tmp_path / "r.csv").write_text("k,v\n1,\n,\n2,x\n")
    assert [r.text for r in files.record_texts(spark, f"{tmp_path}/r.csv").collect()] == ["k: 1", "k: 2 | v: x"]
    assert files.records(spark, f"{tmp_path}/none.jsonl", "a int").count() == 0
    (tmp_path / "s.pdf").write_bytes(b"%PDF")
    assert files.binaries(spark, f"{tmp_path}/s.pdf", lambda p, c: (c.decode(), 1)).first().num_pages == 1
    (tmp_path / "law.yaml").write_text("statute_id: X\njurisdiction: XX\nversion: 1\npolicy_mappings:\n  PII-1-NAME: {action: drop, tier: high}\n")
    assert files.statutes(str(tmp_path / "law.yaml"))["X"].mappings["PII-1-NAME"][0] == "drop"
    (tmp_path / "bad.yaml").write_text("statute_id: X\n")
    with pytest.raises(ValueError):
        files.statutes(str(tmp_path / "bad.yaml"))
    cur = tmp_path / "cur"
    cur.mkdir()
    (cur / "sample_x.csv").write_text("source,canonical\nno,c\n")
    (cur / "x.csv").write_text("source,canonical\nyes,c\n")
    assert [r.asDict() for r in files.curated(spark, str(cur), "source string, canonical string").collect()] == [{"source": "yes"}]


def test_pages_and_hosts(spark):
    page = "<html><head><style>x</style></head><body><h1>Hi  there</h1><p>a<b>b</b></p><script>no</script><td>c</td></body></html>"
    assert files.plain_text(page) == "Hi there\nab\nc" and files.plain_text(None) is None
    urls = spark.createDataFrame([("https://example.org/x",)], "url string")
    assert files.fetched(urls, lambda u: f"<p>{u}").first().html == "<p>https://example.org/x"
    for bad in ("http://127.0.0.1/", "http://10.0.0.8:80/", "ftp://example.org", "http://[::1]/", "http://localhost/"):
        with pytest.raises(Exception, match="refused"):
            files.fetched(spark.createDataFrame([(bad,)], "url string"), lambda u: u).collect()


def test_rendering(spark):
    assert "| 1 " in render.table(spark.createDataFrame([(1, None)], "a int, b string"))
    assert render.highlighted("a<b c", [{"start": 0, "end": 1, "label": "x"}]) == '<p><mark title="x">a</mark>&lt;b c</p>'
    n = spark.createDataFrame([("e1", "A")], "node string, label string")
    e = spark.createDataFrame([("e1", "e1", "R")], "a string, b string, relation string")
    assert '"e1" -- "e1"' in render.dot(n, e) and "<edge" in render.graphml(n, e) and render.graph_json(n, e)["nodes"] == [{"node": "e1", "label": "A"}]
    assert render.summary(spark.createDataFrame([("A",), ("A",)], "entity_type string")) == "2 A"


def test_streams_give_what_tables_give(spark, tmp_path):
    df = docs(spark, "NIN 12345678901", "0803 555 7890 and again 0803 555 7890", "nothing")
    df.write.parquet(f"{tmp_path}/in")
    stream = jobs.documents(spark, f"{tmp_path}/in", "doc_id long, text string")
    jobs.redact(stream, f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination(120)
    got = {r.doc_id: r.redacted_text for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r.doc_id: r.redacted_text for r in process(df, Options(jurisdiction="NG")).collect()}
    jobs.audited(stream, f"{tmp_path}/log", f"{tmp_path}/c2").awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/log").where("event_type = 'policy'").count() == 2


def test_windows_and_whitespace(spark):
    events = spark.createDataFrame([(datetime(2024, 1, 1, h), "a") for h in (0, 0, 1)], "ts timestamp, event_type string")
    assert sorted(r.n for r in jobs.counts(events).collect()) == [1, 2]
    one = lambda t: spark.createDataFrame([(t,)], "t string").select(F.expr(similarity.whitespace_sql("t"))).first()[0]
    assert one(" a \t\r\n\r\n\r\n\r\nb ") == "a\n\nb"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8)), max_size=6))
def test_redaction_never_loses_text_outside_spans(spark, found):
    text = "".join(chr(97 + i % 26) for i in range(40))
    rows = [(text, [("PII-2-NIN", text[a : a + n], a, a + n, 0.9, "d", "x", None, {}) for a, n in found])]
    df = spark.createDataFrame(rows, f"text string, detections array<{policy.spans.DETECTION}>")
    r = policy.apply(df, policy.load("NDPA-2023")).first()
    covered = {i for a, n in found for i in range(a, a + n)}
    kept = [o for o in r.policy_outcomes if o.superseded_by is None]
    applied = {i for o in kept for i in range(o.start, o.end)}
    assert applied <= covered and r.redacted_text.replace("[NIN]", "") == "".join(c for i, c in enumerate(text) if i not in applied)
