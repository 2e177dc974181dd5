import hashlib
import random
import re

from pyspark.sql import functions as F

from tests.llm.helpers import ODD, documents
from veldspar.llm import secrets

P = {
    "assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}


def either_case(pattern):
    return re.sub("[a-z]", lambda m: f"[{m[0]}{m[0].upper()}]", pattern.split(")", 1)[0]) + ")" + pattern.split(")", 1)[1]


def slow(text):
    out = []
    for n, (kind, p) in enumerate(P.items()):
        for m in re.finditer(either_case(p) if kind == "assign" else p, text or ""):
            if (kind == "assign" and len(m[2]) >= 6) or (kind == "access" and len(m[0]) >= 20) or (kind == "hex" and len(m[0]) >= 24):
                out.append((m.start(), n, f"{kind}:{m.start()}:{m.end()}", kind))
    return sorted(out)


def base_row(doc, text):
    spans = slow(text)
    return (doc, *(sum(s[3] == k for s in spans) for k in P), hashlib.sha256(",".join(s[2] for s in spans).encode()).hexdigest())


def messy(rng):
    bits = ["PassWord", "token", "api_key", "APIKEY", "ſecret", "secret", "=", ": ", "'", '"', " ", "\n", "abc12", "Zz9+/_.=-x", "AKIA", "ABCDEFGHIJKLMNOPQR", "0123456789abcdef", "deadbeefdeadbeef01", "é😀", "token=secret=hunter22"]
    return "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))


def test_base_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [*ODD, *((100 + i, messy(rng)) for i in range(600)), (900, "a" * 50_000), (901, "password=" * 5000)]
    got = secrets.report(documents(spark, rows)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted((base_row(*r[:2]) for r in rows), key=str)
    texts = {r[0]: r[1] for r in rows}
    for r in got:
        if r.doc_id is not None and texts[r.doc_id]:
            assert {s[2] for s in slow(texts[r.doc_id])} <= set(r.spans.split(","))


def test_ownership_tells_examples_from_live_credentials(spark):
    live, shared = "ghp_Zq8RkT2mWv9LxC4nBd7EfHj3", "ghp_Aq1SwD2eFr3GtH4yJu5KiL6o"
    rows = [(1, f"use {live} now", "en", "a"), (2, f"again {live}", "en", "a"), (9, f"secret={live[4:]}", "en", "a")]
    rows += [(10 + i, f"see {shared} and token: {shared[4:]}", "en", f"s{i}") for i in range(5)]
    rows += [(20, "ghp_exampleexampleexample1234", "en", "a"), (21, "db at pg://me:Tr0ub4dor&3xyzq@host/x", "en", "b")]
    got = {r.doc_id: r for r in secrets.report(documents(spark, rows)).collect()}
    assert got[1].spans == "token:4:32" and got[1].n_live == 1
    assert got[9].spans == f"assign:0:{7 + len(live) - 4}" and got[9].n_live == 1
    for i in range(5):
        assert got[10 + i].spans.startswith("assign:") and "token:4" not in got[10 + i].spans and got[10 + i].n_example == 1
    assert got[20].spans == "" and got[21].spans.startswith("url:")


def test_wider_values_have_no_length_cap(spark):
    rng = random.Random(8)
    run = lambda n: "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdeghijkmnopqrstuvwxyz") for _ in range(n))
    body = lambda n: "\n".join(run(64) for _ in range(n))
    long = [
        ("token", f"ghp_{run(700)}"), ("web", f"eyJ{run(5000)}.{run(60)}.{run(43)}"), ("web", f"eyJ{run(60)}.{run(9000)}.{run(43)}"), ("web", f"eyJ{run(60)}.{run(60)}.{run(3000)}"),
        ("pem", f"-----BEGIN PRIVATE KEY-----\n{body(300)}\n-----END PRIVATE KEY-----"), ("url", f"pg://me:{run(500)}@"), ("url", f"pg://{run(200)}:{run(30)}@"), ("url", f"{run(40).lower()}://me:{run(30)}@"),
    ]
    got = {r.doc_id: r.spans for r in secrets.report(documents(spark, [(i, f"see {t} now") for i, (_, t) in enumerate(long)])).collect()}
    assert got == {i: f"{kind}:4:{4 + len(t)}" for i, (kind, t) in enumerate(long)}


def test_wider_patterns_are_linear_on_runs_without_a_match():
    for text in ("eyJaaaaaaaaa_" * 20_000, "eyJaaaaaaaaa." * 20_000, "a.b-" * 100_000 + "://", "ghp_" * 100_000, "-----BEGIN PRIVATE KEY-----" * 10_000):
        secrets.wide_spans(text, [(k, 0, len(text), "") for k in ("hex",)])


def test_counts_are_distinct_repositories_and_owners(spark):
    value = "secret=Qw3rTy7UiOp9"
    rows = [(i, value, lang, source) for i, (lang, source) in enumerate([("en", "a"), ("de", "a"), ("en", "a"), ("en", "b"), ("en", None), (None, None)])]
    found = secrets.scan(documents(spark, rows), repository=F.concat("source", "lang"), owner="source").collect()
    assert {(r.spans[0].repositories, r.spans[0].owners) for r in found} == {(4, 3)}


def test_empty_and_clashing_columns(spark):
    assert secrets.report(documents(spark, [])).count() == 0
    df = documents(spark, [(1, "password=hunter2222")]).withColumns({"row": F.lit(1), "spans": F.lit(2), "hash": F.lit(3), "owner": F.lit(4)})
    assert secrets.report(df).collect()[0].n_assign == 1


def test_candidates_meet_no_span_like_brute_force():
    rng = random.Random(4)
    parts = ["token=abcdef123456", "eyJ" + "a1" * 6 + ".eyJ" + "b2" * 6 + "." + "c3" * 6, "https://u:secret99@h.org", "ghp_" + "Zz9" * 8, "0" * 30, "plain", "sk_live_" + "x" * 20]
    for _ in range(60):
        text = "".join(rng.choice(parts) + rng.choice([" ", "", "="]) for _ in range(40))
        base = secrets.base_spans(text)
        want = []
        for kind, (signs, pattern) in secrets._WIDE.items():
            for m in pattern.finditer(text):
                if m[1] is not None and not any(a < m.end() and m.start() < b for _, a, b, _ in base + want):
                    want.append((kind, m.start(), m.end(), m[1]))
        assert secrets.wide_spans(text, base) == want
    many = " ".join(f"https://u{i}:secret{i}@h.org" for i in range(40_000))
    assert len(secrets.wide_spans(many, [])) == 40_000
