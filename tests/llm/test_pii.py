import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import ODD, documents
from veldspar.llm import gbdt, pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[ -]?[0-9])+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(digits)))) % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    return {"email": True, "ip": all(int(p) < 256 for p in m.split(".") if kind == "ip"), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]


def slow(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def row(doc, text):
    spans = slow(text)
    return (doc, *(sum(s[0] == k for s in spans) for k in PATTERNS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())


def messy(rng):
    piece = [
        lambda: rng.choice(["a@b.c", "x.y+z@d-e.fr.", "a@b..c@d.e", "@", "é@b.co", "q@r", "a@b.c%x@y.z", "u_1@h.de.x"]),
        lambda: ".".join(str(rng.choice([1, 0, 255, 256, 99, "007", 1234])) for _ in range(rng.randint(2, 9))),
        lambda: rng.choice(["", " ", "-"]).join(rng.choice(["4111", "1111", "0000", "37", "5"]) for _ in range(rng.randint(2, 6))),
        lambda: "4111 1111 1111 1111",
        lambda: "+" + "".join(rng.choice("0123456789 ().-") for _ in range(rng.randint(3, 18))),
        lambda: "+49 (30) 123-4567",
        lambda: rng.choice(["word", "é😀", "+", " ", "\n"]),
    ]
    return "".join(rng.choice(piece)() + rng.choice([" ", "", ", ", "\n", "😀"]) for _ in range(rng.randint(1, 12)))


def test_base_matches_brute_force(spark):
    rng = random.Random(4)
    rows = [*ODD, (50, "1 " * 20_000), (51, "7" * 30_000), (52, "a." * 20_000 + "@" + "b." * 20_000), (53, "+1" + "-2" * 20_000), (54, "1." * 20_000)]
    rows += [(100 + i, messy(rng)) for i in range(400)]
    out = pii.detect(documents(spark, rows)).collect()
    assert sorted((tuple(r)[:6] for r in out), key=str) == sorted((row(*r[:2]) for r in rows), key=str)
    texts = {r[0]: r[1] for r in rows}
    for r in out:  # base spans stay, in order, and every span lies in its text
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), *s[1:]))
        if r.doc_id is not None and texts[r.doc_id] is not None:
            assert set(slow(texts[r.doc_id])) <= set(spans)
            assert all(0 <= a < b <= len(texts[r.doc_id]) for _, a, b in spans)


def test_trees_add_other_spellings_and_leave_lookalikes(spark):
    rows = [
        (1, "kindly write to anna.berg (at) lumo (dot) org for more"),
        (2, "the mobile: 0171 555 2040 is best"),
        (3, "login from 10[.]4[.]7[.]19 was seen"),
        (10, "see order 555-204-1177 of the day"),
        (11, "isbn 978-3-1614-8410-0 and section 2 . 4 . 7 . 19"),
        (12, "they met at the inn and a dot was all"),
        (13, "on 2024-05-17 there were 312 410 of them"),
    ]
    got = {r.doc_id: r.spans for r in pii.detect(documents(spark, rows)).collect()}
    assert got[1].startswith("email:16:") and got[2] == "phone:12:25" and got[3] == "ip:11:26"
    assert not any(got[k] for k in (10, 11, 12, 13))


def test_every_match_of_a_wide_pattern_is_a_candidate(spark):
    """No test in front of a pattern depends on the rest of the text."""
    alone = [
        ("email", "contact jane.doe(at)example.org"), ("email", "jane [at] host.org"), ("email", "contact jane @example.org"),
        ("email", "jane at host dot org"), ("email", "jane ( at ) host . org"), ("email", "jane at host (dot) org"),
        ("ip", "host 1dot2dot3dot4"), ("ip", "host 1 [dot] 2 [dot] 3 [dot] 4"), ("phone", "call (030)--12"), ("phone", "call (030)- 12 now"),
    ]
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(alone)], "i int, t string")
    got = {r.i: set(r.k) for r in rows.selectExpr("i", f"transform({pii._candidates('t', pii._base('t'))}, c -> c.kind) as k").collect()}
    assert [(i, kind) for i, (kind, _) in enumerate(alone) if kind not in got[i]] == []


def test_spellings_of_the_examples_are_found_alone(spark):
    rows = [(1, "please contact jane.doe(at)example.org"), (2, "write to jane(at)host.org about it"), (3, "server 1dot2dot3dot4")]
    out = {r.doc_id: r.text for r in pii.redact(documents(spark, rows)).collect()}
    assert out[1] == "please contact [EMAIL]" and out[2] == "write to [EMAIL] about it" and out[3] == "server [IP]"


def test_thresholds_hold_their_precision_on_fresh_examples(spark):
    made = pii.examples(1500, seed=99)
    rows = [(i, t) for i, (t, _) in enumerate(made)]
    got = {r.doc_id: bool(r.spans) for r in pii.detect(documents(spark, rows)).collect()}
    hits = [made[i][1] for i, found in got.items() if found]
    assert np.mean(hits) > 0.95 and sum(hits) > 0.8 * sum(y for _, y in made)


def test_redaction(spark):
    df = documents(spark, [(1, "mail é@ a@b.co now"), (2, "card 4111 1111 1111 1111, ring +49 (30) 123-4567."), (3, None), (4, "plain"), (5, "+4111 1111 1111 111 1")])
    df = df.withColumns({"spans": F.lit(1), "new": F.lit("x")})
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    assert pii.redact(df).columns == df.columns
    assert out[1].text == "mail é@ [EMAIL] now" and out[1].n_chars == len(out[1].text)
    assert out[2].text == "card [CARD], ring [PHONE]."
    assert out[3].text is None and out[4].text == "plain" and out[4].n_chars == 5
    assert "1111" not in out[5].text
    assert pii.redact(documents(spark, [])).count() == 0 and pii.detect(documents(spark, [])).count() == 0


def test_boosting_learns_and_its_sql_equals_its_arrays(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    trees = gbdt.fit(x[:2000], y[:2000], rounds=30, depth=3)
    assert ((trees.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[2000:2100]], "a double, b double, c double, d double, e double")
    got = [r[0] for r in df.selectExpr(f"{trees.sql(list('abcde'))} as m").collect()]
    assert np.allclose(got, trees.margin(x[2000:2100]), atol=1e-3)
    empty = gbdt.fit(np.zeros((0, 3)), np.zeros(0))
    assert np.allclose(empty.probability(np.zeros((2, 3))), 0.5)
