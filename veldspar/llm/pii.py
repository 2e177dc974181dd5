"""Personal data: base patterns, and further spans from boosted trees over overlapping candidates.

All DataFrame and SQL functions: patterns run in the JVM, offsets come from the lengths of the pieces
between matches, trees are nested CASE expressions.

* Base: email, ip, card and phone with their checks (see BASE); these spans always stay.
* Candidates: wider generators propose spans in other spellings ("name (at) host dot org", national
  phone numbers, spaced or defanged addresses, cards with unusual separators). They may overlap each
  other; one that overlaps a base span is dropped.
* Each candidate gets format features (digit groups, separators, check digits) and context features
  (words for and against its kind nearby). Boosted trees score it; a kind's threshold is calibrated on
  the held-out half of the training examples to a stated precision. Of overlapping survivors the
  highest score stays.

The trees are trained here, on examples generated by rule (``examples``); a fixed number of them,
whatever the corpus, so the model neither depends on nor copies anyone's personal data.

Scale: one narrow pass, no shuffle, no state. Patterns use possessive or bounded repetition, so one
match costs time in proportion to its length and no recursion, however long a text is. A pattern runs
only on texts that have the character it needs.

Defined results: null text is an empty text (no spans); repeated rows give repeated output rows; null
doc_id stays null; an empty table gives an empty result; ``detect`` reads doc_id and text alone, so other
columns may have any name; candidates of equal score go by place; very long texts are scanned whole; ``redact`` keeps every column and its order.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.functions.shared import fresh, settled
from veldspar.functions.spans import matches
from veldspar.llm import gbdt

KINDS = ("email", "ip", "card", "phone")

#: kind -> (test that a text must pass before the pattern runs, pattern, test of a match m).
#: Look-behinds stand for "leftmost": a match can only begin where a run of its characters begins
#: or, for email, where the last match ended.
BASE = {
    "email": (
        "contains({t}, '@')",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "true",
    ),
    "ip": (
        r"{t} rlike r'[0-9]\.[0-9]++\.[0-9]'",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"forall(split({m}, r'\.'), o -> char_length(trim(leading '0' from o)) <= 3 and cast(concat('0', right(o, 3)) as int) <= 255)",
    ),
    "card": (
        "{t} rlike r'[0-9](?:[ -]?[0-9]){{12}}'",
        r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}(?![ -]?[0-9])",
        "luhn_check(regexp_replace({m}, '[ -]', ''))",
    ),
    "phone": (
        "contains({t}, '+')",
        r"\+[0-9][ ().0-9-]+[0-9]",
        "char_length(regexp_replace({m}, '[^0-9]', '')) between 9 and 15",
    ),
}

#: kind -> (test, pattern) of the wider generators. Their bounds are those of the formats: an address has at most 64
#: characters before the at and 127 labels of 63 after it, an octet three digits, a card 19, a phone number five groups. The pattern implies the test: every match contains one of the test's.
WIDE = {
    "email": (
        "{t} rlike r'(?i)@|[(\\[{{] ?at ?[)\\]}}]| at [A-Z0-9-]{{1,63}}+ ?(?:[(\\[{{]| dot )'",
        r"(?i)(?<![A-Z0-9._%+-])[A-Z0-9._%+-]{1,64}+ ?(?:@|[(\[{] ?at ?[)\]}]| at (?=[A-Z0-9-]{1,63} ?(?:[(\[{]| dot ))) ?[A-Z0-9-]{1,63}+(?: ?(?:\.|[(\[{] ?dot ?[)\]}]|(?<= )dot(?= )) ?[A-Z0-9-]{1,63}+){1,126}+",
    ),
    "ip": (
        r"{t} rlike r'[0-9] ?[(\[{{]?(?:\.|dot)[)\]}}]? ?[0-9]'",
        r"(?<![0-9.])[0-9]{1,3}(?: ?[(\[{]?(?:\.|dot)[)\]}]? ?[0-9]{1,3}){3}(?![0-9.])",
    ),
    "card": (
        "{t} rlike r'[0-9](?:[ ./_-]{{0,2}}[0-9]){{12}}'",
        r"(?<![0-9])[0-9](?:[ ./_-]{0,2}[0-9]){12,18}(?![ ./_-]{0,2}[0-9])",
    ),
    "phone": (
        r"{t} rlike r'[0-9]{{2}}[ ()./-]{{0,3}}[0-9]{{2}}'",
        r"(?<![0-9A-Za-z+])(?:\(0?[0-9]{2,4}\)|00[0-9]{1,3}|0[0-9]{1,4}|[0-9]{3})(?:[ ./-]{1,2}[0-9]{2,8}){1,5}(?![0-9])",
    ),
}

#: Words that speak for each kind, and words that speak against all of them.
FOR = {
    "email": "mail|contact|write|reach|address|inbox",
    "ip": "ip|server|host|address|network|login|client",
    "card": "card|visa|master|amex|credit|debit|pay",
    "phone": "phone|tel|call|mobile|fax|ring|sms|whatsapp|cell",
}
AGAINST = "order|invoice|version|ref|isbn|part|release|section|chapter|page|price|total|date|figure|serial|build|ratio|score"

SPAN = "struct<kind:string,start:int,end:int,m:string>"
FEATURES = ["kind", "digits", "letters", "marks", "spaces", "size", "zero", "round", "luhn", "octets", "tail", "parts", "own_word", "other_word", "glued", "spelled"]
#: Share of true spans among those that pass, on held-out examples.
PRECISION = 0.98
EXAMPLES = 4000


def _found(t: str, kind: str, test: str, pattern: str) -> str:
    """SQL of the array of matches with their places, in code points."""
    return f"transform({matches(t, pattern, test.format(t=t))}, s -> named_struct('kind', '{kind}', 'start', s.start, 'end', s.end, 'm', s.m))"


def _base(t: str) -> str:
    parts = []
    for kind, (test, pattern, valid) in BASE.items():
        parts.append(f"filter({_found(t, kind, test, pattern)}, s -> {valid.format(m='s.m')})")
    return f"concat({', '.join(parts)})"


def _candidates(t: str, base: str) -> str:
    parts = [_found(t, kind, test, pattern) for kind, (test, pattern) in WIDE.items()]
    return f"filter(concat({', '.join(parts)}), c -> not exists({base}, b -> b.start < c.end and c.start < b.end))"


def _features(t: str, c: str = "c") -> str:
    """SQL of the struct of features of candidate ``c`` in text ``t``."""
    left = f"lower(substring({t}, greatest({c}.start - 32, 0) + 1, least({c}.start, 32)))"
    right = f"lower(substring({t}, {c}.end + 1, 16))"
    digits = f"regexp_replace({c}.m, '[^0-9]', '')"
    own = " ".join(f"when '{k}' then concat({left}, ' ~ ', {right}) rlike '{w}'" for k, w in FOR.items())
    parts = {
        "kind": f"array_position(array({', '.join(map(repr, KINDS))}), {c}.kind)",
        "digits": f"char_length({digits})",
        "letters": f"char_length(regexp_replace({c}.m, '[^A-Za-z]', ''))",
        "marks": f"char_length(regexp_replace({c}.m, '[A-Za-z0-9 ]', ''))",
        "spaces": f"char_length(regexp_replace({c}.m, '[^ ]', ''))",
        "size": f"char_length({c}.m)",
        "zero": f"int({c}.m rlike '^[(]?0')",
        "round": f"int(contains({c}.m, '(') or contains({c}.m, '['))",
        "luhn": f"int(char_length({digits}) between 13 and 19 and coalesce(luhn_check({digits}), false))",
        "octets": f"int(size(regexp_extract_all({c}.m, '[0-9]+', 0)) = 4 and forall(regexp_extract_all({c}.m, '[0-9]+', 0), o -> char_length(o) <= 3 and cast(o as int) <= 255))",
        "tail": f"char_length(regexp_extract({c}.m, '([A-Za-z]*)$', 1))",
        "parts": f"size(regexp_extract_all({c}.m, '[0-9]+', 0))",
        "own_word": f"int(case {c}.kind {own} end)",
        "other_word": f"int(concat({left}, ' ~ ', {right}) rlike '{AGAINST}')",
        "glued": f"int({left} rlike '[a-z0-9#/_-]$' or {right} rlike '^[a-z0-9/_]')",
        "spelled": f"int(lower({c}.m) rlike '[({{ \\\\[](?:at|dot)[)}} \\\\]]')",
    }
    return "named_struct(" + ", ".join(f"'{k}', cast({parts[k]} as double)" for k in FEATURES) + ")"


def examples(n: int = EXAMPLES, seed: int = 11) -> list[tuple[str, int]]:
    """Labelled texts: 1 if the odd-looking string in it is personal data of the kind it looks like."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    w = lambda: "".join(rng.choice("bcdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    prose = lambda k: " ".join(w() for _ in range(k))

    def card() -> str:
        body = rng.choice("3456") + d(14)
        total = sum(x if i % 2 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, body)))
        return body + str(-total % 10)

    def split(s: str, size: int, sep: str) -> str:
        return sep.join(s[i : i + size] for i in range(0, len(s), size))

    def email() -> str:
        at, dot = rng.choice([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), (" @ ", "."), ("(at)", ".")])
        return f"{w()}{rng.choice(['', '.', '_'])}{w()}{at}{w()}{dot}{rng.choice(['com', 'org', 'net', 'de', 'fr'])}"

    octet = lambda: str(rng.randint(0, 255))
    ip = lambda: rng.choice(["[.]", "(.)", " . ", "[dot]"]).join(octet() for _ in range(4))
    phone = lambda: rng.choice([f"0{d(3)} {d(3)} {d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(2)}/{d(3)} {d(2)} {d(2)}", f"00{d(2)} {d(3)} {d(6)}"])
    odd_card = lambda: split(card(), 4, rng.choice([".", "/", "  ", "_", " - "[:2]]))
    yes = {
        "email": (email, ["email", "e-mail me:", "contact", "write to", "reach us"]),
        "ip": (ip, ["ip", "server", "host", "login from", "client address"]),
        "card": (odd_card, ["card", "visa", "credit card number", "paid by card", "mastercard:"]),
        "phone": (phone, ["phone", "tel.", "call", "mobile:", "fax", "my cell is"]),
    }
    no = [
        lambda: (rng.choice(["order", "invoice", "ref", "part", "serial"]), f"{d(3)}-{d(3)}-{d(4)}"),
        lambda: (rng.choice(["order", "invoice", "serial"]), split(d(16), 4, rng.choice([".", "/", "  ", "_"]))),
        lambda: ("isbn", f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}"),
        lambda: (rng.choice(["version", "release", "section"]), ".".join(str(rng.randint(0, 40)) for _ in range(4)).replace(".", rng.choice([" . ", "[.]"]))),
        lambda: (rng.choice(["date", "on", prose(1)]), f"{d(4)}-{d(2)}-{d(2)}"),
        lambda: (prose(2), f"{d(3)} {d(3)}"),
        lambda: (prose(2), f"{d(3)} {d(3)} {d(3)}"),
        lambda: (prose(2), f"{d(3)}-{d(3)}-{d(4)}"),
        lambda: (prose(1), f"{w()} at {w()} dot {w()}"),
        lambda: (prose(1), f"{w()} @ {w()}.{w()}"),
        lambda: (rng.choice(["score", "ratio", "total", "price"]), f"{d(3)}.{d(3)}.{d(3)}"),
        lambda: (prose(2), split(d(rng.randint(13, 18)), rng.choice([3, 4, 5]), rng.choice([".", "/", "  ", "_"]))),
        lambda: (prose(2), rng.choice(["[.]", " . "]).join(str(rng.randint(0, 999)) for _ in range(4))),
    ]
    out = []
    for i in range(n):
        if i % 2:
            make, words = yes[rng.choice(KINDS)]
            bare = rng.random() < 0.1
            out.append((f"{prose(rng.randint(3, 8))} {prose(2) if bare else rng.choice(words)} {make()} {prose(rng.randint(3, 8))}", 0 if bare else 1))
        else:
            word, text = rng.choice(no)()
            out.append((f"{prose(rng.randint(3, 8))} {word} {text} {prose(rng.randint(3, 8))}", 0))
    return out


def train(spark: SparkSession, n: int = EXAMPLES, precision: float = PRECISION) -> tuple[gbdt.Trees, tuple[float, ...]]:
    """Trees, and the margin that each kind must reach. The rows collected are the candidates of ``n`` short examples."""
    made = spark.createDataFrame(examples(n), "t string, y int")
    each = made.selectExpr("y", "t", f"{_base('t')} as b").selectExpr("y", "t", f"explode({_candidates('t', 'b')}) as c")
    rows = each.selectExpr("y", f"{_features('t')} as f", "c.kind as kind", "hash(t) % 2 as half").select("y", "f.*", "half").collect()
    x = np.array([r[1:-1] for r in rows], float).reshape(-1, len(FEATURES))
    y = np.array([r[0] for r in rows], float)
    held = np.array([r[-1] != 0 for r in rows], bool)
    trees = gbdt.fit(x[~held], y[~held], rounds=24, depth=3, rate=0.4, bins=32)
    margin = trees.margin(x[held])
    cuts = []
    for kind in range(1, len(KINDS) + 1):
        mine = x[held][:, 0] == kind
        best = np.inf
        order = np.argsort(-margin[mine], kind="stable")
        truth, score = y[held][mine][order], margin[mine][order]
        share = np.cumsum(truth) / np.arange(1, len(truth) + 1)
        ends = np.flatnonzero(np.append(score[1:] != score[:-1], True)) if len(score) else []
        for at in ends:
            if share[at] >= precision and score[at] > 0:
                best = score[at]
        cuts.append(float(best))
    return trees, tuple(cuts)


#: Trained models; the examples and so the trees are the same in every session.
_MODELS: dict[tuple[int, float], tuple[gbdt.Trees, tuple[float, ...]]] = {}


def model(spark: SparkSession, n: int = EXAMPLES, precision: float = PRECISION) -> tuple[gbdt.Trees, tuple[float, ...]]:
    if (n, precision) not in _MODELS:
        _MODELS[n, precision] = train(spark, n, precision)
    return _MODELS[n, precision]


def _added(t: str, base: str, trees: gbdt.Trees, cuts: tuple[float, ...]) -> str:
    """SQL of the candidates that pass their kind's threshold, the best of those that overlap."""
    score = trees.sql([f"f.f.{n}" for n in FEATURES])
    pick = " ".join(f"when '{k}' then {c if np.isfinite(c) else 1e9:.6f}D" for k, c in zip(KINDS, cuts))
    scored = f"transform(transform({_candidates(t, base)}, c -> named_struct('c', c, 'f', {_features(t)})), f -> named_struct('c', f.c, 's', {score}))"
    passed = f"filter({scored}, k -> k.s >= case k.c.kind {pick} end)"
    ranked = f"array_sort({passed}, (a, b) -> case when a.s > b.s then -1 when a.s < b.s then 1 when a.c.start < b.c.start then -1 when a.c.start > b.c.start then 1 else a.c.end - b.c.end end)"
    return f"""aggregate({ranked}, cast(array() as array<{SPAN}>),
        (a, k) -> case when exists(a, o -> o.start < k.c.end and k.c.start < o.end) then a else concat(a, array(k.c)) end)"""


def with_spans(docs: DataFrame, text: str, base: str, spans: str) -> DataFrame:
    """``docs`` with the array of base spans and the array of all spans, both by kind, then start."""
    trees, cuts = model(docs.sparkSession)
    (t,) = fresh(docs, "text")
    df = docs.withColumn(t, F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))
    df = df.withColumn(base, F.expr(_base(f"`{t}`")))
    kind = f"array_position(array({', '.join(map(repr, KINDS))}), {{}}.kind)"
    order = f"""(a, b) -> case when {kind.format('a')} <> {kind.format('b')} then int({kind.format('a')} - {kind.format('b')})
        when a.start <> b.start then a.start - b.start else a.end - b.end end"""
    added = _added(f"`{t}`", f"`{base}`", trees, cuts)
    # Texts without any digit pair, digits around a dot, @ or spelled-out "at" have no candidates of any kind.
    added = f"case when `{t}` rlike r'(?i)[0-9][^a-zA-Z]{{0,3}}[0-9]|[0-9] ?[(\\[{{]?(?:\\.|dot)[)\\]}}]? ?[0-9]|@|[(\\[{{ ]at[)\\]}} ]' then {added} else cast(array() as array<{SPAN}>) end"
    return settled(df.withColumn(spans, F.expr(f"array_sort(concat(`{base}`, {added}), {order})")).drop(t), spans)


def _written(column: str) -> str:
    return f"array_join(transform(`{column}`, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, the digest of the base spans, and all spans."""
    rows = with_spans(docs.select("doc_id", "text"), "text", "b", "s")
    counts = [f"cast(size(filter(b, s -> s.kind = '{k}')) as bigint) as n_{k}" for k in KINDS]
    return rows.selectExpr("doc_id", *counts, f"sha2({_written('b')}, 256) as base_sha256", f"{_written('s')} as spans")


def redact(docs: DataFrame, text: str = "text", size: str = "n_chars") -> DataFrame:
    """The same rows and columns; every span gives way to its kind in brackets, overlapping ones to one.

    ``size``, where the table has it, is set to the new length of a text that changed.
    """
    base, spans, new = fresh(docs, "base", "spans", "new")
    rows = with_spans(docs, text, base, spans)
    spliced = f"""aggregate(array_sort(`{spans}`, (a, b) -> case when a.start <> b.start then a.start - b.start else b.end - a.end end),
        named_struct('at', 0, 'out', cast(array() as array<string>)),
        (a, s) -> case when s.end <= a.at then a when s.start < a.at then named_struct('at', s.end, 'out', a.out)
          else named_struct('at', s.end, 'out', concat(a.out, array(substring(`{text}`, a.at + 1, s.start - a.at), concat('[', upper(s.kind), ']')))) end,
        a -> concat(array_join(a.out, ''), substring(`{text}`, a.at + 1)))"""
    rows = rows.withColumn(new, F.expr(f"case when size(`{spans}`) > 0 then {spliced} end"))
    out = []
    for c in docs.columns:
        if c == text:
            out.append(F.expr(f"coalesce(`{new}`, `{c}`)").alias(c))
        elif c == size:
            out.append(F.expr(f"case when `{new}` is null then `{c}` else char_length(`{new}`) end").cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return rows.select(*out)
