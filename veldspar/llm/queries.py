"""The queries of this subpackage, by name, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.functions.shared import table
from veldspar.llm import masked, media, mixing, pieces, pii, quality, rules, secrets, simhash, substrings


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.rate(table(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"), repository=F.concat_ws("/", "source", "lang"), owner="source")


def op8_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.realised(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(table(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.roundtrip(table(spark, sf_dir, "documents"))


# ---- companions: the part of an operator's result that SQL can check -------------------------------


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op2_pii."""
    return op2_pii(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in pii.KINDS), "base_sha256")


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op7_secret_scan."""
    return op7_secret_scan(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in secrets.KINDS), "base_sha256")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload columns of op10_media_columns, read back from the stored images."""
    return op10_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def pieces_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that decoding gives back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.decode(pieces.encode(docs).drop("text")).select("doc_id", F.sha2("text", 256).alias("text_sha256"))


# ---- SQL -----------------------------------------------------------------------------------------

_WORD = r"[^\x20\x09-\x0D]"
_TEXTS = "t as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as x from documents)"


def _spans_sql(kinds: dict[str, tuple[str, str]], first: str) -> str:
    """Spans of each kind (pattern, test of a match m): their numbers and digest for each document.

    Offsets are sums of the lengths of matches and of the pieces between them.
    """
    found = " union all ".join(
        f"select r, '{k}' as kind, {i} as nth, generate_subscripts(ms, 1) as k, unnest(ms) as m, unnest(ps[:len(ms)]) as p from (select r, regexp_extract_all(x, '{pattern}') as ms, regexp_split_to_array(x, '{pattern}') as ps from t) where len(ms) > 0"
        for i, (k, (pattern, _)) in enumerate(kinds.items())
    )
    tests = " ".join(f"when '{k}' then {test}" for k, (_, test) in kinds.items())
    order = "nth, a" if first == "kind" else "a, nth"
    counts = ", ".join(f"cast(coalesce(count(*) filter (kind = '{k}'), 0) as bigint) as n_{k}" for k in kinds)
    return f"""with {_TEXTS}, found as ({found}),
 placed as (select *, sum(length(p)) over (partition by r, nth order by k) + coalesce(sum(length(m)) over (partition by r, nth order by k rows between unbounded preceding and 1 preceding), 0) as a from found),
 good as (select r, kind, nth, cast(a as bigint) as a, cast(a + length(m) as bigint) as z from placed where case kind {tests} end)
 select any_value(t.doc_id) as doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || a || ':' || z, ',' order by {order}), '')) as base_sha256 from t left join good using (r) group by r"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: case when (length({_DIGITS}) - i) % 2 = 0 then cast({_DIGITS}[i] as int) else (cast({_DIGITS}[i] as int) * 2) % 10 + (cast({_DIGITS}[i] as int) * 2) // 10 end)) % 10 = 0"
_PII = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_bool_and(list_transform(string_split(m, '.'), lambda o: length(ltrim(o, '0')) <= 3 and cast('0' || right(o, 3) as int) <= 255))"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({_DIGITS}) between 13 and 19 and {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) between 9 and 15"),
}
_EITHER = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""(?:{_EITHER})["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
_SECRETS = {
    "assign": (_ASSIGN, rf"""length(regexp_extract(m, '^(?:{_EITHER})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)) >= 6"""),
    "access": ("AKIA[A-Z0-9]+", "length(m) >= 20"),
    "hex": ("[0-9a-f]+", "length(m) >= 24"),
}


def _fences_sql(sketch: str, keys: str) -> str:
    """The number of documents and the list of fences of each sketch."""
    by = f"{keys}, " if keys else ""
    floors = ", ".join(map(str, rules.FLOORS.values()))
    tails = ", ".join(str(f * rules.TAIL[k]) for k, f in rules.FLOORS.items())
    quantiles = ", ".join(f"min(v) filter (upto * 100 >= whole * {x}) as q{x}" for x in (25, 50, 75, 90))
    return f"""(select {by}max(n) as n, list(q50 + {rules.SPREAD} * greatest(q75 - q25, least(q90 - q50, [{tails}][metric + 1]), [{floors}][metric + 1]) order by metric) as f from
  (select {by}metric, sum(n) as n, {quantiles} from (select *, sum(n) over (partition by {by}metric order by bin) as upto, sum(n) over (partition by {by}metric) as whole,
    case when metric = {len(rules.FLOORS) - 1} then exp(bin / {rules.LOGS}.0) else bin / {rules.SHARES}.0 end as v from {sketch}) group by {by}metric) {f'group by {keys}' if keys else ''})"""


def _rules_sql() -> str:
    count = lambda letters: f"length(x) - length(regexp_replace(x, '[{letters}]', '', 'g'))"
    metric = [f"cast({a} as double) / greatest({b}, 1)" for a, b in rules.PARTS.values()]
    bins = ", ".join(f"{{'metric': {i}, 'bin': floor({f'ln({v}) * {rules.LOGS}' if k == 'word_length' else f'{v} * {rules.SHARES}'})}}" for i, (k, v) in enumerate(zip(rules.PARTS, metric)))
    towards = lambda n, a, b: f"list_transform(list_zip({a}, {b}), lambda p: ({n} * p[1] + {rules.PRIOR} * p[2]) / ({n} + {rules.PRIOR}))"
    within = " and ".join(f"{v} <= fences[{i + 1}]" for i, v in enumerate(metric))
    return rf"""with {_TEXTS},
 w as (select *, regexp_extract_all(x, '{_WORD}+') as ws, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) as ls from t),
 windows as (select r, i, array_to_string(ws[i:i + 7], ' ') as s from (select r, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)),
 twice as (select r, i from (select r, i, count(*) over (partition by r, s) as n from windows) where n > 1),
 covered as (select r, sum(least(8, after - i)) as n_repeat_words from (select r, i, coalesce(lead(i) over (partition by r order by i), i + 8) as after from twice) group by r),
 c as (select doc_id, lang, source, len(ws) as n_words, coalesce(list_sum(list_transform(ws, lambda v: length(v))), 0) as word_chars, {count('#*$%&|<>')} as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
   coalesce(n_repeat_words, 0) as n_repeat_words, {count('A-ZÀ-ÖØ-Þ')} as n_upper, {count(r'!?|#*$%&<>{}\[\]=~^\\')} as n_marks, len(ls) as n_lines from w left join covered using (r)),
 b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from c),
 own as (select lang, source, s.metric as metric, s.bin as bin, count(*) as n from (select lang, source, unnest([{bins}]) as s from b where not base_failed) group by all),
 of_lang as (select lang, metric, bin, sum(n) as n from own group by all), corpus as (select metric, bin, sum(n) as n from of_lang group by all),
 whole as {_fences_sql('corpus', '')}, wide as (select l.lang, {towards('l.n', 'l.f', 'whole.f')} as f from {_fences_sql('of_lang', 'lang')} l, whole),
 groups as (select g.lang, g.source, {towards('g.n', 'g.f', 'wide.f')} as fences from {_fences_sql('own', 'lang, source')} g join wide on g.lang is not distinct from wide.lang)
 select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  base_failed, not base_failed and coalesce({within}, true) as kept from b left join groups on b.lang is not distinct from groups.lang and b.source is not distinct from groups.source"""


#: Strings of 50 bytes as hex digits; pieces of 256 starts keep each substring call short.
_SUBSTRINGS = """with d as (select row_number() over () as r, coalesce(doc_id, 9223372036854775807) as id, doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
 p as (select r, id, 256 * k as o, substr(h, 512 * k + 1, 610) as p from (select r, id, h, unnest(range(0, (n + 206) // 256)) as k from d where n >= 50)),
 s as (select r, id, o + i as i, substr(p, 2 * i + 1, 100) as s from (select r, id, o, p, unnest(range(0, length(p) // 2 - 49)) as i from p)),
 first as (select s, min(id) as low from s group by s having count(distinct id) > 1),
 hit as (select s.r, s.i from s join first using (s) where s.id > first.low),
 runs as (select r, i, sum(new) over (partition by r order by i) as k from (select r, i, case when i <= lag(i) over (partition by r order by i) + 50 then 0 else 1 end as new from hit)),
 cut as (select r, list({'a': a, 'z': z} order by a) as c from (select r, min(i) as a, max(i) + 50 as z from runs group by r, k) group by r),
 kept as (select doc_id, n, h, coalesce(c, []) as c from d left join cut using (r))
 select doc_id, cast(n as bigint) as n_bytes, cast(coalesce(list_sum(list_transform(c, lambda x: x.z - x.a)), 0) as bigint) as n_removed, cast(len(c) as bigint) as n_spans,
  sha256(unhex(array_to_string(list_transform(range(0, len(c) + 1), lambda k: substr(h, cast(2 * (case when k = 0 then 0 else c[k].z end) + 1 as bigint),
   cast(2 * ((case when k = len(c) then n else c[k + 1].a end) - (case when k = 0 then 0 else c[k].z end)) as bigint))), ''))) as kept_sha256 from kept"""

_PAYLOADS = f"""select doc_id, cast(n as bigint) as n_bytes, cast(size as bigint) as payload_bytes, sha256(x || repeat(' ', cast(size - n as bigint))) as payload_sha256 from
 (select *, greatest(1, (n + {media.ROW - 1}) // {media.ROW}) * {media.ROW} as size from (select doc_id, coalesce(text, '') as x, octet_length(encode(coalesce(text, ''))) as n from documents))"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [f for name, f in globals().items() if name.startswith("op") and callable(f)]
    out = {f.__name__: f for f in sorted(found, key=lambda f: int(f.__name__[2:].split("_")[0]))}
    return out | {f.__name__: f for f in (pii_base_spans, secret_base_spans, media_payloads, pieces_roundtrip)}


def oracle_sql() -> dict[str, str]:
    """Scores, majority bits, pieces, permutations and compressed forms have no SQL; tests/llm compares those with brute force."""
    return {
        "op5_quality_rules": _rules_sql(),
        "op9_substring_dedup": _SUBSTRINGS,
        "pii_base_spans": _spans_sql(_PII, "kind"),
        "secret_base_spans": _spans_sql(_SECRETS, "start"),
        "media_payloads": _PAYLOADS,
        "pieces_roundtrip": "select doc_id, sha256(coalesce(text, '')) as text_sha256 from documents",
    }
