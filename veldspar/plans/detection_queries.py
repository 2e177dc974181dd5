"""Queries of detectors, policy, entities and signatures, with SQL.

Texts are made from the rows' own keys by expressions that Spark and the checking SQL both read (``k`` is
the key), so the SQL says what must be found, where, and with which confidence.
"""

from __future__ import annotations

import json
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.data import identifiers, names, phones, places
from veldspar.functions import checks, crypto, similarity
from veldspar.functions.shared import spread, table
from veldspar.operators import detectors, entities, policy, requests
from veldspar.plans.registered import query

_CUSTOMERS = "(select c_custkey as k from customer)"
_SUPPLIERS = "(select s_suppkey as k from supplier)"


def _keys(spark: SparkSession, d: str, name: str, key: str) -> DataFrame:
    return table(spark, d, name).select(F.col(key).alias("k"))


def _pad(n: int, fill: str = "1") -> str:
    return f"lpad(cast(k as string), {n}, '{fill}')"


def _list(values: list[str], sql: bool) -> str:
    quoted = ", ".join("'" + v.replace("'", "''" if sql else "\\'") + "'" for v in values)
    return f"[{quoted}]" if sql else f"array({quoted})"


# ---- identifiers ---------------------------------------------------------------------------------


class _Sample(NamedTuple):
    package: str
    found: str
    value: str
    near: bool = False


#: A value of each format, which no earlier format of its package claims, and the format that must claim it.
SAMPLES = [
    _Sample("ng", "NG_RC", f"concat('RC', {_pad(7)})"), _Sample("ng", "NG_DRIVERS", f"concat('ABC-', {_pad(11, '5')})"), _Sample("ng", "NG_PVC", f"concat('12ABCDEF', {_pad(11, '3')})"),
    _Sample("ng", "NG_BVN", f"concat('22', {_pad(9, '4')})"), _Sample("ng", "NG_TIN", f"concat({_pad(10, '6')}, '-0001')"), _Sample("ng", "NG_NIN", _pad(11, "7")),
    _Sample("ke", "KE_KRA_PIN", f"concat('A', {_pad(9, '2')}, 'Z')"), _Sample("ke", "KE_NHIF", _pad(9, "3")), _Sample("ke", "KE_ID", _pad(7, "3")),
    _Sample("za", "ZA_ID", "concat('800101', '5009087', left('', cast(k % 1 as int)))"), _Sample("za", "ZA_PASSPORT", f"concat('A', {_pad(8, '4')})"), _Sample("za", "ZA_TAX_REF", f"concat('0', {_pad(9, '5')})"),
    _Sample("gh", "GH_CARD", f"concat('GHA-', {_pad(9, '0')}, '-1')"), _Sample("gh", "GH_TIN", f"concat('P', {_pad(10, '3')})"), _Sample("gh", "GH_SSNIT", f"concat('D', {_pad(12, '4')})"),
    _Sample("africa", "UG_NIN", f"concat('CM', {_pad(12, '6')})"), _Sample("africa", "ET_KEBELE", f"concat('ET-ABC-', {_pad(6, '1')})"), _Sample("africa", "AO_BI", f"concat({_pad(9, '6')}, 'LA1')"),
    _Sample("africa", "MZ_BI", f"concat({_pad(12, '6')}, 'A')"), _Sample("africa", "CI_CNI", f"concat('C', {_pad(9, '7')})"), _Sample("africa", "MA_CNIE", f"concat('AB', {_pad(6, '8')})"),
    _Sample("africa", "TZ_NIDA", _pad(20, "3")), _Sample("africa", "RW_NID", f"concat('11980', {_pad(11, '2')})"), _Sample("africa", "EG_NID", f"concat('290010112', {_pad(5, '3')})"),
    _Sample("africa", "SN_CNI", f"concat('1', {_pad(12, '9')})"), _Sample("africa", "KE_NHIF", _pad(9, "8")), _Sample("africa", "KE_ID", _pad(7, "4")), _Sample("africa", "KE_ID", _pad(7, "5"), True),
    _Sample("africa", "GH_CARD", f"concat('GHA-', {_pad(9, '0')}, '-2')"), _Sample("africa", "ZA_TAX_REF", f"concat('0', {_pad(9, '5')})"),
]


def _identifiers_sql() -> str:
    rows = []
    for s in SAMPLES:
        f = identifiers.FORMATS[s.found]
        sure = min(1.0, f.confidence + (identifiers.BONUS if f.valid else 0) + (identifiers.CONTEXT_BONUS if s.near else 0))
        start = len("kenya ref " if s.near else "ref ")
        rows.append(f"select k, '{s.package}' as package, 'PII-2-{f.id_type}' as category, '{f.country}' as country, {s.value} as value, {start} as \"start\", cast({round(sure, 4)} as double) as confidence from {_CUSTOMERS}")
    return " union all ".join(rows)


@query(_identifiers_sql())
def identifier_formats(spark: SparkSession, d: str) -> DataFrame:
    """Every identifier format by its country's package or that of all countries."""
    keys, out = spread(_keys(spark, d, "customer", "c_custkey")), None
    for package in ("ng", "ke", "za", "gh", "africa"):
        texts = ", ".join(f"concat('{'kenya ref ' if s.near else 'ref '}', {s.value}, ' end')" for s in SAMPLES if s.package == package)
        df = keys.select("k", F.explode(F.expr(f"array({texts})")).alias("text"))
        found = detectors.detect(df, packages=[package]).select("k", F.lit(package).alias("package"), F.explode("detections").alias("s"))
        found = found.select("k", "package", "s.category", "s.country", F.col("s.text").alias("value"), "s.start", "s.confidence")
        out = found if out is None else out.unionByName(found)
    return out


_ROUTES = {"NG": "BVN", "KE": None, "ZA": None, "GH": None, "TZ": "BVN"}


@query(" union all ".join(f"select k, '{j}' as jurisdiction, 'PII-2-{found}' as category from {_CUSTOMERS}" for j, found in _ROUTES.items() if found))
def detector_routing(spark: SparkSession, d: str) -> DataFrame:
    """The packages of a jurisdiction: one country's own, or those of all countries."""
    df, out = _keys(spark, d, "customer", "c_custkey").select("k", F.expr(f"concat('no. 22', {_pad(9, '4')})").alias("text")), None
    for j in _ROUTES:
        own = [p for p in detectors.default_packages(j) if p in identifiers.ORDER]
        found = detectors.detect(df, jurisdiction=j, packages=own).select("k", F.lit(j).alias("jurisdiction"), F.explode("detections.category").alias("category"))
        out = found if out is None else out.unionByName(found)
    return out


@query(f"""select k, concat('29001011234', {_pad(3, '0')}) as egypt, '1990-01-01' as date_of_birth, '12' as governorate, concat('1', cast(1890 + k % 160 as string), {_pad(11, '2')}) as rwanda, 1890 + k % 160 between 1900 and 2030 as valid
 from {_CUSTOMERS}""".replace("{_pad(3, '0')}", ""))
def egypt_rwanda_decode(spark: SparkSession, d: str) -> DataFrame:
    df = _keys(spark, d, "customer", "c_custkey").select("k", F.expr(f"concat('29001011234', {_pad(3, '0')})").alias("egypt"), F.expr(f"concat('1', cast(1890 + k % 160 as string), {_pad(11, '2')})").alias("rwanda"))
    df = df.withColumn("e", F.expr(checks.egypt_sql("egypt")))
    return df.select("k", "egypt", "e.date_of_birth", F.col("e.governorate_code").alias("governorate"), "rwanda", F.expr(checks.rwanda_sql("rwanda")).alias("valid"))


# ---- phones --------------------------------------------------------------------------------------


def _numbers() -> list[tuple[str, str]]:
    """Country and the SQL of a number of its first and its last prefix, from the calling code on."""
    out = []
    for country, (code, _, after, _) in phones.PLANS.items():
        for prefix in {phones.prefixes(country)[0], phones.prefixes(country)[-1]}:
            head = prefix.lstrip("0") if phones.dialled_with_zero(country) else prefix
            out.append((country, f"concat('{code}{head}', {_pad(after - len(head), '4')})"))
    return out


@query(" union all ".join(f"select k, '{c}' as country, concat('+', {n}) as international, 5 as \"start\", 6 + length({n}) as \"end\" from {_SUPPLIERS}" for c, n in _numbers()))
def phone_plans(spark: SparkSession, d: str) -> DataFrame:
    """Mobile numbers of all 31 countries."""
    texts = ", ".join(f"concat('call +', {n}, ' now')" for _, n in _numbers())
    df = _keys(spark, d, "supplier", "s_suppkey").select("k", F.explode(F.expr(f"array({texts})")).alias("text"))
    found = detectors.detect(df, packages=["core"]).select("k", F.explode("detections").alias("s"))
    return found.select("k", "s.country", F.col("s.metadata")["international"].alias("international"), "s.start", F.col("s.end").cast("bigint").alias("end"))


@query(f"select k, concat('0803', {_pad(7, '2')}) as first, cast(2 as bigint) as mentions, cast(1 as bigint) as numbers from {_CUSTOMERS}")
def repeated_phones(spark: SparkSession, d: str) -> DataFrame:
    """A number is reported once a document, in whatever form it comes again, unless repeats are asked for."""
    df = _keys(spark, d, "customer", "c_custkey").select("k", F.expr(f"concat('0803', {_pad(7, '2')}, ' or +234 803 ', {_pad(7, '2')})").alias("text"))
    df = df.select("k", F.expr(detectors.phone_sql("text")).alias("once"), F.expr(detectors.phone_sql("text", repeats=True)).alias("every"))
    return df.select("k", F.col("once")[0]["text"].alias("first"), F.size("every").cast("bigint").alias("mentions"), F.size("once").cast("bigint").alias("numbers"))


# ---- addresses of networks, wallets, lexicons ------------------------------------------------------


@query(f"""select k, concat('2001:db8::', lower(hex(k + 1))) as address, 5 as "start", cast(15 + length(hex(k + 1)) as bigint) as "end", 'true' as private, 'false' as loopback from {_CUSTOMERS}
 union all select k, '::1', cast(20 + length(hex(k + 1)) as int), cast(23 + length(hex(k + 1)) as bigint), 'true', 'true' from {_CUSTOMERS}""")
def ipv6_addresses(spark: SparkSession, d: str) -> DataFrame:
    df = _keys(spark, d, "customer", "c_custkey").select("k", F.expr("concat('host 2001:db8::', lower(hex(k + 1)), ' and ::1 at 10:30:45')").alias("text"))
    found = detectors.detect(df, packages=["ip"]).select("k", F.explode("detections").alias("s"))
    return found.select("k", F.col("s.text").alias("address"), "s.start", F.col("s.end").cast("bigint").alias("end"), F.col("s.metadata")["private"].alias("private"), F.col("s.metadata")["loopback"].alias("loopback"))


_BASE58 = f"translate({_pad(29)}, '0', 'x')"


@query(f"""select k, concat('1', {_BASE58}) as wallet, 'P2PKH' as kind, cast(0.85 as double) as confidence from {_CUSTOMERS} union all select k, concat('3', {_BASE58}), 'P2SH', 0.85 from {_CUSTOMERS}
 union all select k, concat('bc1q', {_pad(20, 'q')}), 'SegWit', 0.9 from {_CUSTOMERS} union all select k, concat('tb1q', {_pad(20, 'z')}), 'SegWit', 0.9 from {_CUSTOMERS}""")
def bitcoin_wallets(spark: SparkSession, d: str) -> DataFrame:
    df = _keys(spark, d, "customer", "c_custkey").select("k", F.expr(f"concat('to 1', {_BASE58}, ', 3', {_BASE58}, ', bc1q', {_pad(20, 'q')}, ' or tb1q', {_pad(20, 'z')})").alias("text"))
    found = df.select("k", F.explode(F.expr(detectors.wallet_sql("text"))).alias("s"))
    return found.select("k", F.col("s.text").alias("wallet"), F.col("s.metadata")["address_type"].alias("kind"), "s.confidence")


def _city_names() -> list[tuple[str, tuple]]:
    known: dict[str, tuple] = {}
    for city in places.cities():
        known[city[0]] = city
        for other in city[6]:
            if not any(other.lower() == c[0].lower() for c in places.cities()):
                known.setdefault(other, city)
    return list(known.items())


_CITY = _city_names()
_AT = f"cast(k % {len(_CITY)} as int)"


@query(f"select k, {_list([n for n, _ in _CITY], True)}[{_AT} + 1] as name, {_list([c[0] for _, c in _CITY], True)}[{_AT} + 1] as canonical, {_list([c[1] for _, c in _CITY], True)}[{_AT} + 1] as country, {_list([c[3] for _, c in _CITY], True)}[{_AT} + 1] as region from {_CUSTOMERS}")
def gazetteer_names(spark: SparkSession, d: str) -> DataFrame:
    """Every city of the gazetteer by every one of its names."""
    df = _keys(spark, d, "customer", "c_custkey").select("k", F.expr(f"concat('moved to ', {_list([n for n, _ in _CITY], False)}[{_AT}], ', at last')").alias("text"))
    found = df.select("k", F.explode(F.expr(detectors.location_sql("text"))).alias("s"))
    return found.select("k", F.col("s.text").alias("name"), F.col("s.metadata")["canonical_name"].alias("canonical"), "s.country", F.col("s.metadata")["region"].alias("region"))


_LEXICON = sorted({n for g in names.GROUPS for n in g if len(n) >= 3 and n.isascii() and n.isalpha()})
_NTH = f"cast(k % {len(_LEXICON)} as int)"


@query(f"select k, {_list(_LEXICON, True)}[{_NTH} + 1] as name, 'PII-1-NAME' as category, 5 as \"start\" from {_CUSTOMERS}")
def lexicon_names(spark: SparkSession, d: str) -> DataFrame:
    """Every name of the built-in groups."""
    df = _keys(spark, d, "customer", "c_custkey").select("k", F.expr(f"concat('here ', {_list(_LEXICON, False)}[{_NTH}], ' signed')").alias("text"))
    found = df.select("k", F.explode(F.expr(detectors.name_sql("text"))).alias("s"))
    return found.select("k", F.col("s.text").alias("name"), "s.category", "s.start")


# ---- policy --------------------------------------------------------------------------------------

_LAW = policy.load("NDPA-2023")
_MAPPED = sorted((c, m[0]) for c, m in _LAW.mappings.items())
_LABEL = "list_extract(string_split(category, '-'), -1)"


@query(f"""with c as (select * from (values {', '.join(f"('{c}', '{a}')" for c, a in _MAPPED)}) v(category, action)), s as (select k, category, action, {_LABEL} as label from {_SUPPLIERS}, c),
 o as (select *, case action when 'mask' then '[' || label || ']' when 'drop' then '' when 'tokenize' then label || '_#' when 'generalize' then '[' || label || ']' else 'v' || k end as applied from s)
 select k, category, action, applied, 'id ' || applied || ' end' as redacted from o""")
def policy_actions(spark: SparkSession, d: str) -> DataFrame:
    """Mask, tokenize, drop, generalize, retain and audit by every mapping of a statute; the eight hexadecimal digits of a token are left out."""
    made = ", ".join(f"'{c}'" for c, _ in _MAPPED)
    df = _keys(spark, d, "supplier", "s_suppkey").select("k", F.explode(F.expr(f"array({made})")).alias("category"), F.expr("concat('id v', k, ' end')").alias("text"))
    span = """array(named_struct('category', category, 'text', concat('v', k), 'start', 3, 'end', 4 + char_length(cast(k as string)), 'confidence', 0.9D, 'detector', 'rule:x', 'identity_class', 'inferred',
        'country', cast(null as string), 'metadata', cast(map() as map<string,string>)))"""
    done = policy.apply(df.withColumn("detections", F.expr(span)), _LAW)
    plain = lambda c: F.regexp_replace(c, "_[0-9a-f]{8}(?= |$)", "_#")
    return done.select("k", "category", F.col("policy_outcomes")[0]["action"].alias("action"), plain(F.col("policy_outcomes")[0]["applied_value"]).alias("applied"), plain(F.col("redacted_text")).alias("redacted"))


@query(f"select k, 'to ****' as mask, 'to ' || left(sha256('a' || k || '@b.org'), 8) as hash, 'to ' as remove, 'to <EMAIL>' as placeholder from {_CUSTOMERS}")
def redaction_strategies(spark: SparkSession, d: str) -> DataFrame:
    pii = "array(named_struct('text', concat('a', k, '@b.org'), 'pii_type', 'EMAIL', 'start', 3, 'end', 3 + char_length(concat('a', k, '@b.org'))))"
    df = _keys(spark, d, "customer", "c_custkey").select("k", F.expr("concat('to a', k, '@b.org')").alias("text"), F.expr(pii).alias("pii"))
    for strategy in policy.STRATEGIES:
        df = policy.redact(df, strategy=strategy, into=strategy)
    return df.select("k", *policy.STRATEGIES)


@query(f"select k, 'by <person>Ann ' || k || '</person> of <city>Lagos</city>.' as tagged from {_CUSTOMERS}")
def xml_tags(spark: SparkSession, d: str) -> DataFrame:
    name = "char_length(concat('Ann ', k))"
    spans_ = f"array(named_struct('text', concat('Ann ', k), 'label', 'person', 'start', 3, 'end', 3 + {name}), named_struct('text', 'Lagos', 'label', 'city', 'start', 7 + {name}, 'end', 12 + {name}))"
    df = _keys(spark, d, "customer", "c_custkey").select("k", F.expr("concat('by Ann ', k, ' of Lagos.')").alias("text"), F.expr(spans_).alias("evidence"))
    return policy.tagged(df).select("k", F.col("tagged_text").alias("tagged"))


# ---- entities and evidence -------------------------------------------------------------------------

_MAIL, _SITE = "concat('a', cast(k as string), '@b.org')", "concat('https://x.org/p', cast(k as string))"


def _entity_rows(rows: list[tuple[str, str, str, float, str]]) -> str:
    """SQL of expected entities: value, what is before it, type, confidence, source."""
    return " union all ".join(f"select k, {v} as \"text\", '{t}' as entity_type, cast(length({b}) as bigint) as \"start\", cast({c} as double) as confidence, '{s}' as source from {_CUSTOMERS}" for v, b, t, c, s in rows)


_HEAD = f"concat('Mail ', {_MAIL}, ' or see ', {_SITE}, ' on 2024-03-05 or 7 May 2023; ')"
_BOOK = "'ISBN 978-0-306-40615-7'"


@query(_entity_rows([
    (_MAIL, "'Mail '", "EMAIL", 0.95, "regex"), (_SITE, f"concat('Mail ', {_MAIL}, ' or see ')", "URL", 0.95, "regex"), ("'2024-03-05'", f"concat('Mail ', {_MAIL}, ' or see ', {_SITE}, ' on ')", "DATE", 0.8, "regex"),
    ("'7 May 2023'", f"concat('Mail ', {_MAIL}, ' or see ', {_SITE}, ' on 2024-03-05 or ')", "DATE", 0.8, "regex"), (_BOOK, _HEAD, "ISBN", 0.95, "regex"), ("'0803 555 7890'", f"concat({_HEAD}, {_BOOK}, ' call ')", "PHONE", 0.9, "african"),
    (f"concat('RC', {_pad(7)})", f"concat({_HEAD}, {_BOOK}, ' call 0803 555 7890 for ')", "NATIONAL_ID", 0.95, "african"), ("'NGN 500'", f"concat({_HEAD}, {_BOOK}, ' call 0803 555 7890 for ', 'RC', {_pad(7)}, ' at ')", "MONEY", 0.85, "african"),
]))
def entity_kinds(spark: SparkSession, d: str) -> DataFrame:
    """One entity of each kind: order of the kinds, overlaps between them, places and sources."""
    df = _keys(spark, d, "customer", "c_custkey").select("k", F.expr(f"concat({_HEAD}, {_BOOK}, ' call 0803 555 7890 for RC', {_pad(7)}, ' at NGN 500')").alias("text"))
    found = entities.extract(df).select("k", F.explode("entities").alias("e"))
    return found.select("k", "e.text", "e.entity_type", F.col("e.start").cast("bigint").alias("start"), "e.confidence", "e.source")


_URL = r"https?://[^\s<>\x22\x27]+|www\.[^\s<>\x22\x27]+"
_MAILS = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"


@query(f"select doc_id, unnest(regexp_extract_all(text, '{_MAILS}')) as \"text\", 'EMAIL' as entity_type from documents union all select doc_id, unnest(regexp_extract_all(text, '{_URL}')), 'URL' from documents")
def wanted_entities(spark: SparkSession, d: str) -> DataFrame:
    """Two kinds of entities of all documents, the others not looked for."""
    found = entities.extract(table(spark, d, "documents"), types=["EMAIL", "URL"]).select("doc_id", F.explode("entities").alias("e"))
    return found.select("doc_id", "e.text", "e.entity_type")


@query(f"""select k, 'Bello ' || k as "text", 'PERSON' as entity_type, 'llm' as source from {_CUSTOMERS} where k % 2 = 1
 union all select k, '22' || {_pad(9, '4')}, 'NATIONAL_ID', 'african' from {_CUSTOMERS} where k % 2 = 0 union all select k, 'a@b.org', 'EMAIL', 'regex' from {_CUSTOMERS}""")
def merged_entities(spark: SparkSession, d: str) -> DataFrame:
    """Validated spans win over a model's, a model's over patterns'."""
    one = lambda text, kind, a, b, source: f"named_struct('text', {text}, 'entity_type', '{kind}', 'confidence', 0.9D, 'start', {a}, 'end', {b}, 'source', {source}, 'metadata', cast(map() as map<string,string>))"
    model = f"array({one('concat(\'Bello \', k)', 'PERSON', 0, 8, chr(39) + 'llm' + chr(39))})"
    found = f"array({one('concat(\'22\', ' + _pad(9, '4') + ')', 'NATIONAL_ID', 4, 15, 'if(k % 2 = 0, \'african\', \'regex\')')}, {one('\'a@b.org\'', 'EMAIL', 20, 27, '\'regex\'')})"
    df = _keys(spark, d, "customer", "c_custkey").select("k", F.expr(model).alias("model"), F.expr(found).alias("found"))
    return df.select("k", F.explode(F.expr(entities.merge_sql("model", "found"))).alias("e")).select("k", "e.text", "e.entity_type", "e.source")


@query(f"select k, case when k % 3 = 0 then 'nin' when k % 3 = 1 then 'person' else 'email' end as label, cast(case when k % 3 = 2 then 0.95 else 0.6 end as double) as confidence from {_CUSTOMERS} union all select k, 'city', 0.5 from {_CUSTOMERS}")
def adjudicated_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Of overlapping evidence the validated, else the structured, else the surer stays; ties keep the first."""
    one = lambda label, sure, a, b, status: f"named_struct('text', 'x', 'label', {label}, 'confidence', {sure}, 'start', {a}, 'end', {b}, 'detector_source', 'regex', 'country_hint', '', 'validator_status', {status}, 'metadata', cast(map() as map<string,string>))"
    first = one("case k % 3 when 0 then 'nin' when 1 then 'person' else 'person' end", "0.6D", 0, 9, "if(k % 3 = 0, 'checksum_valid', '')")
    second = one("case k % 3 when 2 then 'email' else 'title' end", "case k % 3 when 0 then 0.9D when 1 then 0.6D else 0.95D end", 0, 9, "''")
    a, b = f"array({first})", f"array({second}, {one(chr(39) + 'city' + chr(39), '0.5D', 9, 14, chr(39) * 2)})"
    df = _keys(spark, d, "customer", "c_custkey").select("k", F.explode(F.expr(entities.adjudicate_sql(a, b))).alias("e"))
    return df.select("k", "e.label", "e.confidence")


@query(f"""select k, 'Amina Bello' as "text", 'person' as label, 'NG' as country from {_CUSTOMERS} union all select k, 'Amina', 'first_name', 'NG' from {_CUSTOMERS} union all select k, 'Bello', 'last_name', 'NG' from {_CUSTOMERS}
 union all select k, '4' || {_pad(11, '5')}, 'account_number', '' from {_CUSTOMERS} union all select k, {_MAIL}, 'email', 'NG' from {_CUSTOMERS} union all select k, '0803 555 7890', 'phone_number', 'NG' from {_CUSTOMERS}""")
def evidence_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of a text: context, validated numbers, names split, the document's country stamped."""
    df = _keys(spark, d, "customer", "c_custkey").select("k", F.expr(f"concat('Name: Amina Bello, account number: 4', {_pad(11, '5')}, '; ', {_MAIL}, '; tel 0803 555 7890')").alias("text"))
    found = entities.evidence(df).select("k", F.explode("evidence").alias("e"))
    return found.select("k", "e.text", "e.label", F.col("e.country_hint").alias("country"))


@query(f"""select k, {_MAIL} as "text", 'email' as label, 'mask' as redaction from {_CUSTOMERS} union all select k, '0803 555 7890', 'phone_number', 'mask' from {_CUSTOMERS}
 union all select k, '4' || {_pad(11, '5')}, 'account_number', 'mask' from {_CUSTOMERS}""")
def sensitive_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of sensitive labels with the advice to mask; names of persons are none of these."""
    df = _keys(spark, d, "customer", "c_custkey").select("k", F.expr(f"concat('Name: Amina Bello, account number: 4', {_pad(11, '5')}, '; ', {_MAIL}, '; tel 0803 555 7890')").alias("text"))
    found = entities.sensitive(df).select("k", F.explode("sensitive").alias("e"))
    return found.select("k", "e.text", "e.label", "e.redaction")


@query(f"select k, k % 2 = 1 as refused, case when k % 2 = 1 then 0 else 1 end as found from {_CUSTOMERS}")
def refused_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts over the limit are refused one by one."""
    df = _keys(spark, d, "customer", "c_custkey").select("k", F.expr("concat('see www.x.org', repeat(' and more', cast(k % 2 as int)))").alias("text"))
    done = entities.detect(df, longest=15, error="error")
    return done.select("k", F.col("error").isNotNull().alias("refused"), F.size("entities").alias("found"))


# ---- text functions --------------------------------------------------------------------------------


@query("select doc_id, sha256(strip_accents(text)) as plain_sha256 from documents")
def strip_diacritics(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(similarity.mapped(similarity.strip_marks)(F.col("text")), 256).alias("plain_sha256"))


@query(f"select k, 'Adebayo Okonkwo' || k as name, cast(1 as double) as sorted_words, cast(0 as double) as other_words from {_CUSTOMERS}")
def african_names(spark: SparkSession, d: str) -> DataFrame:
    """Names turned round and stripped of marks; word order does not matter to the sorted ratio."""
    df = _keys(spark, d, "customer", "c_custkey").select("k", F.expr("concat('  ỌKONKWO', k, ',  Adébáyọ̀ ')").alias("raw"), F.expr("concat('ade ', k)").alias("a"), F.expr("concat(k, ' ade')").alias("b"))
    score = similarity.paired(similarity.token_sort)
    return df.select("k", similarity.mapped(similarity.normal_name)(F.col("raw")).alias("name"), score(F.col("a"), F.col("b")).alias("sorted_words"), score(F.lit("xyz"), F.lit("abc")).alias("other_words"))


# ---- signatures ------------------------------------------------------------------------------------

_SEED = bytes(range(32))


@query(f"select k, k % 2 = 0 as valid, case when k % 2 = 0 then '{{\"k\":' || k || '}}' end as payload from {_SUPPLIERS}")
def signed_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Signed payloads verify; those changed after signing do not."""
    df = _keys(spark, d, "supplier", "s_suppkey").select("k", F.expr("concat('{\"k\":', k, '}')").alias("payload"))
    df = df.select("k", crypto.signed(F.col("payload"), _SEED).alias("token"), crypto.signed(F.concat(F.col("payload"), F.lit(" ")), _SEED).alias("other"))
    mixed = F.expr("if(k % 2 = 0, token, concat(split(token, r'\\.')[0], '.', split(token, r'\\.')[1], '.', split(other, r'\\.')[2]))".replace("\\\\", "\\"))
    return df.select("k", crypto.verified(mixed, crypto.public_key(_SEED)).alias("v")).select("k", "v.valid", F.expr("if(v.valid, v.payload, null)").alias("payload"))


@query(f"select k, 'did:key:z6Mk' as head, true as same, '{{\"country\":\"NG\",\"name\":\"Ann ' || k || '\"}}' as shown, '{{\"country\":\"NG\"}}' as hidden from {_SUPPLIERS}")
def selective_disclosure(spark: SparkSession, d: str) -> DataFrame:
    """Keys as did:key and back; credentials whose hidden claims are seen only if disclosed."""
    key = crypto.public_key(_SEED)

    def row(k: str) -> dict:
        own = crypto.public_key(k.encode().ljust(32, b"."))
        did, token = crypto.did_of(own), crypto.issue({"country": "NG", "name": f"Ann {k}"}, _SEED, hide=["name"])
        return {"did": did, "same": crypto.key_of(did) == own, "shown": claims(token, ["name"]), "hidden": claims(token, [])}

    def claims(token: str, names_: list[str]) -> str:
        found = crypto.check_credential(crypto.present(token, names_), key)
        return json.dumps({n: v for n, v in found["claims"].items() if n in ("country", "name")}, sort_keys=True, separators=(",", ":"))

    kind = pa.struct([("did", pa.string()), ("same", pa.bool_()), ("shown", pa.string()), ("hidden", pa.string())])

    @F.arrow_udf("struct<did:string,same:boolean,shown:string,hidden:string>")
    def run(keys: pa.Array) -> pa.Array:
        return pa.array([None if k is None else row(k) for k in keys.to_pylist()], kind)

    df = spread(_keys(spark, d, "supplier", "s_suppkey")).select("k", run.asNondeterministic()(F.col("k").cast("string")).alias("r"))
    return df.select("k", F.left("r.did", F.lit(12)).alias("head"), "r.same", "r.shown", "r.hidden")
