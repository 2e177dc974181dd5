"""Every query of the library by name, with the SQL that checks it where SQL can express it.

Queries run over the driver's whole tables. Where those hold no identifiers, phones or amounts, a
query writes them into a text from the rows' own keys, so the SQL can say what must be found.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.functions import checks, similarity, spans
from veldspar.functions.shared import spread, table
from veldspar.operators import addresses, audit, components, detectors, entities, governance, jurisdictions, names_etl, places_lookup, policy, relate, requests, resolve, review
from veldspar.plans.process import Options, outcomes, process
from veldspar.plans.registered import oracle_sql, queries, query
from veldspar.sources import files

CONTACT = ("contact", "ip")
_IP = r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"
_EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
_CARD = r"\b(?:[0-9]{4}[\s\-]?){3}[0-9]{4}\b"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents"))


# ---- documents: contact data, policy, redaction --------------------------------------------------


def _placed(pattern: str) -> str:
    """SQL of the matches (doc_id, m, a) of a pattern in all documents: offsets are sums of the lengths of matches and of the pieces between them."""
    lists = f"select doc_id, regexp_extract_all(text, '{pattern}') as ms, regexp_split_to_array(text, '{pattern}') as ps from documents"
    each = f"select doc_id, generate_subscripts(ms, 1) as k, unnest(ms) as m, unnest(ps[:len(ms)]) as p from ({lists}) where len(ms) > 0"
    return f"(select doc_id, m, cast(sum(length(p)) over (partition by doc_id order by k) + coalesce(sum(length(m)) over (partition by doc_id order by k rows between unbounded preceding and 1 preceding), 0) as int) as a from ({each}))"


_LUHN = "list_sum(list_transform(range(1, length(n) + 1), lambda i: case when (length(n) - i) % 2 = 0 then cast(n[i] as int) else (cast(n[i] as int) * 2) % 10 + (cast(n[i] as int) * 2) // 10 end)) % 10 = 0"
_LAWS = "(select * from (values " + ", ".join(f"('{c}', '{m[0]}', '{m[2]}')" for c, m in policy.load("NDPA-2023").mappings.items()) + ") v(category, action, reference))"
_FOUND = rf"""found as (select doc_id, m, a, 'PII-3-EMAIL' as category from {_placed(_EMAIL)}
 union all select doc_id, m, a, 'PII-5-CARD' from (select *, regexp_replace(m, '[^0-9]', '', 'g') as n from {_placed(_CARD)}) where {_LUHN}
 union all select doc_id, m, a, 'PII-8-IP_ADDRESS' from {_placed(_IP)} p join documents t using (doc_id) where list_bool_and(list_transform(string_split(m, '.'), lambda o: cast(o as int) <= 255 and (length(o) = 1 or o not like '0%')))
  and not regexp_matches(substr(t.text, greatest(a - 16, 0) + 1, least(a, 16)), '(?i)\bv(?:ersion)?\b'))"""


@query(rf"""with {_FOUND} select doc_id, sha256(text) as document_hash, 'det:' || a || ':' || (a + length(m)) as detection_id, category, action, reference as statute_reference, 'NDPA-2023' as statute_id,
 case action when 'mask' then '[' || regexp_extract(category, '[^-]+$') || ']' when 'drop' then '' when 'tokenize' then regexp_extract(category, '[^-]+$') || '_#' when 'generalize' then regexp_replace(m, '[0-9]+$', '0/24') else m end as applied_value,
 a as "start", cast(a + length(m) as int) as "end", cast(null as varchar) as superseded_by from found join {_LAWS} using (category) join documents using (doc_id)""")
def pii_policy_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Emails, cards and addresses of networks in documents under a statute: one row an outcome; the digits of a token (BLAKE2, which SQL lacks) are left out."""
    done = process(_documents(spark, d), Options(jurisdiction="NG", packages=CONTACT))
    return outcomes(done, "doc_id").drop("statute_version", "rationale").withColumn("applied_value", F.regexp_replace("applied_value", "_[0-9a-f]{8}$", "_#"))


@query()
def redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    done = process(_documents(spark, d), Options(jurisdiction="NG", packages=(*CONTACT, "core", "ng", "digital_id")))
    return done.select("doc_id", "document_hash", F.sha2("redacted_text", 256).alias("redacted_sha256"), F.size("detections").alias("detections"))


_FOUND_IP = rf"""ips as (select doc_id, unnest(regexp_extract_all(text, '{_IP}')) as ip, generate_subscripts(regexp_extract_all(text, '{_IP}'), 1) as nth from documents),
 valid as (select doc_id, ip, nth from ips where list_bool_and(list_transform(string_split(ip, '.'), lambda o: cast(o as int) <= 255 and (length(o) = 1 or o not like '0%'))))"""


@query(f"with {_FOUND_IP} select doc_id, ip, cast(row_number() over (partition by doc_id order by nth) as bigint) as nth, regexp_replace(ip, '[0-9]+$', '0/24') as generalized from valid")
def ipv4_generalize(spark: SparkSession, d: str) -> DataFrame:
    """Valid IPv4 addresses in order, and their /24."""
    found = _documents(spark, d).select("doc_id", F.posexplode(F.expr(detectors.ipv4_sql("coalesce(text, '')", versions=True))).alias("i", "s"))
    value = policy.generalize_sql("s.category", "s.text")
    return found.select("doc_id", F.col("s.text").alias("ip"), (F.col("i") + 1).cast("long").alias("nth"), F.expr(value).alias("generalized"))


@query(f"select doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) as email, '[EMAIL]' as masked from documents")
def email_spans(spark: SparkSession, d: str) -> DataFrame:
    t = "coalesce(text, '')"
    found = _documents(spark, d).select("doc_id", F.explode(F.expr(f"filter({detectors.contact_sql(t)}, s -> s.category = 'PII-3-EMAIL')")).alias("s"))
    return found.select("doc_id", F.col("s.text").alias("email"), F.expr(f"concat('[', {policy.label_sql('s.category')}, ']')").alias("masked"))


@query(rf"with c as (select doc_id, unnest(regexp_extract_all(text, '{_CARD}')) as card from documents), n as (select doc_id, card, regexp_replace(card, '[^0-9]', '', 'g') as n from c) select doc_id, card, {_LUHN} as valid from n")
def card_luhn(spark: SparkSession, d: str) -> DataFrame:
    found = _documents(spark, d).select("doc_id", F.explode(F.expr(spans.matches("coalesce(text, '')", _CARD))).alias("s"))
    return found.select("doc_id", F.col("s.m").alias("card"), F.expr(checks.luhn_sql("regexp_replace(s.m, '[^0-9]', '')")).alias("valid"))


@query("select doc_id, sha256(text) as document_hash, cast(length(text) as int) as input_length from documents")
def document_hash(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.sha2("text", 256).alias("document_hash"), F.length("text").alias("input_length"))


@query(f"select doc_id, sha256(regexp_replace(text, '{_EMAIL}', '<EMAIL>', 'g')) as redacted_sha256 from documents")
def redact_placeholder(spark: SparkSession, d: str) -> DataFrame:
    """Emails give way to a placeholder."""
    t = "coalesce(text, '')"
    pii = f"transform(filter({detectors.contact_sql(t)}, s -> s.category = 'PII-3-EMAIL'), s -> named_struct('text', s.text, 'pii_type', 'EMAIL', 'start', s.start, 'end', s.end))"
    df = _documents(spark, d).withColumn("pii", F.expr(pii))
    return policy.redact(df, strategy="placeholder").select("doc_id", F.sha2("redacted_text", 256).alias("redacted_sha256"))


@query(r"""select doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10))) as normal_sha256 from documents""")
def whitespace_normalise(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc_id", F.sha2(F.expr(similarity.whitespace_sql("text")), 256).alias("normal_sha256"))


_DIM = "(select * from (values " + ", ".join(f"('{c}', '{a}', '{t}')" for c, (a, t, *_) in policy.load("NDPA-2023").mappings.items()) + ") v(category, action, tier))"


@query(rf"""with {_FOUND_IP}, found as (select 'PII-8-IP_ADDRESS' as category from valid union all select 'PII-3-EMAIL' from (select unnest(regexp_extract_all(text, '{_EMAIL}')) from documents)
 union all select 'PII-5-CARD' from (select regexp_replace(unnest(regexp_extract_all(text, '{_CARD}')), '[^0-9]', '', 'g') as n from documents) where {_LUHN})
 select category, action, tier, count(*) as n from found join {_DIM} using (category) group by all""")
def statute_enrich_counts(spark: SparkSession, d: str) -> DataFrame:
    """Findings by category with the statute's action and tier."""
    law = policy.load("NDPA-2023")
    t = "coalesce(text, '')"
    df = _documents(spark, d).withColumn("detections", F.expr(f"concat({detectors.ipv4_sql(t, versions=True)}, {detectors.contact_sql(t)})"))
    each = policy.enrich(df, law).select(F.explode("detections").alias("s")).select("s.category", F.expr(policy.action_sql(law, "s.category")).alias("action"), F.col("s.sensitivity_tier").alias("tier"))
    return each.groupBy("category", "action", "tier").agg(F.count("*").alias("n"))


@query("select statute_id, category, action, tier from (values " + ", ".join(f"('{s}', '{c}', '{m[0]}', '{m[1]}')" for s in policy.available() for c, m in policy.load(s).mappings.items()) + ") v(statute_id, category, action, tier)")
def statute_dimension(spark: SparkSession, d: str) -> DataFrame:
    return policy.table(spark).select("statute_id", "category", "action", "tier")


@query()
def entity_extraction(spark: SparkSession, d: str) -> DataFrame:
    found = entities.extract(_documents(spark, d))
    return found.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.text", "e.entity_type", "e.start", "e.end", "e.confidence", "e.source")


@query()
def personal_data(spark: SparkSession, d: str) -> DataFrame:
    found = entities.personal_data(_documents(spark, d))
    return found.select("doc_id", F.explode("pii").alias("e")).select("doc_id", "e.text", "e.pii_type", "e.start", "e.end", "e.confidence")


@query()
def identity_evidence(spark: SparkSession, d: str) -> DataFrame:
    found = entities.evidence(_documents(spark, d))
    return found.select("doc_id", F.explode("evidence").alias("e")).select("doc_id", "e.text", "e.label", "e.start", "e.end", F.round("e.confidence", 4).alias("confidence"))


@query()
def sensitive_spans(spark: SparkSession, d: str) -> DataFrame:
    found = entities.sensitive(_documents(spark, d))
    return found.select("doc_id", F.explode("sensitive").alias("e")).select("doc_id", "e.text", "e.label", "e.start", "e.end", "e.redaction")


@query()
def page_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", files.html_text(F.col("html")).alias("text"))


@query("select doc_id, cast(count(*) as bigint) as total, cast(sum(case when k = 'email' then 1 else 0 end) as bigint) as medium from (select distinct doc_id, k, case when length(v) <= 4 then '***' else left(v, 3) || repeat('*', length(v) - 3) end as masked from (select doc_id, 'email' as k, unnest(regexp_extract_all(text, '" + _EMAIL + "')) as v from documents)) group by doc_id")
def compliance_counts(spark: SparkSession, d: str) -> DataFrame:
    """Masked findings of each document."""
    t = "coalesce(text, '')"
    pii = _documents(spark, d).select("doc_id", F.explode(F.expr(f"filter({detectors.contact_sql(t)}, s -> s.category = 'PII-3-EMAIL')")).alias("s")).select("doc_id", F.lit("EMAIL").alias("pii_type"), "s.text")
    nothing = pii.select("doc_id", F.lit("email").alias("label"), "text").where("false")
    return governance.assess(governance.findings(nothing, pii)).select("doc_id", "total", "medium")


# ---- detectors on texts made from keys -----------------------------------------------------------


@query("select c_custkey, '+234803' || lpad(cast(c_custkey as varchar), 7, '0') as international, 'NG' as country, 5 as \"start\", 18 as \"end\" from customer")
def phone_spans(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer").select("c_custkey", F.expr("concat('Call 0803 ', left(lpad(c_custkey, 7, '0'), 3), ' ', right(lpad(c_custkey, 7, '0'), 4), '.')").alias("text"))
    found = detectors.detect(df, jurisdiction="NG", packages=["core"]).select("c_custkey", F.explode("detections").alias("s"))
    return found.select("c_custkey", F.col("s.metadata")["international"].alias("international"), "s.country", "s.start", "s.end")


@query("select c_custkey, 'PII-2-NIN' as category, lpad(cast(c_custkey as varchar), 11, '7') as value, 0.75 as confidence from customer union all select c_custkey, 'PII-2-GHANA_CARD', 'GHA-' || lpad(cast(c_custkey as varchar), 9, '0') || '-1', 1.0 from customer")
def national_identifiers(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer").select("c_custkey", F.expr("concat('nin ', lpad(c_custkey, 11, '7'), ' card GHA-', lpad(c_custkey, 9, '0'), '-1')").alias("text"))
    found = detectors.detect(df, packages=["africa"]).select("c_custkey", F.explode("detections").alias("s"))
    return found.select("c_custkey", "s.category", F.col("s.text").alias("value"), "s.confidence")


@query("""with t as (select o_orderkey, lpad(cast(cast(o_orderkey % 100 as int) as varchar), 2, '0') || strftime(o_orderdate, '%m%d') || lpad(cast(o_custkey % 10000 as varchar), 4, '0') || '08' as head from orders),
 n as (select o_orderkey, head, head || cast((10 - list_sum(list_transform(range(1, 13), lambda i: case when i % 2 = 1 then cast(head[i] as int) else (cast(head[i] as int) * 2) % 10 + (cast(head[i] as int) * 2) // 10 end)) % 10) % 10 as varchar) as id from t)
 select o_orderkey, id, case when cast(id[1:2] as int) >= 30 then '19' else '20' end || id[1:2] || '-' || id[3:4] || '-' || id[5:6] as date_of_birth, case when cast(id[7:10] as int) < 5000 then 'female' else 'male' end as gender from n""")
def sa_id_decode(spark: SparkSession, d: str) -> DataFrame:
    """South African numbers with right check digits, built from orders and decoded."""
    head = "concat(lpad(cast(o_orderkey % 100 as int), 2, '0'), date_format(o_orderdate, 'MMdd'), lpad(o_custkey % 10000, 4, '0'), '08')"
    total = "aggregate(sequence(1, 12), 0, (a, i) -> a + cast(if(i % 2 = 1, int(substr(head, i, 1)), (int(substr(head, i, 1)) * 2) % 10 + (int(substr(head, i, 1)) * 2) div 10) as int))"
    df = table(spark, d, "orders").select("o_orderkey", F.expr(head).alias("head")).select("o_orderkey", F.expr(f"concat(head, cast((10 - {total} % 10) % 10 as int))").alias("id"))
    return df.select("o_orderkey", "id", F.expr(checks.zaid_sql("id")).alias("z")).where("z.valid").select("o_orderkey", "id", "z.date_of_birth", "z.gender")


@query("""with t as (select p_partkey, '978' || lpad(cast(p_partkey as varchar), 9, '0') as head from part), n as (select p_partkey, head || cast(p_partkey % 10 as varchar) as isbn,
 (10 - list_sum(list_transform(range(1, 13), lambda i: cast(head[i] as int) * case when i % 2 = 1 then 1 else 3 end)) % 10) % 10 as want from t) select p_partkey, isbn, case when want = p_partkey % 10 then 'ISBN-13' else '' end as kind from n""")
def isbn_check(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "part").select("p_partkey", F.expr("concat('978', lpad(p_partkey, 9, '0'), p_partkey % 10)").alias("isbn"))
    return df.select("p_partkey", "isbn", F.expr(f"{entities.isbn_sql('isbn')}.kind").alias("kind"))


@query("select o_orderkey, 'NGN' as currency, round(cast(o_orderkey as double) * 1000 + 0.5, 2) as amount from orders")
def currency_amounts(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").select("o_orderkey", F.expr("concat('total ₦', format_number(o_orderkey * 1000 + 0.5D, 1), ' due')").alias("text"))
    found = df.select("o_orderkey", F.explode(F.expr(detectors.money_sql("text"))).alias("s"))
    return found.select("o_orderkey", F.col("s.metadata")["currency"].alias("currency"), F.col("s.metadata")["amount"].cast("double").alias("amount"))


@query("select s_suppkey, 'PII-2-DID' as category, 1.0 as confidence, 'web' as method from supplier union all select s_suppkey, 'PII-5-CRYPTO_WALLET', 0.85, null from supplier")
def digital_identities(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "supplier").select("s_suppkey", F.expr("concat('did:web:host', s_suppkey, '.example and 0x', lpad(lower(hex(s_suppkey)), 40, '0'))").alias("text"))
    found = df.select("s_suppkey", F.explode(F.expr(detectors.digital_sql("text"))).alias("s"))
    return found.select("s_suppkey", "s.category", "s.confidence", F.col("s.metadata")["method"].alias("method"))


@query("select s_suppkey, 'Fatima' as name, 'Johannesburg' as canonical, 'ZA' as country from supplier")
def names_and_places(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "supplier").select("s_suppkey", F.expr("concat('Fatima of ', s_name, ' moved to Joburg')").alias("text"))
    both = df.select("s_suppkey", F.expr(detectors.name_sql("text")).alias("n"), F.expr(detectors.location_sql("text")).alias("l"))
    return both.select("s_suppkey", F.expr("n[0].text").alias("name"), F.expr("l[0].metadata['canonical_name']").alias("canonical"), F.expr("l[0].country").alias("country"))


@query("select s_suppkey, cast(s_suppkey % 9000 + 1 as varchar) as street_number, 'Allen Avenue' as street, 'Ikeja' as neighborhood, 'Lagos' as city, 'NG' as country, 0.85 as confidence from supplier")
def address_components(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "supplier").select("s_suppkey", F.expr("concat(s_suppkey % 9000 + 1, ' Allen Avenue, Ikeja, Lagos, Nigeria')").alias("text"))
    found = df.select("s_suppkey", F.explode(addresses.parse(F.col("text"))).alias("a"))
    return found.select("s_suppkey", "a.components.street_number", "a.components.street", "a.components.neighborhood", "a.components.city", "a.components.country", "a.confidence")


_LADDER = " ".join(f"when regexp_matches(lower(t), '\\b{w.replace(chr(39), chr(39) * 2)}\\b') then '{c}'" for w, c in addresses.places.COUNTRIES.items())


@query(f"select n_nationkey, case {_LADDER} else 'XX' end as code, case when (case {_LADDER} end) is null then 0.0 else 0.99 end as confidence from (select n_nationkey, 'our office in ' || n_name as t from nation)")
def jurisdiction_ladder(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "nation").select("n_nationkey", F.expr("concat('our office in ', n_name)").alias("t"))
    return df.select("n_nationkey", F.expr(addresses.jurisdiction_sql("t")).alias("j")).select("n_nationkey", "j.code", "j.confidence")


_VOTES = ", ".join(f"{{'n': len(list_filter([{', '.join(chr(39) + w.replace(chr(39), chr(39) * 2) + chr(39) for w in ws)}], lambda w: contains(lower(t), w))), 'i': {-i}, 'c': '{c}'}}" for i, (c, ws) in enumerate(addresses.places.VOTES.items()))


@query(f"select n_nationkey, case when m.n > 0 then m.c else '' end as country from (select n_nationkey, list_max([{_VOTES}]) as m from (select n_nationkey, n_name || ' of lagos and cairo, ' || n_name || 'ian' as t from nation))")
def keyword_country_vote(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "nation").select("n_nationkey", F.expr("concat(n_name, ' of lagos and cairo, ', n_name, 'ian')").alias("t"))
    return df.select("n_nationkey", F.expr(addresses.vote_sql("t")).alias("country"))


@query("select s_suppkey, 'SE1 ' || cast(s_suppkey % 10 as varchar) || 'EH' as mention, 'postcode' as kind, 0.99 as confidence from supplier")
def place_mentions(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "supplier").select("s_suppkey", F.expr("concat('now at SE1 ', s_suppkey % 10, 'EH today')").alias("text"))
    found = df.select("s_suppkey", F.explode(F.expr(f"filter({places_lookup.mentions_sql('text')}, m -> m.kind = 'postcode')")).alias("m"))
    return found.select("s_suppkey", F.col("m.text").alias("mention"), "m.kind", "m.confidence")


# ---- comparators and weights ---------------------------------------------------------------------

_CLAMP = "greatest(least({}, 0.9999), 0.0001)"
_W = f"case when a >= 0.99 then log2(m / u) when a <= 0.01 then log2((1 - m) / (1 - u)) else a * log2(m / u) + (1 - a) * log2((1 - m) / (1 - u)) end"
_PAIRS = f"select l_orderkey, l_linenumber, l_discount * 10 as a, {_CLAMP.format('0.9 + l_tax')} as m, {_CLAMP.format('0.01 + l_tax / 10')} as u from lineitem"


@query(f"select l_orderkey, l_linenumber, round({_W}, 6) as weight from ({_PAIRS})")
def fs_log_odds(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem")
    return df.select("l_orderkey", "l_linenumber", F.expr(f"round({checks.log_odds_sql('(l_discount * 10)', '(0.9D + l_tax)', '(0.01D + l_tax / 10)')}, 6)").alias("weight"))


@query(f"with w as (select l_orderkey, l_linenumber, {_W} as w from ({_PAIRS})), s as (select *, round(pow(2, w) / (1 + pow(2, w)), 4) as score from w) select l_orderkey, l_linenumber, score, case when score >= 0.85 then 'match' when score >= 0.4 then 'review' else 'no_match' end as decision from s")
def fs_decision(spark: SparkSession, d: str) -> DataFrame:
    w = checks.log_odds_sql("(l_discount * 10)", "(0.9D + l_tax)", "(0.01D + l_tax / 10)")
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(w).alias("w")).select("l_orderkey", "l_linenumber", F.expr(f"round({checks.posterior_sql('w')}, 4)").alias("score"))
    return df.withColumn("decision", F.expr(checks.decision_sql("score")))


_N = "lpad(cast(c_custkey as varchar), 7, '0')"


@query(f"select c_custkey, 1.0 as phones, case when c_custkey % 3 = 0 then 1.0 else 0.0 end as ids, case when c_custkey % 2 = 0 then 1.0 else 0.0 end as emails, 1.0 as dates, 1.0 as isbns from customer")
def field_comparators(spark: SparkSession, d: str) -> DataFrame:
    n = "lpad(c_custkey, 7, '0')"
    df = table(spark, d, "customer")
    return df.select(
        "c_custkey",
        F.expr(checks.same_phone_sql(f"concat('+234 803 ', {n})", f"concat('0803-', {n})")).alias("phones"),
        F.expr(checks.same_id_sql(f"concat('A-', {n})", f"concat('a', if(c_custkey % 3 = 0, {n}, 'x'))")).alias("ids"),
        F.expr(checks.same_email_sql("concat(c_custkey, '@A.org ')", "concat(c_custkey, if(c_custkey % 2 = 0, '@a.org', '@b.org'))")).alias("emails"),
        F.expr(checks.same_date_sql(f"concat('2020-', {n})", f"concat('2020/', {n})")).alias("dates"),
        F.expr(checks.same_isbn_sql(f"concat('00', {n}, '1')", f"concat('97800', {n}, '9')")).alias("isbns"),
    )


_KINDS = {"bvn": "^22[0-9]{9}$", "nin": "^[0-9]{11}$", "ng_tin": "^([0-9]{10}|[0-9]{14})$", "za_tax": "^[01239][0-9]{9}$", "nhif": "^[0-9]{8,9}$"}


@query("select o_orderkey, " + ", ".join(f"regexp_matches(v, '{p}') as {k}" for k, p in _KINDS.items()) + " from (select o_orderkey, lpad('22' || cast(o_orderkey as varchar), cast(8 + o_orderkey % 7 as int), '2') as v from orders)")
def format_validators(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").select("o_orderkey", F.expr("lpad(concat('22', o_orderkey), cast(8 + o_orderkey % 7 as int), '2')").alias("v"))
    return df.select("o_orderkey", *(F.expr(checks.valid_sql(k, "v")).alias(k) for k in _KINDS))


@query("select a.n_name as a, b.n_name as b, round(jaro_winkler_similarity(a.n_name, b.n_name), 6) as similarity from nation a join nation b on a.n_nationkey < b.n_nationkey")
def jaro_winkler_pairs(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    pairs = n.select(F.col("n_nationkey").alias("i"), F.col("n_name").alias("a")).join(F.broadcast(n.select(F.col("n_nationkey").alias("j"), F.col("n_name").alias("b"))), F.expr("i < j"))  # 25 rows
    return pairs.select("a", "b", F.round(similarity.paired(similarity.jaro_winkler)(F.col("a"), F.col("b")), 6).alias("similarity"))


@query()
def record_match(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    pairs = c.select(F.col("c_custkey").alias("a"), F.col("c_name").alias("name_a"), F.col("c_mktsegment").alias("address_a"), F.expr("concat('+234803', lpad(c_custkey, 7, '0'))").alias("phone_a"), (F.col("c_custkey") + 1).alias("b"))
    other = c.select(F.col("c_custkey").alias("b"), F.col("c_name").alias("name_b"), F.col("c_mktsegment").alias("address_b"), F.expr("concat('0803', lpad(c_custkey, 7, '0'))").alias("phone_b"))
    return resolve.match_records(pairs.join(other, "b"), "NG").select("a", "b", "score", "decision", "explanation")


# ---- joins, clusters, graphs ---------------------------------------------------------------------


def _entities(df: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("entity_id"), F.col(text).alias("text"), F.lit(kind).alias("entity_type"), F.lit(0.9).alias("confidence"), F.lit(0).alias("start"), F.length(text).alias("end"), F.lit("regex").alias("source"), F.expr("cast(map() as map<string,string>)").alias("metadata"))


@query("with t as (select p_brand || ' ' || p_type as text, min(p_partkey) as rep from part group by 1) select x.rep as a, y.rep as b, x.text as text_a, y.text as text_b from t x join t y on lower(x.text)[1] = lower(y.text)[1] and x.rep < y.rep")
def blocked_pairs(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").withColumn("name", F.concat_ws(" ", "p_brand", "p_type"))
    keyed = resolve.with_keys(_entities(part, "p_partkey", "name", "PERSON"))
    return resolve.blocked_pairs(keyed).select("a", "b", "text_a", "text_b")


@query("with r as (select s_suppkey, n_regionkey from supplier join nation on s_nationkey = n_nationkey) select s_suppkey as node, cast(min(s_suppkey) over (partition by n_regionkey) as bigint) as component from r")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers joined through their nations and regions."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    edges = s.select(F.col("s_suppkey").alias("a"), (F.col("s_nationkey") + 10_000_000).cast("long").alias("b")).unionByName(n.select((F.col("n_nationkey") + 10_000_000).cast("long").alias("a"), (F.col("n_regionkey") + 20_000_000).cast("long").alias("b")))
    return components.connected_components(edges).where("node < 10000000").select("node", "component")


@query("select c_nationkey as cluster, arg_min(c_name, c_custkey) as canonical_name, cast(count(*) as bigint) as sources, round(avg(0.9), 4) as confidence, cast(count(distinct c_name) - 1 as int) as aliases, 'merged_' || count(*) || '_mentions' as reason from customer where length(c_name) = (select max(length(c_name)) from customer) group by c_nationkey")
def cluster_collapse(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    longest = c.agg(F.max(F.length("c_name"))).first()[0]
    rows = _entities(c.where(F.length("c_name") == longest).withColumn("cluster", F.col("c_nationkey")), "c_custkey", "c_name", "PERSON")
    clustered = rows.join(c.select(F.col("c_custkey").alias("entity_id"), F.col("c_nationkey").alias("cluster")), "entity_id")
    return resolve.collapse(clustered).select("cluster", "canonical_name", "sources", "confidence", F.size("aliases").alias("aliases"), F.expr("match_reasons[0]").alias("reason"))


@query()
def linked_identities(spark: SparkSession, d: str) -> DataFrame:
    a = _entities(table(spark, d, "nation").withColumn("k", F.col("n_nationkey") + 0), "k", "n_name", "PERSON")
    b = _entities(table(spark, d, "region").withColumn("k", F.col("r_regionkey") + 1000), "k", "r_name", "PERSON")
    found, _ = resolve.link(a, b)
    return found.select("cluster", "canonical_name", "sources", "confidence")


_SESSIONS = "select user_id as doc_id, event_id as entity_id, cast(epoch(ts) as int) as s, lag(cast(epoch(ts) as int)) over (partition by user_id order by epoch(ts), event_id) as p from events"


@query(f"select doc_id, entity_id, cast(sum(case when s - p > 21600 then 1 else 0 end) over (partition by doc_id order by s, entity_id rows unbounded preceding) as bigint) as grp from ({_SESSIONS})")
def gap_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a user's events, six hours apart at most; times count to the nearest second, halves to the even one."""
    exact = F.unix_micros(F.col("ts").cast("timestamp"))
    at = F.rint(exact / 1_000_000).cast("int")
    df = table(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("entity_id"), at.alias("start"), at.alias("end"), exact.alias("ts"))
    return relate.gap_groups(df, 21600, exact="ts").select("doc_id", "entity_id", "grp")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("entity_id"), "text", F.when(F.col("role") == "user", "PERSON").otherwise("LOCATION").alias("entity_type"),
        F.lit(0.9).alias("confidence"), (F.col("turn") * 150).cast("int").alias("start"), (F.col("turn") * 150 + 10).cast("int").alias("end"), F.expr("cast(map() as map<string,string>)").alias("metadata"))


@query("select x.conv_id as doc_id, x.conv_id * 1000 + x.turn as a, y.conv_id * 1000 + y.turn as b from conversations x join conversations y on x.conv_id = y.conv_id and x.conv_id * 1000 + x.turn < y.conv_id * 1000 + y.turn and (x.text <> y.text or (x.role = 'user') <> (y.role = 'user'))")
def cooccurrence_edges(spark: SparkSession, d: str) -> DataFrame:
    return relate.cooccurrences(_turns(spark, d)).select("doc_id", "a", "b")


@query("select distinct x.conv_id as doc_id, x.conv_id * 1000 + x.turn as a, 'location_' || y.text || '_XX' as b from conversations x join conversations y on x.conv_id = y.conv_id and x.role = 'user' and y.role <> 'user' and abs(x.turn - y.turn) * 150 <= 200")
def proximity_edges(spark: SparkSession, d: str) -> DataFrame:
    turns = _turns(spark, d)
    places = turns.where("entity_type = 'LOCATION'").select(F.col("text").alias("name"), F.lit("XX").alias("country"), F.lit(1.0).alias("confidence")).distinct()
    return relate.located(turns, places).select("doc_id", "a", "b")


@query("""select u.conv_id as doc_id, u.conv_id * 1000 + u.turn as entity_id from conversations u where u.role = 'user' and not exists
 (select 1 from conversations o where o.conv_id = u.conv_id and o.role <> 'user' and o.conv_id % 3 = 0 and u.turn * 150 < o.turn * 150 + 160 and o.turn * 150 < u.turn * 150 + 160)""")
def overlap_anti_join(spark: SparkSession, d: str) -> DataFrame:
    wide = _turns(spark, d).withColumn("end", F.col("start") + 160)
    return relate.outside(wide.where("entity_type = 'PERSON'"), wide.where("entity_type = 'LOCATION' and doc_id % 3 = 0")).select("doc_id", "entity_id")


@query()
def nearest_places(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "nation").select(F.initcap("n_name").alias("name")).unionByName(spark.createDataFrame([("Cape Town City",), ("Lagos",)], "name string"))
    return relate.nearest_place(names, files.gazetteer(spark))


# ---- audit, review, requests ---------------------------------------------------------------------

_LOG = """select event_id as id, ts as timestamp, case when event_id % 2 = 0 then 'policy' else 'detection' end as event_type, cast(user_id as varchar) as document_hash, 'PII-' || event_type as category,
 case when value > 50 then 'mask' else 'drop' end as action, case when event_id % 3 = 0 then 'POPIA' else 'NDPA-2023' end as statute_id, case when event_id % 5 = 0 then '' else 's.' || (event_id % 7) end as statute_reference from events"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").selectExpr(
        "event_id as id", "ts as timestamp", "case when event_id % 2 = 0 then 'policy' else 'detection' end as event_type", "cast(user_id as string) as document_hash", "concat('PII-', event_type) as category",
        "case when value > 50 then 'mask' else 'drop' end as action", "case when event_id % 3 = 0 then 'POPIA' else 'NDPA-2023' end as statute_id", "case when event_id % 5 = 0 then '' else concat('s.', event_id % 7) end as statute_reference")


@query(f"select id, document_hash, category from ({_LOG}) where event_type = 'policy' and timestamp >= timestamp '2024-01-05 00:00:00' order by id limit 100")
def audit_filter_limit(spark: SparkSession, d: str) -> DataFrame:
    return audit.query(_events(spark, d), event_type="policy", since=datetime(2024, 1, 5), limit=100).select("id", "document_hash", "category")


@query(f"select statute_id, category, action, count(*) as n, arg_min(statute_reference, id) filter (statute_reference <> '') as statute_reference from ({_LOG}) where event_type = 'policy' group by all")
def audit_report(spark: SparkSession, d: str) -> DataFrame:
    return audit.policy_counts(_events(spark, d))


@query(f"select count(*) as events, count(distinct document_hash) as documents from ({_LOG})")
def audit_summary(spark: SparkSession, d: str) -> DataFrame:
    return audit.summary(_events(spark, d))


_IDENT = "select c_nationkey as cluster, count(*) as sources, round(avg((c_acctbal + 1000) / 11000), 4) as confidence, min(c_custkey) as first from customer group by 1"


@query(f"select c.c_custkey as record_b, i.first as record_a, i.confidence, case when i.confidence >= 0.5 then 'auto_approved' when i.confidence <= 0.3 then 'auto_rejected' else 'pending' end as status from customer c join ({_IDENT}) i on c.c_nationkey = i.cluster where c.c_custkey <> i.first and i.sources > 1")
def review_routing(spark: SparkSession, d: str) -> DataFrame:
    return review.route(*_identities(spark, d), accept=0.5).select("record_a", "record_b", "confidence", "status")


def _identities(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, d, "customer")
    ids = c.groupBy(F.col("c_nationkey").alias("cluster")).agg(F.count("*").alias("sources"), F.round(F.avg((F.col("c_acctbal") + 1000) / 11000), 4).alias("confidence")).withColumn("match_reasons", F.array(F.lit("x")))
    return ids, c.select(F.col("c_nationkey").alias("cluster"), F.col("c_custkey").alias("entity_id"))


_ROUTED = f"select case when i.confidence >= 0.5 then 'auto_approved' when i.confidence <= 0.3 then 'auto_rejected' else 'pending' end as status from customer c join ({_IDENT}) i on c.c_nationkey = i.cluster where c.c_custkey <> i.first and i.sources > 1"


@query(f"select count(*) as total, {', '.join(f'count(*) filter (status = {chr(39)}{s}{chr(39)}) as {s}' for s in review.STATUSES)} from ({_ROUTED})")
def review_stats(spark: SparkSession, d: str) -> DataFrame:
    return review.stats(review.route(*_identities(spark, d), accept=0.5))


@query("select c_custkey as request_id, 'Bank' as organization, 'NDPA-2023 s.34 (Right of Access)' as citation, '2024-01-31' as deadline from customer")
def subject_requests(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    req = c.selectExpr("c_custkey as request_id", "'NDPA-2023' as statute", "'access' as request_type", "c_name as name", "'NIN' as identifier_label", "string(c_custkey) as identifier_value", "'' as contact", "'' as purpose", "cast(null as int) as deadline_days")
    to = c.selectExpr("c_custkey as request_id", "'Bank' as organization", "cast(null as string) as address")
    return requests.drafts(to, req, "2024-01-01").select("request_id", "organization", "citation", F.col("deadline").cast("string").alias("deadline"))


@query("select o_orderkey, coalesce(o_orderdate < timestamp '2024-06-01 00:00:00', false) as expired from orders")
def envelope_expiry(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("at"))
    return df.select("o_orderkey", F.expr(requests.expired_sql("at", "timestamp'2024-06-01 00:00:00'")).alias("expired"))


# ---- the names pipeline --------------------------------------------------------------------------

_KEY = "regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g')"
_COUNTRY = "(case c_nationkey % 3 when 0 then 'NG' when 1 then 'KE' else 'GH' end)"
_TYPE = "(case when c_custkey % 2 = 0 then 'given' else 'family' end)"
_RAWSQL = f"select 'wikidata' as source, 'Q' || (c_custkey % 500) as source_id, case when c_custkey % 3 = 0 then lower(c_mktsegment) else c_mktsegment end as c_name, {_TYPE} as name_type, {_COUNTRY} as country, cast(c_custkey % 9 + 1 as int) as n from customer"


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").selectExpr(
        "'wikidata' as source", "concat('Q', c_custkey % 500) as source_id", "'CC0' as source_license", "case when c_custkey % 3 = 0 then lower(c_mktsegment) else c_mktsegment end as name_raw", "case when c_custkey % 2 = 0 then 'given' else 'family' end as name_type",
        "case c_nationkey % 3 when 0 then 'NG' when 1 then 'KE' else 'GH' end as country_iso2", "'en' as language_tag", "cast(c_custkey % 9 + 1 as int) as evidence_count", "timestamp'2024-01-01 00:00:00' as fetched_at")


@query(f"select source, source_id, name_type, country as country_iso2, lower(c_name) as folded, cast(sum(n) as int) as evidence_count from ({_RAWSQL}) group by all")
def raw_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return names_etl.dedupe(_raw(spark, d)).select("source", "source_id", "name_type", "country_iso2", F.lower("name_raw").alias("folded"), "evidence_count")


@query(f"""with r as ({_RAWSQL}) select {_KEY} as name_ascii_key, name_type, first(c_name order by n desc, length(c_name), lower(c_name), c_name) as name_nfc, array_to_string(list_sort(list(distinct country)), '|') as countries,
 array_to_string(list_sort(list(distinct source_id)), '|') as source_ids, cast(sum(n) as bigint) as total_evidence_count, cast(count(*) as bigint) as occurrence_count from r group by 1, 2""")
def lexicon_build(spark: SparkSession, d: str) -> DataFrame:
    return names_etl.lexicon(names_etl.normalize(_raw(spark, d))).select("name_ascii_key", "name_type", "name_nfc", "countries", "source_ids", "total_evidence_count", "occurrence_count")


@query(f"with r as ({_RAWSQL}) select distinct name, name_type from (select first(c_name order by n desc, length(c_name), lower(c_name), c_name) as name, name_type from r group by {_KEY}, name_type)")
def unique_names(spark: SparkSession, d: str) -> DataFrame:
    return names_etl.unique_names(names_etl.lexicon(names_etl.normalize(_raw(spark, d))))


@query()
def name_candidates(spark: SparkSession, d: str) -> DataFrame:
    groups = names_etl.groups_table(spark, {"west_african": [["Building", "Bilding"]], "cross_linguistic": [["Machine"]]})
    return names_etl.candidates(names_etl.normalize(_raw(spark, d)), groups).select("candidate_id", "canonical", "variant", "name_type", "confidence", "status")


@query("""with reg as (select c_mktsegment as canonical, c_name as variant, case when c_custkey % 2 = 0 then 'wikidata' else 'curated' end as source, round(c_acctbal, 2) as confidence from customer where c_custkey % 2 = 0)
 select c.c_mktsegment as canonical, c.c_name as variant, coalesce(r.source, '') as source, coalesce(r.confidence, 0.0) as confidence from customer c left join reg r on c.c_mktsegment = r.canonical and c.c_name = r.variant""")
def enriched_left_join(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    published = c.selectExpr("c_mktsegment as canonical", "c_name as variant", "'t' as tradition", "'f' as file")
    reg = c.where("c_custkey % 2 = 0").selectExpr("c_mktsegment as canonical", "c_name as variant", "case when c_custkey % 2 = 0 then 'wikidata' else 'curated' end as source", "array('Q1') as wikidata_qids", "array('NG') as countries", "array('en') as languages", "round(c_acctbal, 2) as confidence", "'2024' as applied_at")
    return names_etl.enriched(published, reg).select("canonical", "variant", "source", "confidence")


# ---- sources and pages ---------------------------------------------------------------------------


@query("select 'n_nationkey: ' || n_nationkey || ' | n_name: ' || n_name || ' | n_regionkey: ' || n_regionkey as text from nation")
def record_texts(spark: SparkSession, d: str) -> DataFrame:
    return files.as_texts(table(spark, d, "nation"))


@query("select s_suppkey as id, s_name as name, cast((select count(*) from supplier where s_nationkey % 2 = 0) as bigint) as total_estimate from supplier where s_nationkey % 2 = 0 order by s_suppkey limit 20 offset 10")
def directory_page(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").selectExpr("s_suppkey as id", "s_name as name", "if(s_nationkey % 2 = 0, 'dentist', 'gp') as kind", "'SE1' as anchor")
    return places_lookup.directory(rows, "dentist", 20, "10").select("id", "name", "total_estimate")


# ---- country packs -------------------------------------------------------------------------------


@query("select c_custkey, case c_custkey % 4 when 0 then 'MTN' when 1 then 'Glo' when 2 then '9mobile' end as network, case when c_custkey % 4 < 3 then '+234' || case c_custkey % 4 when 0 then '803' when 1 then '805' else '809' end || lpad(cast(c_custkey as varchar), 7, '0') end as e164 from customer")
def network_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Mobile operator and strict E.164 of Nigerian numbers made from keys; every fourth has an unknown prefix."""
    df = table(spark, d, "customer").selectExpr("c_custkey", "concat(case c_custkey % 4 when 0 then '0803 ' when 1 then '+234 805 ' when 2 then '0809-' else '0700 ' end, lpad(c_custkey, 7, '0')) as phone")
    return jurisdictions.enrich_phones(df, "phone", "NG").select("c_custkey", "network", "e164")


@query("select c_custkey, 'BVN' as id_type, '22' || lpad(cast(c_custkey as varchar), 9, '0') as value, 0.95 as confidence from customer")
def pack_identifiers(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "customer").selectExpr("c_custkey", "concat('bvn: 22', lpad(c_custkey, 9, '0')) as text")
    return df.select("c_custkey", F.explode(F.expr(jurisdictions.pack_ids_sql("text", "NG"))).alias("s")).select("c_custkey", "s.id_type", "s.value", "s.confidence")


@query("select c_custkey, 'Ann ' || c_custkey as \"text\", 'PERSON' as entity_type, 4 as \"start\", cast(8 + length(cast(c_custkey as varchar)) as int) as \"end\" from customer")
def model_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a language model with wrong offsets, repaired."""
    df = table(spark, d, "customer").selectExpr("c_custkey", "concat('Mrs Ann ', c_custkey, ' came') as t", """concat('{"entities": [{"text": "Ann ', c_custkey, '", "type": "person", "start": 90, "end": 99}, {"text": "Zed", "type": "person"}]}') as a""")
    return df.select("c_custkey", F.explode(F.expr(entities.proposals_sql("t", "a"))).alias("e")).select("c_custkey", "e.text", "e.entity_type", "e.start", "e.end")


from veldspar.plans import detection_queries, record_queries  # noqa: E402, F401  (they register their queries)

__all__ = ["oracle_sql", "queries"]
