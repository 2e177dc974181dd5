"""Queries of resolution, relations, review, audit, names pipeline and sources, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.data import names, places
from veldspar.functions import crypto, similarity
from veldspar.functions.shared import scratch, table
from veldspar.operators import audit, linkage, names_etl, places_lookup, relate, requests, resolve, review
from veldspar.plans.registered import query
from veldspar.plans.registry import _LOG, _entities, _events, _turns
from veldspar.sources import files

_NONE = "cast(map() as map<string,string>)"


# ---- resolution ----------------------------------------------------------------------------------


def _customers(spark: SparkSession, d: str, kind: str, text: str, ident: str = "c_custkey", metadata: str = _NONE) -> DataFrame:
    return table(spark, d, "customer").selectExpr(
        f"cast({ident} as bigint) as entity_id", f"{text} as text", f"{kind} as entity_type", "0.9D as confidence", "0 as start", f"cast(char_length({text}) as int) as end", "'regex' as source", f"{metadata} as metadata", "c_custkey", "c_nationkey")


_PHONE = "lpad(cast(c_custkey as string), 7, '0')"


@query("select c_custkey as cluster, 2 as sources, 2 - 1 as aliases, 'merged_2_mentions' as reason from customer where c_custkey % 2 = 0 union all select c_custkey, 1, 0, null from customer where c_custkey % 2 = 1")
def linked_records(spark: SparkSession, d: str) -> DataFrame:
    """Two sets of records that share every other phone number, written differently."""
    a = _customers(spark, d, "'PHONE'", f"concat('+234 803 ', {_PHONE})").drop("c_custkey", "c_nationkey")
    b = _customers(spark, d, "'PHONE'", f"concat('+234803', {_PHONE})", "1000000000 + c_custkey").where("c_custkey % 2 = 0").drop("c_custkey", "c_nationkey")
    found, _ = resolve.link(a, b)
    return found.select("cluster", F.col("sources").cast("int").alias("sources"), F.size("aliases").alias("aliases"), F.expr("get(match_reasons, 0)").alias("reason"))


@query("select c_custkey as a, c_custkey % 50 as b from customer where c_custkey >= 50")
def shared_identifier_links(spark: SparkSession, d: str) -> DataFrame:
    """Persons whose records share a phone number are one, through the smallest of them."""
    record = "map('patient_id', concat('p', c_custkey))"
    persons = _customers(spark, d, "'PERSON'", "c_name", metadata=record)
    numbers = _customers(spark, d, "'PHONE'", "concat('0803 ', lpad(cast(c_custkey % 50 as string), 7, '0'))", "1000000000 + c_custkey", record)
    return resolve.shared_links(persons.unionByName(numbers).drop("c_custkey", "c_nationkey")).select("a", "b")


@query("""select 'cluster-' || c_nationkey as cluster_id, cast(count(*) as int) as identifiers, cast(count(*) as int) as telecom, min(lpad(cast(c_custkey as string), 11, '7')) as first_identifier, cast(count(*) as int) as source_systems,
 any_value('1990-01-0' || (c_nationkey % 9 + 1)) as birth_date from customer group by c_nationkey""")
def identity_records(spark: SparkSession, d: str) -> DataFrame:
    """Typed fields of an identity gathered from its mentions; every nation is one identity here."""
    pid = "'patient_id', concat('p', c_custkey)"
    rows = [
        _customers(spark, d, "'PERSON'", "c_name", "c_custkey * 4", f"map({pid})"), _customers(spark, d, "'NATIONAL_ID'", "lpad(cast(c_custkey as string), 11, '7')", "c_custkey * 4 + 1", f"map({pid}, 'country', 'NG', 'id_type', 'NIN')"),
        _customers(spark, d, "'PHONE'", f"concat('0803', {_PHONE})", "c_custkey * 4 + 2", f"map({pid})"), _customers(spark, d, "'DATE'", "concat('1990-01-0', c_nationkey % 9 + 1)", "c_custkey * 4 + 3", "map('date_type', 'birth')"),
    ]
    mentions = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).withColumnRenamed("c_nationkey", "cluster").drop("c_custkey")
    found = resolve.identity_records(mentions, resolve.collapse(mentions))
    return found.select("cluster_id", F.size("identifiers").alias("identifiers"), F.size("telecom").alias("telecom"), F.expr("array_min(transform(identifiers, x -> x.value))").alias("first_identifier"), F.size("source_systems").alias("source_systems"), "birth_date")


@query("select count(*) as identity_count, count(*) filter (n > 1) as duplicate_count, cast(sum(n) as bigint) as entity_count from (select c_nationkey, count(*) as n from customer group by 1)")
def identity_counters(spark: SparkSession, d: str) -> DataFrame:
    mentions = _customers(spark, d, "'PERSON'", "c_name").withColumnRenamed("c_nationkey", "cluster")
    return resolve.counters(resolve.collapse(mentions))


_NTH = "row_number() over (partition by c_custkey % 40 order by c_custkey)"


@query(f"with e as (select c_custkey as entity, c_custkey % 40 as place, {_NTH} as nth from customer), v as (select c_custkey as evidence, c_custkey % 40 as place, {_NTH} as nth from customer where c_custkey % 3 = 0) select entity, evidence from e join v using (place, nth)")
def evidence_back_match(spark: SparkSession, d: str) -> DataFrame:
    """Each entity meets the first unused evidence of its place and text."""
    rows = table(spark, d, "customer").selectExpr("c_custkey", "cast(c_custkey % 40 as int) as start", "cast(c_custkey % 40 + 3 as int) as end", "concat('t', c_custkey % 40) as text")
    return resolve.back_match(rows.withColumnRenamed("c_custkey", "entity_id"), rows.where("c_custkey % 3 = 0").withColumnRenamed("c_custkey", "evidence_id"))


_LABELS = [("first_name", "PERSON"), ("employer", "ORGANIZATION"), ("postcode", "LOCATION"), ("phone_number", "PHONE"), ("bvn", "NATIONAL_ID"), ("swift_bic", "MONEY"), ("date_of_birth", "DATE"), ("email", "EMAIL"), ("custom", "CUSTOM")]


@query(f"select c_custkey as entity_id, [{', '.join(repr(t) for _, t in _LABELS)}][cast(c_custkey % {len(_LABELS)} as int) + 1] as entity_type, case when c_custkey % 2 = 0 then 'NG' end as country, 'd' || c_custkey as patient_id from customer")
def typed_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence labels as entity types; country and document as metadata."""
    rows = table(spark, d, "customer").selectExpr(
        "c_custkey as entity_id", "c_name as text", f"array({', '.join(repr(a) for a, _ in _LABELS)})[cast(c_custkey % {len(_LABELS)} as int)] as label", "0.9D as confidence", "0 as start", "4 as end", "'regex' as detector_source",
        "if(c_custkey % 2 = 0, 'NG', '') as country_hint", "concat('d', c_custkey) as document_id", f"{_NONE} as metadata")
    found = resolve.evidence_to_entities(rows)
    return found.select("entity_id", "entity_type", F.col("metadata")["country"].alias("country"), F.col("metadata")["patient_id"].alias("patient_id"))


@query("select min(p_partkey) as cluster, p_type as canonical_name, count(*) as sources, 0 as aliases from part group by p_type")
def fuzzy_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Repeated mentions are one identity; the six types are too different to be one."""
    found, _ = resolve.resolve(_entities(table(spark, d, "part"), "p_partkey", "p_type", "ORGANIZATION"))
    return found.select("cluster", "canonical_name", "sources", F.size("aliases").alias("aliases"))


@query()
def trained_linkage(spark: SparkSession, d: str) -> DataFrame:
    """Chances learned from pairs of customers that follow each other: same nation, segment, balance band, phone."""
    c = table(spark, d, "customer").selectExpr("c_custkey as k", "c_nationkey as n", "c_mktsegment as s", "cast(floor(c_acctbal / 2000) as int) as b", "c_custkey div 2 as p")
    pairs = c.toDF("a", "n1", "s1", "b1", "p1").withColumn("b", F.col("a") + 1).join(c.toDF("b", "n2", "s2", "b2", "p2"), "b")
    pairs = pairs.select("a", "b", *(F.expr(f"int({x}1 = {x}2)").alias(x) for x in "nsp"), F.expr("2 - least(abs(b1 - b2), 2)").alias("band"))
    return linkage.trained_links(pairs, ["n", "s", "p", "band"])


# ---- relations -----------------------------------------------------------------------------------


@query("""with a as (select conv_id, min(turn) as turn from conversations where role = 'user' group by 1)
 select t.conv_id as doc_id, t.conv_id * 1000 + a.turn as source_id, t.conv_id * 1000 + t.turn as target_id, case when t.role = 'user' then 'ASSOCIATED_WITH' else 'LOCATED_AT' end as relation,
  cast(0.9 as double) as confidence, 'proximity:' || abs(t.turn * 150 - (a.turn * 150 + 10)) || '_chars' as evidence from conversations t join a using (conv_id) where t.turn <> a.turn""")
def entity_relationships(spark: SparkSession, d: str) -> DataFrame:
    """Everything in a run of mentions belongs to its first, most confident person."""
    return relate.relationships(relate.gap_groups(_turns(spark, d))).select("doc_id", "source_id", "target_id", "relation", "confidence", "evidence")


_POINTS = "(values " + ", ".join("('{}', {}, {})".format(c[0].replace("'", "''"), c[4], c[5]) for c in places.cities()) + ") v(id, lat, lng)"


@query(f"""with p as (select id, cast(lat as double) as lat, cast(lng as double) as lng from {_POINTS}), d as (select x.id as a, y.id as b, round(2 * 6371.0 * asin(sqrt(pow(sin((radians(y.lat) - radians(x.lat)) / 2), 2)
 + cos(radians(x.lat)) * cos(radians(y.lat)) * pow(sin((radians(y.lng) - radians(x.lng)) / 2), 2))), 3) as km from p x join p y on x.id < y.id) select * from d where km <= 300""")
def nearby_cities(spark: SparkSession, d: str) -> DataFrame:
    """Cities within 300 km of each other, through grid cells."""
    points = files.gazetteer(spark).select(F.col("name").alias("id"), "lat", "lng")
    return relate.nearby(points, points, 300).where("a < b")


_NAMES = "[" + ", ".join("'" + c[0].replace("'", "''") + "'" for c in places.cities()) + "]"
_PICK = f"cast(s_suppkey % {len(places.cities()) + 1} as int)"


@query(f"with e as (select s_suppkey as entity_id, {_NAMES}[{_PICK} + 1] as id, s_suppkey % 2 = 0 as is_place from supplier) select entity_id, case when is_place then lat end as lat, case when is_place then lng end as lng from e left join (select id, cast(lat as double) as lat, cast(lng as double) as lng from {_POINTS}) using (id)")
def located_entities(spark: SparkSession, d: str) -> DataFrame:
    """Locations get the coordinates of their city; other entities and unknown places get none."""
    known = "array(" + ", ".join("'" + c[0].upper().replace("'", "\\'") + "'" for c in places.cities()) + ", 'Nowhere')"
    rows = table(spark, d, "supplier").selectExpr("s_suppkey as entity_id", f"{known}[{_PICK}] as text", "if(s_suppkey % 2 = 0, 'LOCATION', 'PERSON') as entity_type")
    return relate.with_locations(rows, files.gazetteer(spark)).select("entity_id", "lat", "lng")


@query("""with e as (select conv_id, conv_id * 1000 + turn as id, text, case when role = 'user' then 'PERSON' else 'LOCATION' end as t from conversations)
 select 'node' as part, t as kind, count(*) as n from e group by all union all
 select 'edge', 'CO_MENTIONED', count(*) from e x join e y on x.conv_id = y.conv_id and x.id < y.id and (x.text <> y.text or x.t <> y.t)""")
def knowledge_graph(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by type and edges by relation of the graph of all conversations."""
    nodes, edges = relate.graph(_turns(spark, d))
    a = nodes.groupBy(F.col("entity_type").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("node").alias("part"), "kind", "n")
    return a.unionByName(edges.groupBy(F.col("relation").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("part"), "kind", "n"))


# ---- names ---------------------------------------------------------------------------------------

_MEMBERS = [(g[0], n) for g in names.GROUPS for n in g if n.isascii() and n.isalpha() and g[0].isascii() and g[0].isalpha() and sum(n.lower() in (m.lower() for m in other) for other in names.GROUPS) == 1 == sum(g[0].lower() in (m.lower() for m in other) for other in names.GROUPS)]
_VALUES = "(values " + ", ".join(f"('{a}', '{b}')" for a, b in _MEMBERS) + ") v(a, b)"


@query(f"select s_suppkey as k, a, b, true as known, case when lower(a) = lower(b) then cast(1 as double) else round(least(0.6 + 0.4 * jaro_winkler_similarity(lower(a), lower(b)), 1), 4) end as score from supplier, {_VALUES}")
def equivalent_names(spark: SparkSession, d: str) -> DataFrame:
    """Each name of a group against its canonical form."""
    same = similarity.Equivalence()
    pairs = ", ".join(f"named_struct('a', '{a}', 'b', '{b}')" for a, b in _MEMBERS)
    df = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.expr(f"inline(array({pairs}))"))
    known = similarity.mapped(lambda n: str(same.known(n)).lower())(F.col("b")).cast("boolean")
    return df.select("k", "a", "b", known.alias("known"), similarity.paired(same.score)(F.col("a"), F.col("b")).alias("score"))


@query("select c_custkey as source_id, case when c_custkey % 4 = 1 then 'name_type is not given or family' when c_custkey % 4 = 2 then 'country_iso2 is not two capitals' else 'evidence_count is below 1' end as error from customer where c_custkey % 4 > 0")
def invalid_evidence(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "customer").selectExpr("'w' as source", "c_custkey as source_id", "c_name as name_raw", "if(c_custkey % 4 = 1, 'nick', 'given') as name_type", "if(c_custkey % 4 = 2, 'ng', 'NG') as country_iso2", "if(c_custkey % 4 = 3, 0, 1) as evidence_count")
    return names_etl.invalid(raw).select("source_id", F.explode("errors").alias("error"))


_FILES = "(values ('west', 'Building'), ('east', 'Machine')) v(file, canonical)"
_VARIANTS = "select distinct c_mktsegment as canonical, c_mktsegment || (c_custkey % 3) as variant from customer where c_custkey % 2 = 0"


@query(f"with g as (select file, canonical from {_FILES}), n as ({_VARIANTS}), p as (select case when canonical = 'MACHINERY' then 'east' else 'cross_linguistic' end as file, canonical, variant from n) select file, canonical, canonical as variant from g union select file, canonical, variant from p union select file, canonical, canonical from p")
def approved_variants(spark: SparkSession, d: str) -> DataFrame:
    """Name groups after the approved candidates: those of a suggested file that exists go there."""
    groups = names_etl.groups_table(spark, {"west": [["Building"]], "east": [["Machine"]]})
    reviewed = table(spark, d, "customer").selectExpr(
        "concat('c', c_custkey) as candidate_id", "c_mktsegment as canonical", "concat(c_mktsegment, c_custkey % 3) as variant", "if(c_mktsegment = 'MACHINERY', 'east', 'nowhere') as suggested_tradition",
        "if(c_custkey % 2 = 0, 'approved', 'rejected') as status", "'w' as source", "'CC0' as source_license")
    return names_etl.apply_approved(groups, reviewed).select("file", "canonical", "variant")


@query("select count(*) as total, count(*) filter (c_custkey % 3 = 0) as pending, count(*) filter (c_custkey % 3 = 1) as approved, count(*) filter (c_custkey % 3 = 2) as rejected, count(*) filter (c_custkey % 5 = 0) as conflicts from customer")
def review_bundle(spark: SparkSession, d: str) -> DataFrame:
    """Counts of a review bundle written as files and read back."""
    rows = table(spark, d, "customer").selectExpr("concat('c', lpad(c_custkey, 9, '0')) as candidate_id", "c_name as variant", "array('NG', 'GH') as countries", "array('pending', 'approved', 'rejected')[cast(c_custkey % 3 as int)] as status", "c_custkey % 5 = 0 as conflict_flag")
    path = scratch(spark, "bundle")
    names_etl.write_bundle(rows, path)
    return names_etl.bundle_counts(spark.read.option("header", True).option("inferSchema", True).csv(f"{path}/review_candidates"))


# ---- review, audit, requests -----------------------------------------------------------------------


@query("select c_custkey as id, case c_custkey % 4 when 0 then 'approved' when 1 then 'rejected' when 2 then 'escalated' else 'pending' end as status, case c_custkey % 4 when 0 then 'bo' when 1 then 'al' when 2 then 'al' end as reviewer from customer")
def review_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Candidates after a log of decisions: escalated then approved, rejected, escalated, untouched."""
    c = table(spark, d, "customer")
    log = c.selectExpr("c_custkey as id", "inline(case c_custkey % 4 when 0 then array(named_struct('seq', 1, 'status', 'escalated', 'reviewer', 'al'), named_struct('seq', 2, 'status', 'approved', 'reviewer', 'bo'))"
                       " when 1 then array(named_struct('seq', 1, 'status', 'rejected', 'reviewer', 'al')) when 2 then array(named_struct('seq', 1, 'status', 'escalated', 'reviewer', 'al')) else cast(array() as array<struct<seq:int,status:string,reviewer:string>>) end)")
    found = review.decide(c.selectExpr("c_custkey as id", "'pending' as status"), log.withColumn("notes", F.lit("")))
    return found.select("id", "status", "reviewer")


@query("select c_custkey as id, cast(round(c_acctbal, 2) as double) as confidence, c_custkey % 7 as at from customer where c_custkey % 3 = 0")
def pending_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Pending candidates, after later imports have replaced earlier ones."""
    c = table(spark, d, "customer").selectExpr("c_custkey as id", "if(c_custkey % 3 = 0, 'pending', 'approved') as status", "round(c_acctbal, 2) as confidence", "c_custkey % 7 as at")
    both = c.unionByName(c.withColumn("at", F.col("at") - 1).withColumn("confidence", F.lit(0.0)).withColumn("status", F.lit("pending")))
    return review.pending(review.latest(both)).select("id", "confidence", "at")


@query(f"select id, document_hash, category, case when id % 4 = 0 then 'kept' end as note from ({_LOG}) where event_type = 'policy' and category = 'PII-click'")
def audit_append(spark: SparkSession, d: str) -> DataFrame:
    """Events appended in two batches by day, without values that leak, and queried."""
    events = _events(spark, d).withColumn("metadata", F.expr("if(id % 4 = 0, map('text', 'secret', 'note', 'kept'), cast(map('text', 'secret') as map<string,string>))"))
    path = scratch(spark, "audit")
    for part in (0, 1):
        audit.append(events.where(f"id % 2 = {part}"), path)
    found = audit.query(spark.read.parquet(path), category="PII-click", event_type="policy")
    leaked = F.when(F.map_contains_key("metadata", F.lit("text")), F.raise_error(F.lit("a value leaked"))).otherwise(F.col("metadata")["note"])
    return found.select("id", "document_hash", "category", leaked.alias("note"))


@query(f"select id, category, action from ({_LOG})")
def audit_export(spark: SparkSession, d: str) -> DataFrame:
    """One JSON line an event, parsed again."""
    events = _events(spark, d).withColumn("metadata", F.expr(_NONE))
    return audit.export(events).select(F.from_json("event", "id long, category string, action string").alias("e")).select("e.*")


@query("select s_suppkey as k, s_suppkey % 4 = 0 as accepted, case s_suppkey % 4 when 1 then 'purpose' when 2 then 'jurisdiction' when 3 then 'expired' end as reason from supplier")
def accepted_envelopes(spark: SparkSession, d: str) -> DataFrame:
    """Signed envelopes are refused for their expiry, purpose or jurisdiction, in that order."""
    from datetime import datetime

    seed = bytes(range(32))
    body = "concat('{\"purpose\":\"', if(s_suppkey % 4 = 1, 'sale', 'audit'), '\",\"jurisdiction\":\"', if(s_suppkey % 4 = 2, 'KE', 'NG'), '\",\"expires_at\":\"', if(s_suppkey % 4 = 3, '2020', '2030'), '-01-01 00:00:00\"}')"
    df = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), crypto.signed(F.expr(body), seed).alias("token"))
    return requests.accept(df, key=crypto.public_key(seed), purposes=["audit"], jurisdictions=["NG"], now=datetime(2024, 6, 1)).select("k", "accepted", "reason")


# ---- sources and places ------------------------------------------------------------------------------


@query("select cast(n_nationkey as bigint) as n_nationkey, n_name, cast(n_regionkey as bigint) as n_regionkey, f from nation, (values ('csv'), ('jsonl')) v(f)")
def records_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """A small table published as CSV and as JSON lines and scanned under a schema; a missing path is an empty table."""
    schema, out = "n_nationkey bigint, n_name string, n_regionkey bigint", None
    for kind in ("csv", "jsonl", "none"):
        path = scratch(spark, kind)
        if kind != "none":
            files.publish(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, kind)
        rows = files.records(spark, f"{path}/*.csv" if kind == "csv" else f"{path}/*.json", schema).withColumn("f", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("select cast(r_regionkey as bigint) as k, 'Region ' || r_name || chr(10) || 'is no. ' || r_regionkey || '.' as text from region")
def file_texts(spark: SparkSession, d: str) -> DataFrame:
    """Plain files read whole, a row a file, with normal white space."""
    path = scratch(spark, "texts")
    table(spark, d, "region").selectExpr("r_regionkey as k", "concat('Region ', r_name, '  \\r\\nis no. ', r_regionkey, '.\\n\\n') as value").repartition("k").write.partitionBy("k").text(path)
    found = files.texts(spark, f"{path}/*/*.txt")
    return found.select(F.regexp_extract("source_file", "k=([0-9]+)", 1).cast("bigint").alias("k"), "text")


@query("select s_suppkey as k, case when s_suppkey % 3 = 0 then 'no anchor' else 'ok' end as status, case when s_suppkey % 3 > 0 then 'SE1 ' || (s_suppkey % 10) || 'EH' end as anchor, case when s_suppkey % 3 > 0 then 'place' || (s_suppkey % 10) end as place from supplier")
def anchored_places(spark: SparkSession, d: str) -> DataFrame:
    """Dentists near the postcode that a question names."""
    asked = table(spark, d, "supplier").selectExpr("s_suppkey as k", "if(s_suppkey % 3 = 0, 'a dentist in Nigeria', concat('find a dentist near SE1 ', s_suppkey % 10, 'EH')) as text")
    known = spark.range(10).selectExpr("concat('place', id) as id", "concat('place', id) as name", "'dentist' as kind", "concat('SE1 ', id, 'EH') as anchor", "100 as distance_m").unionByName(
        spark.range(10).selectExpr("concat('far', id) as id", "concat('far', id) as name", "'dentist' as kind", "concat('SE1 ', id, 'EH') as anchor", "900 as distance_m"))
    found = places_lookup.anchored(asked, known)
    return found.select("k", "status", "anchor", F.col("place.name").alias("place"))


@query("select s_suppkey as id, 'Call [REDACTED:STAFF_PHONE]' as note, 'note' as field from supplier where s_suppkey % 2 = 0 union all select s_suppkey, 'Open ' || s_suppkey, null from supplier where s_suppkey % 2 = 1")
def place_redaction(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").selectExpr("s_suppkey as id", "if(s_suppkey % 2 = 0, concat('Call 020 7946 0', lpad(s_suppkey % 1000, 3, '0')), concat('Open ', s_suppkey)) as note")
    done = places_lookup.redact(rows, ["note"])
    return done.select("id", "note", F.expr("get(redacted_fields, 0)").alias("field"))


@query("select s_name as raw, cast(null as string) as uprn, cast(0 as double) as match_weight from supplier")
def canonical_addresses(spark: SparkSession, d: str) -> DataFrame:
    return places_lookup.canonical_addresses(table(spark, d, "supplier").select(F.col("s_name").alias("raw")))


@query("select c_custkey as k, case when c_custkey < 1000 then '***' else left(c_custkey::string, 3) || '***' end as masked from customer")
def masked_values(spark: SparkSession, d: str) -> DataFrame:
    """Log-safe forms of values."""
    from veldspar.operators import policy

    return table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.expr(policy.masked_sql("cast(c_custkey as string)")).alias("masked"))
