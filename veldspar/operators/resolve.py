"""Entity resolution: blocked pairs, scores, clusters, identities.

Entities are rows with a stable order column: entity_id, text, entity_type, confidence, start, end, source,
metadata (map, may hold patient_id, country, id_type, date_type). Pairs come from an equi-join on a
blocking key, never from all pairs of a type; clusters from ``components.connected_components``.

Scale. Name blocks are one first letter wide, which grows with the square of the block; pass a finer
``key`` (a column expression) where letters are few. The pairs of a hot letter are dealt over many tasks
(``shared.self_pairs``). Identifier blocks are whole values: all equal, so
each member only links to the block's smallest (no pairs at all). Repeated texts of a block are folded
to one representative before names are compared, so copies cost nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldspar.data import names as data
from veldspar.functions import checks, similarity
from veldspar.functions.shared import checkpointed, self_pairs
from veldspar.operators.components import connected_components

EXACT = ("PHONE", "NATIONAL_ID", "EMAIL")
NAMES = ("PERSON", "ORGANIZATION", "LOCATION")
THRESHOLD = 0.80


def with_keys(entities: DataFrame, strict: bool = False) -> DataFrame:
    """``key`` (blocking) and ``value`` (what is compared). ``strict`` drops every mark of an identifier."""
    exact = F.col("entity_type").isin(*EXACT)
    marks = "[^a-zA-Z0-9]" if strict else r"[\s\-\(\)\+]+"
    plain = F.lower(F.regexp_replace("text", marks, ""))
    folded = similarity.mapped(lambda t: similarity.strip_marks(t.strip().lower())[:1])(F.col("text"))
    return entities.withColumn("key", F.when(exact, plain).otherwise(folded))


def _representatives(keyed: DataFrame) -> DataFrame:
    """Smallest id of each (entity_type, key, text), and links of the others to it."""
    return keyed.groupBy("entity_type", "key", "text").agg(F.min("entity_id").alias("rep"))


def _copies(keyed: DataFrame, reps: DataFrame) -> DataFrame:
    back = keyed.join(reps, ["entity_type", "key", "text"]).where("entity_id <> rep")
    return back.select(F.col("entity_id").alias("a"), F.col("rep").alias("b"))


def _equal_keys(keyed: DataFrame) -> DataFrame:
    """Identifiers with equal keys: a link to the smallest of them."""
    exact = keyed.where(F.col("entity_type").isin(*EXACT)).where("key <> ''")
    least = exact.groupBy("entity_type", "key").agg(F.min("entity_id").alias("rep"))
    return exact.join(least, ["entity_type", "key"]).where("entity_id <> rep").select(F.col("entity_id").alias("a"), F.col("rep").alias("b"))


def blocked_pairs(keyed: DataFrame, value: str = "text") -> DataFrame:
    """Pairs of distinct texts of a block, the smaller id first: entity_type, a, b, text_a, text_b."""
    reps = _representatives(keyed).select("entity_type", "key", "rep", F.col(value).alias("value"))
    return self_pairs(reps, ["entity_type", "key"], "rep").select("entity_type", F.col("a.rep").alias("a"), F.col("b.rep").alias("b"), F.col("a.value").alias("text_a"), F.col("b.value").alias("text_b"))


def fuzzy_links(entities: DataFrame, groups: list[list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Links by word-sorted similarity, by equivalent names for persons, by equality for identifiers."""
    keyed = checkpointed(with_keys(entities))
    pairs = blocked_pairs(keyed.where(~F.col("entity_type").isin(*EXACT)))
    same = similarity.Equivalence(groups)
    near = similarity.paired(similarity.token_sort)(F.col("text_a"), F.col("text_b"))
    alike = F.when(F.col("entity_type") == "PERSON", similarity.paired(same.score)(F.col("text_a"), F.col("text_b"))).otherwise(0.0)
    scored = pairs.withColumn("near", near).withColumn("alike", alike).where(F.greatest("near", "alike") >= threshold)
    reps = _representatives(keyed.where(~F.col("entity_type").isin(*EXACT)))
    return scored.select("a", "b").unionByName(_copies(keyed, reps)).unionByName(_equal_keys(keyed))


def score_links(entities: DataFrame, jurisdiction: str = "default", threshold: float = THRESHOLD, groups: list[list[str]] | None = None) -> DataFrame:
    """Links by the matcher's posterior of each type's own field."""
    keyed = checkpointed(with_keys(entities, strict=True))
    named = keyed.where(~F.col("entity_type").isin(*EXACT))
    pairs = blocked_pairs(named)
    by_name = pairs.where("entity_type <> 'ISBN'")
    scored = with_name_score(by_name, "text_a", "text_b", jurisdiction, groups).where(F.col("score") >= threshold)
    books = pairs.where("entity_type = 'ISBN'").where(f"{checks.same_isbn_sql('text_a', 'text_b')} = 1D")
    links = scored.select("a", "b").unionByName(books.select("a", "b")).unionByName(_copies(keyed, _representatives(named))).unionByName(_equal_keys(keyed))
    return links


def with_name_score(pairs: DataFrame, a: str, b: str, jurisdiction: str = "default", groups: list[list[str]] | None = None) -> DataFrame:
    """similarity, u (chance of agreement) and score of two name columns."""
    base, _, common = data.PRIORS.get(jurisdiction, data.PRIORS["default"])
    same = similarity.Equivalence(groups)

    def value(x: str, y: str) -> float:
        p, q = similarity.normal_text(x), similarity.normal_text(y)
        if not p or not q:
            return 0.0
        if p == q:
            return 1.0
        alike = same.score(x, y)
        return alike if alike >= THRESHOLD else max(similarity.jaro_winkler(p, q), similarity.token_sort(p, q))

    def chance(x: str, y: str) -> float:
        p, q = similarity.normal_text(x), similarity.normal_text(y)
        if not p or not q:
            return base
        words = [p] if p == q else [*p.split(), *q.split()]
        return common.get(p, base) if p == q else max([base, *(common.get(w, 0.0) for w in words)])

    out = pairs.withColumn("similarity", similarity.paired(value)(F.col(a), F.col(b))).withColumn("u", similarity.paired(chance)(F.col(a), F.col(b)))
    weight = checks.log_odds_sql("similarity", f"{data.FIELDS['name'][0]}D", "u")
    return out.withColumn("score", F.expr(f"round({checks.posterior_sql(weight)}, 4)"))


FIELDS = ("name", "phone", "national_id", "email", "address", "dob", "isbn")


def match_records(pairs: DataFrame, jurisdiction: str = "default", groups: list[list[str]] | None = None) -> DataFrame:
    """score, decision, factors and explanation of pairs with columns <field>_a and <field>_b (null or empty: not compared).

    Missing field columns are not compared either.
    """
    have = [f for f in FIELDS if f"{f}_a" in pairs.columns and f"{f}_b" in pairs.columns]
    name_u, address_u, _ = data.PRIORS.get(jurisdiction, data.PRIORS["default"])
    df = pairs
    if "name" in have:
        df = with_name_score(df, "name_a", "name_b", jurisdiction, groups).withColumnsRenamed({"similarity": "_name", "u": "_name_u"}).drop("score")
    if "address" in have:
        def near(x: str, y: str) -> float:
            p, q = similarity.normal_text(x), similarity.normal_text(y)
            return 0.0 if not p or not q else 1.0 if p == q else max(similarity.token_sort(p, q), similarity.jaro_winkler(p, q))

        df = df.withColumn("_address", similarity.paired(near)(F.col("address_a"), F.col("address_b")))
    exact = {"phone": checks.same_phone_sql, "national_id": checks.same_id_sql, "email": checks.same_email_sql, "dob": checks.same_date_sql, "isbn": checks.same_isbn_sql}
    # each agreement is a column of its own: three expressions read it, and none of them gets long
    df = df.withColumns({f"_{f}": F.expr(sql(f"{f}_a", f"{f}_b")) for f, sql in exact.items() if f in have})
    weights, factors, notes = [], [], []
    texts = {"phone": "phone match", "national_id": "national ID match", "email": "email match", "dob": "DOB match", "isbn": "ISBN match"}
    for f in have:
        there = f"coalesce({f}_a, '') <> '' and coalesce({f}_b, '') <> ''"
        value = f"_{f}"
        m, u = data.FIELDS[f]
        chance = "_name_u" if f == "name" else f"{address_u}D" if f == "address" else f"{u}D"
        weights.append(f"if({there}, {checks.log_odds_sql(value, f'{m}D', chance)}, 0D)")
        factors.append(f"if({there}, map('{f}', round({value}, 4)), map())")
        if f in texts:
            notes.append(f"if({there} and {value} >= 0.99, '{texts[f]}', null)")
        else:
            notes.append(f"if({there} and {value} >= 0.8, concat('{f} similarity ', cast(round({value} * 100) as int), '%'), null)")
    total = " + ".join(weights) or "0D"
    df = df.withColumn("_weight", F.expr(total)).withColumn("score", F.expr(checks.posterior_sql("_weight"))).withColumn("decision", F.expr(checks.decision_sql("score")))
    df = df.withColumn("factors", F.expr(f"map_concat({', '.join(f'cast({x} as map<string,double>)' for x in factors)})" if factors else "cast(map() as map<string,double>)"))
    df = df.withColumn("explanation", F.expr(f"coalesce(nullif(concat_ws('; ', {', '.join(notes)}), ''), 'no strong signals')" if notes else "'no strong signals'"))
    return df.withColumn("score", F.round("score", 4)).drop("_weight", "_name_u", *(f"_{f}" for f in FIELDS))


def shared_links(entities: DataFrame, through_value: bool = True) -> DataFrame:
    """Links across types over patient_id.

    through_value: persons of any patient that shares a phone or identifier value are one. Otherwise a
    patient's phones and identifiers join its persons.
    """
    rows = entities.select("entity_id", "entity_type", "text", F.col("metadata")["patient_id"].alias("pid")).where("coalesce(pid, '') <> ''")
    persons = rows.where("entity_type = 'PERSON'").select("pid", F.col("entity_id").alias("person"))
    values = rows.where("entity_type in ('PHONE', 'NATIONAL_ID')")
    if not through_value:
        # through the patient's smallest person: every pair would be their product
        first = persons.groupBy("pid").agg(F.min("person").alias("hub"))
        some = values.select("pid", "entity_id").unionByName(persons.join(values.select("pid").distinct(), "pid").select("pid", F.col("person").alias("entity_id")))
        return some.join(first, "pid").where("entity_id <> hub").select(F.col("entity_id").alias("a"), F.col("hub").alias("b"))
    met = values.select("entity_type", F.lower(F.regexp_replace("text", r"[\s\-\(\)\+]+", "")).alias("value"), "pid").distinct().join(persons, "pid").select("entity_type", "value", "person").distinct()
    hub = met.groupBy("entity_type", "value").agg(F.min("person").alias("hub"))
    return met.join(hub, ["entity_type", "value"]).where("person <> hub").select(F.col("person").alias("a"), F.col("hub").alias("b"))


def clusters(entities: DataFrame, links: DataFrame) -> DataFrame:
    """``entities`` with ``cluster``: the smallest entity_id reachable."""
    found = connected_components(links)
    out = entities.join(found.select(F.col("node").alias("entity_id"), "component"), "entity_id", "left")
    return out.withColumn("cluster", F.coalesce("component", "entity_id")).drop("component")


def collapse(clustered: DataFrame) -> DataFrame:
    """One identity a cluster: the longest mention (the first of equals) names it."""
    longest = F.struct(F.length("text").alias("size"), (-F.col("entity_id")).alias("early"))
    out = clustered.groupBy("cluster").agg(
        F.max_by("text", longest).alias("canonical_name"),
        F.max_by("entity_type", longest).alias("entity_type"),
        F.collect_set("text").alias("texts"),
        F.round(F.avg("confidence"), 4).alias("confidence"),
        F.count("*").alias("sources"),
        F.count_distinct(F.when(F.col("metadata")["patient_id"] != "", F.col("metadata")["patient_id"])).alias("patients"),
        F.max((F.col("source") == "fhir").cast("int")).alias("fhir"),
        F.max((F.col("entity_type") == "PHONE").cast("int")).alias("phones"),
        F.max((F.col("entity_type") == "NATIONAL_ID").cast("int")).alias("ids"),
    )
    reasons = """if(sources > 1, filter(array(concat('merged_', sources, '_mentions'), if(patients > 1, concat('cross_system_match:', patients, '_sources'), null),
        if(fhir = 1, 'fhir_resolved', null), if(phones = 1, 'phone_match', null), if(ids = 1, 'national_id_match', null)), r -> r is not null), cast(array() as array<string>))"""
    return out.select("cluster", "canonical_name", "entity_type", F.expr("array_sort(filter(texts, t -> t <> canonical_name))").alias("aliases"), "confidence", "sources", F.expr(reasons).alias("match_reasons"))


def resolve(entities: DataFrame, groups: list[list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(identities, clustered entities) by fuzzy links."""
    links = fuzzy_links(entities, groups).unionByName(shared_links(entities))
    clustered = checkpointed(clusters(entities, links))
    return collapse(clustered), clustered


def link(*record_sets: DataFrame, jurisdiction: str = "default", threshold: float = THRESHOLD, groups: list[list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(identities, clustered entities) of several sets of records, by the matcher; entity_ids must differ across sets.

    The set's number becomes metadata link_source where there is none.
    """
    tagged = None
    for i, rows in enumerate(record_sets):
        source = F.map_from_arrays(F.array(F.lit("link_source")), F.array(F.lit(f"source_{i}")))
        own = rows.withColumn("metadata", F.when(F.col("metadata")["link_source"].isNull(), F.map_concat(F.coalesce("metadata", F.expr("cast(map() as map<string,string>)")), source)).otherwise(F.col("metadata")))
        tagged = own if tagged is None else tagged.unionByName(own)
    links = score_links(tagged, jurisdiction, threshold, groups).unionByName(shared_links(tagged, through_value=False))
    clustered = checkpointed(clusters(tagged, links))
    return collapse(clustered), clustered


def counters(identities: DataFrame) -> DataFrame:
    """identity_count, duplicate_count, entity_count."""
    return identities.agg(F.count("*").alias("identity_count"), F.count_if(F.col("sources") > 1).alias("duplicate_count"), F.coalesce(F.sum("sources"), F.lit(0)).alias("entity_count"))


_PERSON = ("person", "first_name", "last_name", "full_name", "title", "occupation", "job_title")
_TYPES = {
    "PERSON": _PERSON,
    "ORGANIZATION": ("organization", "company", "employer"),
    "LOCATION": ("location", "street_address", "city", "state", "postcode", "country", "address"),
    "PHONE": ("phone", "phone_number"),
    "NATIONAL_ID": ("national_id", "nin", "bvn", "ghana_card", "kenya_id", "sa_id", "tin", "pvc", "aadhaar", "passport_number", "ssn"),
    "MONEY": ("money", "currency", "account_number", "swift_bic"),
    "DATE": ("date", "date_of_birth", "time"),
}


def evidence_to_entities(evidence: DataFrame) -> DataFrame:
    """Evidence rows (text, label, confidence, start, end, detector_source, country_hint, document_id, metadata, entity_id) as entities."""
    kind = F.upper("label")
    for name, labels in _TYPES.items():
        kind = F.when(F.lower("label").isin(*labels), name).otherwise(kind)
    extra = F.expr("""map_concat(map_filter(coalesce(metadata, cast(map() as map<string,string>)), (k, v) -> not (k = 'country' and coalesce(country_hint, '') <> '') and not (k = 'patient_id' and coalesce(document_id, '') <> '')),
        if(coalesce(country_hint, '') <> '', map('country', country_hint), cast(map() as map<string,string>)), if(coalesce(document_id, '') <> '', map('patient_id', document_id), cast(map() as map<string,string>)))""")
    return evidence.select("entity_id", "text", kind.alias("entity_type"), "confidence", "start", "end", F.col("detector_source").alias("source"), extra.alias("metadata"))


def identity_records(clustered: DataFrame, identities: DataFrame) -> DataFrame:
    """Identities with typed arrays of identifiers, telecom and addresses, birth date and source systems."""
    m = F.col("metadata")
    order = F.col("entity_id")
    gather = lambda when, *cols: F.array_sort(F.collect_list(F.when(when, F.struct(order.alias("at"), *cols))))
    member = clustered.groupBy("cluster").agg(
        gather(F.col("entity_type") == "NATIONAL_ID", F.coalesce(m["system"], F.lit("")).alias("system"), F.col("text").alias("value"), F.coalesce(m["country"], F.lit("")).alias("country"), F.coalesce(m["id_type"], F.lit("NATIONAL_ID")).alias("type")).alias("identifiers"),
        gather(F.col("entity_type").isin("PHONE", "EMAIL"), F.lower("entity_type").alias("system"), F.col("text").alias("value")).alias("telecom"),
        gather(F.col("entity_type") == "LOCATION", F.col("text")).alias("addresses"),
        F.max_by(F.when((F.col("entity_type") == "DATE") & (m["date_type"] == "birth"), F.col("text")), F.when((F.col("entity_type") == "DATE") & (m["date_type"] == "birth"), order)).alias("birth_date"),
        F.array_sort(F.collect_set(F.when(m["patient_id"] != "", m["patient_id"]))).alias("source_systems"),
    )
    names = F.concat(F.array("canonical_name"), "aliases")
    return identities.join(member, "cluster").select(F.concat(F.lit("cluster-"), "cluster").alias("cluster_id"), "canonical_name", names.alias("names"), "identifiers", "telecom", "addresses", "birth_date", "source_systems", "confidence", "match_reasons")


def back_match(entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each entity with the first unused evidence of the same start, end and text: a join on the n-th of its kind."""
    same = ["start", "end", "text"]
    nth = lambda df, key, name: df.withColumn("nth", F.row_number().over(Window.partitionBy(*same).orderBy(key))).select(F.col(key).alias(name), *same, "nth")
    return nth(entities, "entity_id", "entity").join(nth(evidence, "evidence_id", "evidence"), [*same, "nth"]).select("entity", "evidence")
