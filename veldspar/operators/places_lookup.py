"""Places named in a text, looked up in tables of places, redacted and reported."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions import spans

# Categories by keyword, vehicles that imply a charger, patterns of staff details.
CATEGORIES = {
    "dentist": "dentist", "dental": "dentist", "physio": "physio", "physiotherapist": "physio", "gp": "gp", "doctor": "gp", "pharmacy": "pharmacy", "chemist": "pharmacy",
    "hospital": "hospital", "ev charger": "ev_charger", "charger": "ev_charger", "charging": "ev_charger", "a&e": "a_and_e", "a and e": "a_and_e", "emergency": "a_and_e", "emergency room": "a_and_e", "accident and emergency": "a_and_e",
}
VEHICLES = r"(?i)\b(?:Tesla|Nissan Leaf|VW ID|BMW i[0-9]|Renault Zoe|Polestar|Mustang Mach-E|EV)\b"
FULL, OUTWARD = r"\b[A-Z]{1,2}[0-9][A-Z0-9]?\s*[0-9][A-Z]{2}\b", r"\b[A-Z]{1,2}[0-9][A-Z0-9]?\b"
LANDMARK = r"\b(?:near|by|at|opposite|behind|next to)\s+(?:the\s+)?(?=[A-Z])[A-Z][\w.\x27]*(?:\s+[A-Z][\w.\x27]*){0,4}"
STAFF = [
    (r"\b(?:Dr|Mr|Mrs|Ms|Miss|Prof)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,3}\b", "[REDACTED:STAFF_NAME]"),
    (r"(?<!\w)\+44\s?[0-9]{2,4}\s?[0-9]{3,4}\s?[0-9]{3,4}\b", "[REDACTED:STAFF_PHONE]"),
    (r"\b0[0-9]{2,4}\s?[0-9]{3,4}\s?[0-9]{3,4}\b", "[REDACTED:STAFF_PHONE]"),
    (r"\b[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+\b", "[REDACTED:EMAIL]"),
]
DEFAULT_CATEGORIES = ("dentist", "ev_charger", "a_and_e")


class UpstreamError(ValueError):
    """A source or a category that cannot be served."""


def mentions_sql(t: str) -> str:
    """Array of (start, end, text, kind, confidence): full postcodes, outward codes elsewhere, landmarks."""
    made = lambda found, kind, sure: f"transform({found}, s -> named_struct('start', s.start, 'end', s.end, 'text', s.m, 'kind', '{kind}', 'confidence', {sure}D))"
    full = made(spans.matches(t, FULL), "postcode", 0.99)
    part = made(spans.matches(t, OUTWARD), "postcode", 0.85)
    head = r"^(?:near|by|at|opposite|behind|next to)\s+(?:the\s+)?"
    land = f"transform({spans.matches(t, LANDMARK)}, s -> transform(array(regexp_replace(s.m, r'{head}', '')), g -> named_struct('start', s.end - char_length(g), 'end', s.end, 'm', g))[0])"
    return f"transform(array({full}), f -> concat(f, filter({part}, s -> not exists(f, o -> o.start <= s.start and o.end >= s.end)), {made(land, 'landmark', 0.8)}))[0]"


def categories_sql(t: str) -> str:
    """Distinct canonical categories in the order of their keywords; an electric vehicle asks for a charger."""
    words = ", ".join(f"if(lower({t}) rlike {spans.quoted('(?<![a-z0-9_])' + k.replace('&', '[&]') + '(?![a-z0-9_])')}, '{c}', null)" for k, c in CATEGORIES.items())
    return f"array_distinct(filter(array({words}, if({t} rlike r'{VEHICLES}', 'ev_charger', null)), c -> c is not null))"


def redact(records: DataFrame, fields: list[str], jurisdiction: str = "GB") -> DataFrame:
    """Staff names, phones and emails masked in the given columns; redacted_fields names those that changed. Only GB has rules."""
    if jurisdiction != "GB":
        return records.withColumn("redacted_fields", F.expr("cast(array() as array<string>)"))
    df, changed = records, []
    for field in fields:
        value = F.col(field)
        for pattern, mark in STAFF:
            value = F.regexp_replace(value, pattern, mark)
        df = df.withColumn(f"_new_{field}", value)
        changed.append(F.when(~F.col(f"_new_{field}").eqNullSafe(F.col(field)), F.lit(field)))
    df = df.withColumn("redacted_fields", F.filter(F.array(*changed), lambda x: x.isNotNull()))
    for field in fields:
        df = df.withColumn(field, F.col(f"_new_{field}")).drop(f"_new_{field}")
    return df


def directory(places: DataFrame, category: str, limit: int, cursor: str | None = None, near: str | None = None) -> DataFrame:
    """One page of a category by id: rows after the offset in ``cursor``, with the total and the next cursor."""
    kind = CATEGORIES.get(category.lower(), category if category in CATEGORIES.values() else None)
    if kind is None:
        raise UpstreamError(f"category {category!r} is not supported; one of {sorted(set(CATEGORIES.values()))}")
    if cursor is not None and not cursor.isdigit():
        raise UpstreamError(f"cursor {cursor!r} is no offset")
    at = int(cursor or 0)
    rows = places.where(F.col("kind") == kind)
    if near is not None:
        rows = rows.where(F.lower("anchor") == near.lower())
    total = rows.agg(F.count("*").alias("total_estimate"))
    page = rows.orderBy("id").offset(at).limit(limit).crossJoin(F.broadcast(total))  # one row
    return page.withColumn("next_cursor", F.when(F.col("total_estimate") > at + limit, F.lit(str(at + limit))))


def anchored(queries: DataFrame, places: DataFrame, text: str = "text", radius_m: int = 500) -> DataFrame:
    """Places (anchor, kind, distance_m, ...) for each query's first anchor and categories; jurisdiction XX is an error row.

    A query without an anchor, or whose anchor is unknown, has no places, which its status says.
    """
    from veldspar.operators import addresses

    t = spans.text_of(text)
    q = queries.withColumn("_m", F.expr(mentions_sql(t))).withColumn("_c", F.expr(categories_sql(t))).withColumn("jurisdiction", F.expr(f"{addresses.jurisdiction_sql(t)}.code"))
    q = q.withColumn("anchor", F.expr("get(_m, 0).text")).withColumn("_kinds", F.expr(f"if(size(_c) > 0, _c, array({', '.join(map(repr, DEFAULT_CATEGORIES))}))"))
    near = places.where(F.col("distance_m") <= radius_m).select(F.upper(F.regexp_replace("anchor", r"\s+", "")).alias("_at"), F.struct(*[c for c in places.columns if c != "anchor"]).alias("place"), F.col("kind").alias("_kind"))
    met = q.join(near, (F.upper(F.regexp_replace("anchor", r"\s+", "")) == F.col("_at")) & F.array_contains("_kinds", F.col("_kind")), "left")
    status = F.expr("case when jurisdiction = 'XX' then 'no jurisdiction' when anchor is null then 'no anchor' when place is null then 'nothing near' else 'ok' end")
    return met.withColumn("status", status).drop("_m", "_c", "_kinds", "_at", "_kind")


def compliance(records: DataFrame, jurisdiction: str = "GB") -> DataFrame:
    policy = "uk_gdpr_v0_hardcoded" if jurisdiction == "GB" else f"{jurisdiction.lower()}_passthrough_v0"
    references = ["UK GDPR Art. 6(1)(e)", "DPA 2018 Sch.2 Part 1"] if jurisdiction == "GB" else []
    fields = F.array_sort(F.array_distinct(F.flatten(F.collect_list("redacted_fields"))))
    return records.agg(F.count("*").alias("places"), fields.alias("redactions_applied")).select(F.lit(jurisdiction).alias("jurisdiction"), F.lit(policy).alias("policy"), "places", "redactions_applied", F.array(*map(F.lit, references)).cast("array<string>").alias("references"))


def canonical_addresses(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Batch canonicalisation has no backend: every address comes back with no reference number and weight 0."""
    return raw.select(F.col(column).alias("raw"), F.lit(None).cast("string").alias("uprn"), F.lit(0.0).alias("match_weight"))


def page_of(rows: DataFrame, order: str, offset: int, limit: int) -> DataFrame:
    """Rows offset + 1 to offset + limit in order, with the total."""
    numbered = rows.withColumn("_n", F.row_number().over(Window.orderBy(order)))
    return numbered.where(F.col("_n").between(offset + 1, offset + limit)).drop("_n")
