"""The audit log: an append-only table of events without personal data, and what is read from it."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = "id long, timestamp timestamp, event_type string, document_hash string, detection_id string, category string, span_start int, span_end int, confidence double, action string, statute_id string, statute_reference string, detector string, model_version string, metadata map<string,string>, prev_hash string, signature string"
LEAKS = ("text", "value", "raw", "content")


def scrub(events: DataFrame) -> DataFrame:
    """Metadata without the keys that could hold a detected value."""
    return events.withColumn("metadata", F.expr(f"map_filter(metadata, (k, v) -> not lower(k) in ({', '.join(map(repr, LEAKS))}))"))


def append(events: DataFrame, path: str) -> None:
    """Write scrubbed events, partitioned by day; a failed write leaves no part of itself."""
    scrub(events).withColumn("event_date", F.to_date("timestamp")).write.mode("append").partitionBy("event_date").parquet(path)


def query(events: DataFrame, document_hash: str | None = None, category: str | None = None, event_type: str | None = None, since: datetime | None = None, until: datetime | None = None, limit: int | None = None) -> DataFrame:
    """Events that meet every filter given, by id. Equality and time filters reach the scan."""
    df = events
    for column, value in (("document_hash", document_hash), ("category", category), ("event_type", event_type)):
        if value is not None:
            df = df.where(F.col(column) == value)
    moment = lambda at: F.lit(at.isoformat(sep=" ")).cast(events.schema["timestamp"].dataType)  # noqa: E731  read in the session's time zone, as the column is
    if since is not None:
        df = df.where(F.col("timestamp") >= moment(since))
    if until is not None:
        df = df.where(F.col("timestamp") <= moment(until))
    df = df.orderBy("id")
    return df.limit(limit) if limit is not None else df


def policy_counts(events: DataFrame) -> DataFrame:
    """Policy events by statute, category and action, with the first reference of each."""
    acted = events.where("event_type = 'policy' and coalesce(category, '') <> '' and coalesce(action, '') <> '' and coalesce(statute_id, '') <> ''")
    ref = F.when(F.col("statute_reference") != "", F.col("statute_reference"))
    return acted.groupBy("statute_id", "category", "action").agg(F.count("*").alias("n"), F.min_by(ref, F.when(ref.isNotNull(), F.col("id"))).alias("statute_reference"))


def type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def summary(events: DataFrame) -> DataFrame:
    return events.agg(F.count("*").alias("events"), F.count_distinct("document_hash").alias("documents"))


def report(events: DataFrame, title: str = "Compliance report") -> str:
    """The counts as Markdown: as many lines as there are kinds of policy actions and events."""
    total = summary(events).first()
    if not total.events:
        return f"# {title}\n\nNo audit events in scope.\n"
    lines = [f"# {title}", "", f"Total events: {total.events}  ", f"Distinct documents: {total.documents}", "", "## Policy actions taken", "", "| Statute | Category | Action | Count | Reference |", "|---|---|---|---:|---|"]
    lines += [f"| {r.statute_id} | {r.category} | {r.action} | {r.n} | {r.statute_reference or ''} |" for r in policy_counts(events).orderBy("statute_id", "category", "action").collect()]
    lines += ["", "## Event-type breakdown", "", "| Event type | Count |", "|---|---:|"]
    lines += [f"| {r.event_type} | {r.n} |" for r in type_counts(events).orderBy("event_type").collect()]
    return "\n".join(lines) + "\n"


def export(events: DataFrame) -> DataFrame:
    """One JSON line an event, for a bundle; ``summary`` has its counts."""
    return scrub(events).select(F.to_json(F.struct(*[c for c in events.columns])).alias("event"))


def events_of(processed: DataFrame, at: str = "timestamp") -> DataFrame:
    """Detection and policy events of documents that went through ``plans.process``; no text leaves."""
    detected = processed.select(F.col(at).alias("timestamp"), "document_hash", F.explode("detections").alias("d")).select(
        "timestamp", F.lit("detection").alias("event_type"), "document_hash", F.col("d.id").alias("detection_id"), F.col("d.category").alias("category"), F.col("d.start").alias("span_start"), F.col("d.end").alias("span_end"),
        F.col("d.confidence").alias("confidence"), F.lit(None).cast("string").alias("action"), F.lit(None).cast("string").alias("statute_id"), F.lit(None).cast("string").alias("statute_reference"), F.col("d.detector").alias("detector"),
        F.expr("cast(map('sensitivity_tier', d.sensitivity_tier, 'regulatory_citation', d.regulatory_citation) as map<string,string>)").alias("metadata"))
    acted = processed.select(F.col(at).alias("timestamp"), "document_hash", F.explode("policy_outcomes").alias("o")).select(
        "timestamp", F.lit("policy").alias("event_type"), "document_hash", F.col("o.detection_id").alias("detection_id"), F.col("o.category").alias("category"), F.col("o.start").alias("span_start"), F.col("o.end").alias("span_end"),
        F.lit(None).cast("double").alias("confidence"), F.col("o.action").alias("action"), F.col("o.statute_id").alias("statute_id"), F.col("o.statute_reference").alias("statute_reference"), F.lit(None).cast("string").alias("detector"),
        F.expr("cast(map() as map<string,string>)").alias("metadata"))
    return detected.unionByName(acted)


def entry(inputs: DataFrame, text: str = "text") -> DataFrame:
    """Audit entry of each input: its hash and length."""
    return inputs.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("input_hash"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("input_length"))
