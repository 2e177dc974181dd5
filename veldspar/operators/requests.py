"""Signed documents and data-subject requests as table transforms."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldspar.functions import crypto

# Statute -> (short name, regulator, {request: (citation, what is asked, days)}).
_DAYS = 30
REQUESTS = {
    "NDPA-2023": ("NDPA 2023", "Nigeria Data Protection Commission (NDPC)", {
        "access": ("NDPA-2023 s.34 (Right of Access)", "access to all personal data that you hold concerning me", _DAYS),
        "rectification": ("NDPA-2023 s.35 (Right to Rectification)", "rectification of inaccurate or incomplete personal data you hold concerning me", _DAYS),
        "erasure": ("NDPA-2023 s.36 (Right to Erasure)", "erasure of all personal data you hold concerning me, where the lawful basis no longer applies", _DAYS),
        "portability": ("NDPA-2023 s.38 (Right to Data Portability)", "transfer of my personal data in a structured, commonly used, and machine-readable format", _DAYS),
        "objection": ("NDPA-2023 s.37 (Right to Object)", "that you cease further processing of my personal data for the purposes I am objecting to", _DAYS),
    }),
    "POPIA": ("POPIA", "Information Regulator (South Africa)", {
        "access": ("POPIA s.23 (Access to personal information)", "access to all personal information you hold concerning me", _DAYS),
        "rectification": ("POPIA s.24 (Correction of personal information)", "correction or deletion of personal information that is inaccurate, irrelevant, excessive, out of date, incomplete, misleading, or obtained unlawfully", _DAYS),
        "erasure": ("POPIA s.24 (Destruction or deletion of personal information)", "destruction or deletion of personal information that you are no longer authorised to retain", _DAYS),
        "portability": ("POPIA Conditions for Lawful Processing (Condition 8: Data subject participation)", "provision of my personal information in a usable, structured electronic format", _DAYS),
        "objection": ("POPIA s.11(3) (Objection to processing)", "that you cease further processing of my personal information", _DAYS),
    }),
    "KENYA-DPA": ("Kenya DPA 2019", "Office of the Data Protection Commissioner (ODPC)", {
        "access": ("Kenya DPA s.26(a) (Right of Access)", "access to my personal data held by you", _DAYS),
        "rectification": ("Kenya DPA s.26(d) (Right to Rectification)", "correction of false or misleading data concerning me", _DAYS),
        "erasure": ("Kenya DPA s.40 (Deletion of false or misleading data)", "deletion of false, misleading, or unlawfully obtained personal data concerning me", _DAYS),
    }),
}


def specs(spark: SparkSession) -> DataFrame:
    rows = [(s, k, short, regulator, *v) for s, (short, regulator, kinds) in REQUESTS.items() for k, v in kinds.items()]
    return spark.createDataFrame(rows, "statute string, request_type string, statute_short string, regulator string, citation string, asked string, days int")


def drafts(targets: DataFrame, requests: DataFrame, today: str, acknowledge_days: int = 7) -> DataFrame:
    """A letter for each target (organization, address) of each request (request_id, statute, request_type, name, identifier_label, identifier_value, contact, purpose, deadline_days).

    A request of a kind that its statute does not know is an error.
    """
    known = F.broadcast(specs(requests.sparkSession))  # a fixed dimension
    df = requests.join(known, ["statute", "request_type"], "left").join(targets, "request_id")
    checked = F.when(F.col("citation").isNull(), F.raise_error(F.format_string("no %s request under %s", "request_type", "statute"))).otherwise(F.col("citation"))
    days = F.coalesce("deadline_days", "days")
    body = F.concat_ws(
        "\n", F.lit(today), F.lit(""), F.concat(F.lit("To: "), "organization"), F.coalesce("address", F.lit("[Address on file]")), F.lit(""),
        F.concat(F.lit("Re: "), F.initcap("request_type"), F.lit(" request under "), "statute_short"), F.lit(""),
        F.concat(F.lit("I am "), "name", F.lit(" ("), "identifier_label", F.lit(": "), "identifier_value", F.lit(").")),
        F.concat(F.lit("Under "), "citation", F.lit(" I request "), "asked", F.lit(".")),
        F.when(F.col("purpose") != "", F.concat(F.lit("Context: "), "purpose")), F.lit(""),
        F.concat(F.lit("Please acknowledge within "), F.lit(str(acknowledge_days)), F.lit(" days and answer within "), days.cast("string"), F.lit(" days. Otherwise I may turn to the "), "regulator", F.lit(".")),
        F.when(F.col("contact") != "", F.concat(F.lit("Contact: "), "contact")))
    return df.select("request_id", "organization", "statute", "request_type", checked.alias("citation"), F.date_add(F.lit(today).cast("date"), days).alias("deadline"), body.alias("letter_text"), F.lit("draft_only").alias("dispatch_mode"))


def envelope(processed: DataFrame, issuer: str, purpose: str, issued_at: str, expires_at: str | None = None, with_text: bool = False) -> DataFrame:
    """document_hash and ``envelope``: canonical JSON of a processed document, keys sorted, without its audit log.

    The texts of detections stay out unless asked for: they are what the redaction removed.
    """

    def plain(value: object) -> object:
        if isinstance(value, list):  # Arrow gives maps as lists of pairs
            return dict(value) if value and all(isinstance(v, tuple) for v in value) else [plain(v) for v in value]
        if isinstance(value, dict):
            return {k: {} if k == "metadata" and not v else plain(v) for k, v in value.items() if with_text or k != "text"}
        return value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                body = {
                    "doc_hash": row["document_hash"], "detections": plain(row["detections"] or []), "policy_outcomes": plain(row["policy_outcomes"] or []), "redacted_text": row["redacted_text"],
                    "issuer": issuer, "issued_at": issued_at, "expires_at": expires_at, "purpose": purpose, "jurisdiction": row["jurisdiction"], "statute": row["statute_id"],
                }
                made.append(crypto.canonical(body))
            yield pa.RecordBatch.from_arrays([batch.column("document_hash"), pa.array(made, pa.string())], names=["document_hash", "envelope"])

    return processed.select("document_hash", "detections", "policy_outcomes", "redacted_text", "jurisdiction", "statute_id").mapInArrow(run, "document_hash string, envelope string")


def expired_sql(expires_at: str, now: str = "current_timestamp()") -> str:
    """Whether an ISO time has passed; one that cannot be read has not."""
    return f"coalesce(try_to_timestamp({expires_at}) < {now}, false)"


def accept(tokens: DataFrame, column: str = "token", key: bytes | None = None, purposes: list[str] | None = None, jurisdictions: list[str] | None = None, now: datetime | None = None) -> DataFrame:
    """``accepted`` and ``reason`` of each signed envelope: signature, expiry, purpose, jurisdiction, in that order."""
    df = tokens.withColumn("_v", crypto.verified(F.col(column), key))
    get = lambda p: f"get_json_object(_v.payload, '$.{p}')"
    at = f"timestamp'{now:%Y-%m-%d %H:%M:%S}'" if now else "current_timestamp()"
    one = lambda p, allowed: f"{get(p)} is null or not {get(p)} in ({', '.join(map(repr, allowed))})" if allowed else "false"
    reason = f"case when not _v.valid then _v.error when {expired_sql(get('expires_at'), at)} then 'expired' when {one('purpose', purposes)} then 'purpose' when {one('jurisdiction', jurisdictions)} then 'jurisdiction' end"
    return df.withColumn("reason", F.expr(reason)).withColumn("accepted", F.col("reason").isNull()).withColumn("payload", F.col("_v.payload")).drop("_v")


def receipt(report: dict, seed: bytes, schema: str = "place_report.v1") -> dict:
    """A signed summary of a report with a readable copy beside the signature; ``seed`` is the issuer's key."""
    did = crypto.did_of(crypto.public_key(seed))
    body = {"schema": schema} | report
    return {"schema": schema, "issuer_did": did, "jws": crypto.jws(body, seed, did, "receipt+jws"), "payload_preview": body}


def signed_bundle(events: DataFrame, seed: bytes, purpose: str = "audit_export", most: int = 100_000) -> str:
    """A JWS over the events of an audit export; an export of more than ``most`` events is an error, sign its files instead."""
    from veldspar.operators import audit

    rows = [r.event for r in audit.export(events).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"more than {most} events")
    did = crypto.did_of(crypto.public_key(seed))
    return crypto.jws({"events": rows, "count": len(rows), "purpose": purpose, "issuer": did}, seed, did, "audit-export")
