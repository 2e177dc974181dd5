"""Review of uncertain matches: routing, a decision log, and the state that follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCEPT, REJECT = 0.85, 0.30
STATUSES = ("pending", "approved", "rejected", "escalated", "auto_approved", "auto_rejected")
#: decision -> statuses it may follow
MAY_FOLLOW = {"approved": ("pending", "escalated"), "rejected": ("pending", "escalated"), "escalated": ("pending",)}


def status_sql(confidence: str, accept: float = ACCEPT, reject: float = REJECT) -> str:
    return f"case when {confidence} >= {accept}D then 'auto_approved' when {confidence} <= {reject}D then 'auto_rejected' else 'pending' end"


def route(identities: DataFrame, clustered: DataFrame, accept: float = ACCEPT, reject: float = REJECT) -> DataFrame:
    """A candidate for each member of a merged identity but its first, paired with the first.

    Ids are hashes of the pair, so routing again gives the same candidates.
    """
    merged = identities.where("sources > 1").select("cluster", F.col("confidence").alias("sure"), "match_reasons")
    first = clustered.groupBy("cluster").agg(F.min("entity_id").alias("record_a"))
    pairs = clustered.select("cluster", F.col("entity_id").alias("record_b")).join(first, "cluster").where("record_a <> record_b").join(merged, "cluster")
    return pairs.select(F.sha2(F.concat_ws("|", "record_a", "record_b"), 256).alias("id"), "record_a", "record_b", F.col("sure").alias("confidence"), "match_reasons", F.expr(status_sql("sure", accept, reject)).alias("status"))


def stats(candidates: DataFrame) -> DataFrame:
    """One row: total and the number of each status."""
    return candidates.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in STATUSES))


def pending(candidates: DataFrame) -> DataFrame:
    """Pending candidates, the most confident first."""
    return candidates.where("status = 'pending'").orderBy(F.desc("confidence"), "id")


def decide(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Candidates after a log of decisions (id, seq, status, reviewer, notes), applied in order of seq.

    An illegal decision (of what is already approved or rejected, a second escalation, of an automatic
    verdict) is an error naming the candidate. Equal seq numbers are applied by status.
    """
    log = decisions.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seq", "status", "reviewer", "notes"))).alias("_log"))
    legal = " or ".join(f"(d.status = '{s}' and a.status in ({', '.join(map(repr, may))}))" for s, may in MAY_FOLLOW.items())
    state = f"""aggregate(_log, named_struct('status', status, 'reviewer', cast(null as string), 'notes', cast(null as string)),
        (a, d) -> if({legal}, named_struct('status', d.status, 'reviewer', d.reviewer, 'notes', d.notes), raise_error(concat('cannot set candidate ', id, ' from ', a.status, ' to ', d.status))))"""
    joined = candidates.join(log, "id", "left").withColumn("_s", F.when(F.col("_log").isNotNull(), F.expr(state)))
    return joined.withColumn("status", F.coalesce("_s.status", "status")).withColumn("reviewer", F.col("_s.reviewer")).withColumn("notes", F.col("_s.notes")).drop("_log", "_s")


def latest(exports: DataFrame) -> DataFrame:
    """Imported decisions (id, at, ...), the last of each id; later imports win."""
    order = Window.partitionBy("id").orderBy(F.desc("at"))
    return exports.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
