"""The stateless transforms as streams. The detectors, policy and redaction keep no state between

rows, so a stream runs the very functions that a table does; only reading and writing differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veldspar.operators import audit
from veldspar.plans.process import Options, process


def documents(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the parquet files that appear under a path."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def redact(stream: DataFrame, path: str, checkpoint: str, options: Options = Options(jurisdiction="NG")) -> StreamingQuery:
    """Redacted documents, exactly once a batch, under ``path``."""
    out = process(stream, options).drop("text", "detections")
    return out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audited(stream: DataFrame, path: str, checkpoint: str, options: Options = Options(jurisdiction="NG")) -> StreamingQuery:
    """Audit events of each batch appended to the log; the batch's number makes a repeated batch visible."""

    def append(batch: DataFrame, number: int) -> None:
        events = audit.events_of(process(batch.withColumn("timestamp", F.current_timestamp()), options))
        audit.append(events.withColumn("metadata", F.map_concat("metadata", F.create_map(F.lit("batch"), F.lit(str(number))))), path)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(stream: DataFrame, at: str = "ts", every: str = "1 hour", late: str = "2 hours", key: str = "event_type") -> DataFrame:
    """Events of each kind in tumbling windows; events later than ``late`` are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, every).alias("w"), key).agg(F.count("*").alias("n")).select("w.start", "w.end", key, "n")


def apply(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Any stateless transform of this library, written as parquet."""
    return transform(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
