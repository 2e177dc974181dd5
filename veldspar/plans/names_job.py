"""The names dataset as one job: raw evidence in, lexicon, unique names, candidates and counts out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veldspar.operators import names_etl
from veldspar.sources import files


def build(spark: SparkSession, raw: DataFrame, out: str, groups: dict[str, list[list[str]]] | None = None, curated: DataFrame | None = None) -> DataFrame:
    """Writes normalized, lexicon, unique and candidates under ``out``; returns the bundle's counts.

    Invalid evidence is an error that shows the first twenty rows.
    """
    rows = raw.unionByName(curated) if curated is not None else raw
    bad = names_etl.invalid(rows).limit(20).collect()
    if bad:
        raise ValueError("; ".join(f"{r.source_id}: {', '.join(r.errors)}" for r in bad))
    names_etl.normalize(names_etl.dedupe(rows)).write.mode("overwrite").parquet(f"{out}/normalized")
    normal = spark.read.parquet(f"{out}/normalized")
    names_etl.lexicon(normal).write.mode("overwrite").parquet(f"{out}/lexicon")
    lexicon = spark.read.parquet(f"{out}/lexicon")
    files.publish(names_etl.unique_names(lexicon).orderBy("name_type", "name"), f"{out}/unique", "csv")
    found = names_etl.candidates(normal, names_etl.groups_table(spark, groups or {"cross_linguistic": []}))
    found.write.mode("overwrite").parquet(f"{out}/candidates")
    return names_etl.bundle_counts(spark.read.parquet(f"{out}/candidates"))
