"""Documents to identities: extract, resolve, find personal data, locate, relate, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldspar.functions.shared import checkpointed
from veldspar.operators import audit, entities, policy, relate, resolve
from veldspar.sources import files


@dataclass(frozen=True)
class Resolution:
    entities: DataFrame
    identities: DataFrame
    pii: DataFrame
    locations: DataFrame
    nodes: DataFrame
    edges: DataFrame
    texts: DataFrame
    entry: DataFrame


def resolve_documents(docs: DataFrame, text: str = "text", redact: str | None = None, groups: list[list[str]] | None = None, types: list[str] | None = None) -> Resolution:
    """The whole chain over a table of documents (doc_id, text); ``redact`` names a strategy for the texts.

    Every part is a table; entity ids number the mentions of the whole table.
    """
    found = entities.personal_data(entities.extract(docs, text, "entities", types), text, "pii")
    each = found.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.*").withColumn("entity_id", F.monotonically_increasing_id())
    each = checkpointed(each)
    identities, clustered = resolve.resolve(each.drop("doc_id"), groups)
    spark = docs.sparkSession
    gaz = files.gazetteer(spark)
    where = relate.with_locations(each, gaz).where("lat is not null")
    places = where.select(F.col("text").alias("name"), F.col("geo_country").alias("country"), F.lit(1.0).alias("confidence")).distinct()
    nodes, edges = relate.graph(each, clustered, identities, places)
    texts = policy.redact(found, text, "pii", redact, "text_out") if redact else found.withColumn("text_out", F.col(text))
    pii = found.select("doc_id", F.explode("pii").alias("p")).select("doc_id", "p.*")
    return Resolution(each, identities, pii, where, nodes, edges, texts.select("doc_id", F.col("text_out").alias("text")), audit.entry(docs, text))
