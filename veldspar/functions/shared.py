"""Small helpers that every operator uses."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names built from ``stems`` that no column of ``df`` has (names compare without case, as Spark's do)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"_v_{stem}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the columns as they are, behind a projection that the optimizer neither inlines nor pushes filters through.

    ``explode`` of a column implies a filter on its size; pushed down, that filter would evaluate the
    whole chain of expressions that makes the column once more, and beneath a repartition at that.
    The optimizer knows the range of ``rand`` and folds comparisons with it, so ``randn`` it is.
    """
    return df.withColumns({c: F.when(F.randn(0) < 1e9, F.col(f"`{c}`")) for c in columns})


def texts_of(column: pa.Array, rows: int = 500) -> Iterator[str | None]:
    """The texts of a batch; a few hundred rows at a time are Python objects, the rest stays Arrow.

    Workers are kept between stages and seldom give memory back, so one large batch would count until the session ends.
    """
    for at in range(0, len(column), rows):
        yield from column.slice(at, rows).to_pylist()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The session's folder under spark.checkpoint.dir, which the cluster names; a folder of our own only on one machine."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="veldspar-"))
    return context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, stem: str) -> str:
    """A path for a written table under the shared checkpoint folder."""
    return f"{_shared_folder(spark)}/{stem}-{uuid.uuid4().hex}"


def scratch_table(spark: SparkSession, stem: str) -> tuple[str, str]:
    """Name and path of a catalog table under the shared checkpoint folder."""
    return f"veldspar_{stem}_{uuid.uuid4().hex}", scratch(spark, stem)


def sweep(spark: SparkSession) -> None:
    """Delete what this session has checkpointed and written under the shared folder, and its catalog tables.

    For callers to use once their results are consumed: a DataFrame made before needs what this deletes.
    """
    root = spark.sparkContext.getCheckpointDir()
    for found in spark.catalog.listTables():
        if found.name.startswith("veldspar_"):
            spark.sql(f"drop table if exists `{found.name}`")
    if root is not None:
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(root)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in files.listStatus(folder):
            files.delete(status.getPath(), True)


#: Rows up to which a narrow dimension counts as small enough to broadcast (some 10 MB at 100 bytes a row).
SMALL_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` (checkpointed or written, with narrow rows) hinted for broadcast if a count proves it small; else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if its scan has fewer splits than there are cores (one small file, say); else as it is.

    For work that is heavy for each row. Inputs with enough splits are never shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def self_pairs(rows: DataFrame, block: list[str], order: str, chunk: int = 4096) -> DataFrame:
    """Every pair of rows of a block once: the block's columns, ``a`` and ``b`` (structs of the other columns), a.order < b.order.

    Blocks of more than ``chunk`` rows are dealt into chunks by a hash of ``order`` and each pair of chunks
    is a join key of its own, so a hot block is spread over tasks of at most two chunks, and a row is copied
    once for each chunk of its block. Null block keys and null orders meet nothing.
    """
    rest = [c for c in rows.columns if c not in block]
    many = rows.groupBy(*block).count().where(F.col("count") > chunk).select(*block, F.ceil(F.col("count") / chunk).cast("int").alias("_chunks"))
    dealt = rows.join(many, block, "left").withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))
    dealt = dealt.withColumn("_own", F.pmod(F.xxhash64(order), F.col("_chunks")).cast("int"))
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    key = [*block, "_low", "_high"]
    dealt = dealt.select(*block, F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high"), "_own", F.struct(*rest).alias("_row"))
    left = dealt.select(*key, F.col("_own").alias("_own_a"), F.col("_row").alias("a"))
    right = dealt.select(*key, F.col("_own").alias("_own_b"), F.col("_row").alias("b"))
    met = left.join(right, key).where((F.col("_low") == F.col("_high")) | (F.col("_own_a") != F.col("_own_b")))
    return met.where(F.col(f"a.{order}") < F.col(f"b.{order}")).select(*block, "a", "b")
