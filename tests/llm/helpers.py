from pyspark.sql import SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, rows, extra: str = ""):
    """Rows of doc_id, text and, if wanted, lang and source."""
    full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), len(r[1]) if r[1] is not None else None) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df


#: Texts that every operator must take: null, empty, blank, ties, long, beyond the BMP.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one"), (5, "one"), (None, "one two three four five six"), (6, None, None, None),
       (7, "é😀 \x00 ß x " * 50, None, "s"), (8, "word " * 30_000), (9, "x" * 60_000)]
