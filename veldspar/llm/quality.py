"""Quality classifier: boosted trees over statistics of the whole text.

``statistics`` turns a text into a row of numbers (no language, source or id among them); ``fit`` trains
on a bounded sample of labelled documents; ``score`` runs the trees, flattened into arrays, over whole
Arrow batches at once (``gbdt.Trees.margin``).

Scale. Scoring is one narrow pass. The sample is at most ``SAMPLE`` documents, those with the smallest
hash of their id, found by a top-k over the labels alone; it is the only thing that reaches the driver
(about 20 numbers a document), and the only thing broadcast (its ids). The trees are a few kilobytes.

Defined results: null text is an empty text and gets a score like any other; a null label is no label,
of several labels of a document the lowest counts; repeated rows give repeated output rows; a null
doc_id is never held out; without labels every score is 0.5; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldspar.functions.shared import checkpointed
from veldspar.llm import gbdt

#: Bound on the labelled documents that are trained on.
SAMPLE = 20_000

STATISTICS = [
    "log_words", "log_chars", "word_length", "long_words", "short_words", "distinct", "top_word", "adjacent", "once",
    "upper", "digits", "symbols", "marks", "bangs", "bars", "stops", "commas", "stop_gap", "lines", "line_words",
    "same_lines", "short_lines", "other", "worst_upper", "worst_symbols", "worst_distinct",
]
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")
_ODD = re.compile(r"[^\w\s.,;:!?'\"()-]")
_SYMBOL = re.compile(r"[#*$%&|<>@~^=+{}\[\]\\/]")
#: Words of a window (a last one of half as many or fewer belongs to the one before); the worst window catches texts that are junk in part.
WINDOW = 60


def statistics(text: str | None) -> list[float]:
    """The values of STATISTICS for one text."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, chars = len(words), len(text)
    lengths = list(map(len, words))
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()] or [""]
    stops = text.count(".")
    upper, symbols, distinct = [], [], []
    starts = range(0, max(1, n - WINDOW // 2), WINDOW)
    for at in starts:
        part = words[at : at + WINDOW if at != starts[-1] else n]
        joined = "".join(part)
        upper.append(len(_UPPER.findall(joined)) / len(joined))
        symbols.append(len(_SYMBOL.findall(joined)) / len(joined))
        distinct.append(len(set(part)) / len(part))
    return [
        float(np.log1p(n)),
        float(np.log1p(chars)),
        sum(lengths) / n,
        sum(x > 14 for x in lengths) / n,
        sum(x < 3 for x in lengths) / n,
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(eq, words, words[1:])) / n,
        sum(c == 1 for c in counts.values()) / n,
        sum(upper) / len(upper),
        len(_DIGIT.findall(text)) / chars,
        sum(symbols) / len(symbols),
        (text.count("!") + text.count("?")) / n,
        text.count("!!") / n,
        text.count("|") / n,
        stops / n,
        text.count(",") / n,
        n / (stops + 1),
        float(np.log1p(len(lines))),
        n / len(lines),
        1 - len(set(lines)) / len(lines),
        sum(len(x) < 30 for x in lines) / len(lines),
        len(_ODD.findall(text)) / chars,
        max(upper),
        max(symbols),
        min(distinct),
    ]


def _rows(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t) for t in texts.to_pylist()], float).reshape(-1, len(STATISTICS))


def held_out(doc_id: str | Column) -> Column:
    """Documents whose labels are kept from training: crc32 of the id as text leaves 1 when divided by 3."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, **how) -> gbdt.Trees:
    """Trees trained on at most ``sample`` labelled documents that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
    known = known.where("doc_id is not null and y is not null").where(~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = checkpointed(known)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = texts.join(F.broadcast(known), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch.column("text"))
            values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), values], names=["doc_id", "y", "x"])

    # repeated rows of a document count once, so the result is as bounded as the sample
    measured = chosen.mapInArrow(run, "doc_id long, y double, x array<double>").groupBy("doc_id").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    found = sorted(measured.collect())
    x = np.array([r.x for r in found], float).reshape(-1, len(STATISTICS))
    return gbdt.fit(x, np.array([r.y for r in found], float), **how)


def score(docs: DataFrame, trees: gbdt.Trees) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = trees.probability(_rows(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
