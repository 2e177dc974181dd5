"""Quality rules whose thresholds come from the data: quantile sketches per language and source.

1. ``measure`` counts each text once (an Arrow function; the text itself never comes back to the JVM).
2. ``sketches`` builds one quantile sketch per (lang, source) and metric over the documents that pass the
   fixed base rules: counts of bins of a fixed width (1 / ``SHARES`` for shares, a factor of
   e ** (1 / ``LOGS``) for word_length). Sketches merge by adding counts, so the per-language and the
   corpus sketch are merged from the group sketches, not counted again, and a quantile is exact to one bin
   whatever the order of merging: thresholds do not depend on the input's partitions.
3. ``thresholds``: median + ``spread`` * width, a far-out fence, which moves with the group but leaves its
   ordinary documents alone. The width is the quartile distance or, where the upper tail is longer, the
   distance from the median to the 0.9 quantile up to ``TAIL`` floors (more would let junk, where it is a
   tenth of a group, widen its own fence); it is at least the ``floor`` of the metric, the size of a
   few single events in a text (README has figures with and without). The floors keep every fence inside
   what the metric can reach: repeat_share at 0.28 where few documents repeat, below the base rule's 0.30
   at any tail. A group's fence shrinks towards its language's, that towards the corpus's, with the weight
   of ``prior`` documents, so small groups need no rule of their own.
4. ``judge`` joins the thresholds to the documents and drops what lies beyond a fence; a value equal to
   the fence is within it.

Scale. Bins are counted map-side, so a source with a third of all rows sends at most some ten thousand
counts a task, and no group has more rows than that. The thresholds are a checkpointed table of one row a
group; it is broadcast if a count proves it small, else joined by (lang, source), where adaptive
execution may split the hot source. ``filter_documents`` writes the texts with their counts once, so they
are counted once; the thresholds then read the counts alone.

Defined results: null text is an empty text (no words: base_failed); a very long text is counted whole, its
windows ranked in numpy arrays of its length; null lang or source is a group of its own; a group of which
no document passes the base rules has the wider fences; repeated rows are judged one by one; an empty table
gives an empty result; further columns of the input are kept by ``filter_documents`` under their own
names and ignored by ``rate``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions.shared import broadcast_if_small, checkpointed, fresh, scratch, texts_of

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_marks long, n_lines long"
_NAMES = [part.split()[0] for part in MEASURES.split(", ")]
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_SPACE = " \t\n\r\x0b\x0c"
_SYMBOLS = "#*$%&|<>"
_MARKS = "!?|#*$%&<>{}[]=~^\\"
WINDOW = 8

#: metric -> its two measures
PARTS = {
    "symbol_share": ("n_symbols", "word_chars"), "upper_share": ("n_upper", "word_chars"), "mark_share": ("n_marks", "word_chars"),
    "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words"),
}
#: metric -> least width of a fence
FLOORS = {"symbol_share": 0.01, "upper_share": 0.01, "mark_share": 0.005, "dup_line_share": 0.085, "repeat_share": 0.07, "word_length": 0.4}
SPREAD = 4.0
#: Documents that the wider fence counts as.
PRIOR = 20
#: Bins of a share, and of each factor of e in a word length.
SHARES, LOGS = 2048, 256
#: Floors that the upper tail can widen a fence to; the shares that are 0 in ordinary documents keep theirs.
TAIL = {"symbol_share": 1.5, "upper_share": 1.5, "mark_share": 1.5, "dup_line_share": 1.0, "repeat_share": 1.0, "word_length": 1.5}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the list, first occurrences included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    if len(known) == len(words):
        return 0
    # Exact ranks instead of hashes: rank pairs, then pairs of pairs; windows of 8 need three rounds.
    rank, span = ids, 1
    while span < window:
        step = min(span, window - span)
        pair = rank[: len(rank) - step] * (int(rank.max()) + 1) + rank[step:]
        _, rank, counts = np.unique(pair, return_inverse=True, return_counts=True)
        span += step
        if len(counts) == len(rank):
            return 0
    twice = counts[rank] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    covered[:-1] += np.bincount(at, minlength=len(words))
    covered -= np.bincount(at + window, minlength=len(words) + 1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def count_text(text: str | None) -> tuple[int, ...]:
    """The values of MEASURES for one text."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    if not words:
        return (0, 0, sum(map(text.count, _SYMBOLS)), 0, 0, 0, 0, 0)
    lines = [line for line in text.split("\n") if line.strip(_SPACE)]
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACE)),
        sum(map(text.count, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(_UPPER.findall(text)),
        sum(map(text.count, _MARKS)),
        len(lines),
    )


def _measured(text: str | Column) -> Column:
    fields = pa.struct([(n, pa.int64()) for n in _NAMES])

    @F.arrow_udf(f"struct<{', '.join(p.replace(' ', ': ') for p in MEASURES.split(', '))}>")
    def measure(texts: pa.Array) -> pa.Array:
        rows = np.array([count_text(t) for t in texts_of(texts)], np.int64).reshape(-1, len(_NAMES))
        return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(_NAMES))], fields=list(fields))

    # Held to be nondeterministic, else the optimizer copies the call into every filter above it.
    return measure.asNondeterministic()(F.col(text).cast("string") if isinstance(text, str) else text)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])


def metrics(m: Column) -> dict[str, Column]:
    return {k: m[part] / F.greatest(m[whole], F.lit(1)) for k, (part, whole) in PARTS.items()}


def _bins(m: Column) -> list[Column]:
    """The bin of each metric, in the order of FLOORS."""
    return [F.floor(F.log(v) * LOGS) if k == "word_length" else F.floor(v * SHARES) for k, v in metrics(m).items()]


def sketches(measured: DataFrame, m: str, lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, metric (its number in FLOORS), bin and n, the documents in it."""
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("metric"), b.cast("int").alias("bin")) for i, b in enumerate(_bins(F.col(m)))))).alias("s")
    rows = measured.where(~base_failed(F.col(m))).select(F.col(lang).alias("lang"), F.col(source).alias("source"), each)
    return rows.groupBy("lang", "source", "s.metric", "s.bin").agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, keys: list[str], spread: float = SPREAD) -> DataFrame:
    """keys, n (documents) and the array of fences of each sketch, in the order of FLOORS."""
    group = Window.partitionBy(*keys, "metric")
    placed = sketch.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("all_", F.sum("n").over(group))
    value = F.when(F.col("metric") == len(FLOORS) - 1, F.exp(F.col("bin") / LOGS)).otherwise(F.col("bin") / SHARES)
    quantile = lambda x: F.min(F.when(F.col("upto") * 100 >= F.col("all_") * x, value))
    quantiles = placed.groupBy(*keys, "metric").agg(F.sum("n").alias("n"), *(quantile(x).alias(f"q{x}") for x in (25, 50, 75, 90)))
    floor = lambda scale: F.element_at(F.array(*(F.lit(f * scale.get(k, 1.0)) for k, f in FLOORS.items())), F.col("metric") + 1)
    width = F.greatest(F.col("q75") - F.col("q25"), F.least(F.col("q90") - F.col("q50"), floor(TAIL)), floor({}))
    fence = F.col("q50") + F.lit(spread) * width
    return quantiles.groupBy(*keys).agg(F.max("n").alias("n"), F.array(*(F.max(F.when(F.col("metric") == i, fence)) for i in range(len(FLOORS)))).alias("f"))


def thresholds(measured: DataFrame, m: str, lang: str = "lang", source: str = "source", spread: float = SPREAD, prior: int = PRIOR) -> DataFrame:
    """lang, source and the array of upper fences, in the order of FLOORS; one row per group."""
    own = checkpointed(sketches(measured, m, lang, source))
    by_lang = own.groupBy("lang", "metric", "bin").agg(F.sum("n").alias("n"))
    corpus = by_lang.groupBy("metric", "bin").agg(F.sum("n").alias("n"))
    towards = lambda n, f, wide: F.zip_with(f, wide, lambda a, b: (n * a + prior * b) / (n + prior))
    all_ = fences(corpus, [], spread).select(F.col("f").alias("all_"))
    of_lang = fences(by_lang, ["lang"], spread).join(F.broadcast(all_)).select(F.col("lang").alias("of"), towards(F.col("n"), F.col("f"), F.col("all_")).alias("wide"))  # all_: one row
    joined = fences(own, ["lang", "source"], spread).join(of_lang, F.col("lang").eqNullSafe(F.col("of")))
    return joined.select("lang", "source", towards(F.col("n"), F.col("f"), F.col("wide")).alias("fences"))


def judge(df: DataFrame, m: str, kept: str, lang: str = "lang", source: str = "source", spread: float = SPREAD, prior: int = PRIOR) -> DataFrame:
    """``df`` and the boolean column ``kept``; ``m`` names its column of measures."""
    found = thresholds(df, m, lang, source, spread, prior).toDF(*fresh(df, "lang", "source", "fences"))
    return _judged(df, m, kept, found, F.col(lang), F.col(source))


def _judged(df: DataFrame, m: str, kept: str, found: DataFrame, lang: Column, source: Column) -> DataFrame:
    """``found``: lang, source and fences under names that ``df`` lacks."""
    found = broadcast_if_small(checkpointed(found))
    key_lang, key_source, fences = found.columns
    joined = df.join(found, lang.eqNullSafe(F.col(key_lang)) & source.eqNullSafe(F.col(key_source)), "left")
    within = ~base_failed(F.col(m))
    for i, value in enumerate(metrics(F.col(m)).values()):
        within &= F.coalesce(value <= F.col(fences)[i], F.lit(True))
    return joined.withColumn(kept, within).drop(key_lang, key_source, fences)


def rate(docs: DataFrame, spread: float = SPREAD, prior: int = PRIOR) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row."""
    rows = docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), _measured("text").alias("m"))
    rated = judge(checkpointed(rows), "m", "kept", spread=spread, prior=prior)
    counts = [F.col("m")[n].alias(n) for n in _NAMES[:5]]
    return rated.select("doc_id", *counts, base_failed(F.col("m")).alias("base_failed"), "kept")


def filter_documents(docs: DataFrame, spread: float = SPREAD, prior: int = PRIOR) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were.

    Texts and counts are written once under the checkpoint folder and not shuffled.
    """
    m, kept, key_lang, key_source, found_fences = fresh(docs, "m", "kept", "lang", "source", "fences")
    path = scratch(docs.sparkSession, "counted")
    docs.withColumn(m, _measured("text")).toDF(*(f"c{i}" for i in range(len(docs.columns))), m).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path).toDF(*docs.columns, m)
    slim = rows.select(F.col("lang").cast("string"), F.col("source").cast("string"), m)
    found = thresholds(slim, m, spread=spread, prior=prior).toDF(key_lang, key_source, found_fences)
    return _judged(rows, m, kept, found, F.col("lang").cast("string"), F.col("source").cast("string")).where(F.col(kept)).select(*[F.col(f"`{c}`") for c in docs.columns])
