"""Temperature mixing of sources, realised as budgeted block permutations. DataFrame functions only.

1. Token totals T of each source; shares p = T / sum(T).
2. Weights w proportional to p ** exponent. The exponent is found by bisection (each round one
   aggregate that tries several exponents at once): the smallest one in [0, 1] at which no source is
   repeated more than ``max_repeats`` times and the entropy of w is at most ``entropy`` times that of
   equal weights. 0 is equal weights, 1 the sources as they are. A repetition limit that even 1 does
   not meet (a budget of more than ``max_repeats`` corpora) is an error.
3. A source's quota is w * budget tokens: whole passes over its documents and a last partial pass.
   Every pass has its own order: blocks (hash groups of about ``BLOCK`` documents) are permuted, and
   documents within blocks. The partial pass leaves out documents longer than itself and takes the others
   while their tokens end within the quota, so it falls short by less than one document.
   Without a ``budget`` it is the smallest that uses every document at least once.

``place`` is the share of the source's quota used before the copy: sorting all copies by it interleaves
the sources at their weights.

Scale. Prefix sums run on three levels: documents within a block, blocks within a span of the pass's
order, spans within the pass. Spans and the blocks of one are about the square root of the blocks, so a
source with a third of all rows fills no task. Texts are tokenised twice, for the plan and for the
result, and shuffled once, by source and block. The driver only sees the trial sums of the bisection.

Defined results: a document has as many tokens as words, one at least, so empty and null texts have a
place too, and a very long text is one document like any other; null source is a source; a source whose
quota is 0 or less than its shortest document gives no rows; rows with equal doc_id are different rows;
equal rows tie and stay together; ``mix`` keeps all columns, whatever their names, and ``realised`` reads
doc_id, source and text alone; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.functions.shared import broadcast_if_small, checkpointed, fresh

BLOCK = 512
#: Exponents tried in one round, and rounds: the exponent is exact to (1 / (TRIES + 1)) ** ROUNDS.
TRIES, ROUNDS = 15, 5
MAX_REPEATS, ENTROPY = 2.0, 0.98


def tokens(text: str) -> Column:
    """Words of a text, one at least."""
    return F.greatest(F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)), F.lit(1)).cast("long")


def exponent(totals: DataFrame, budget: int | None = None, max_repeats: float = MAX_REPEATS, entropy: float = ENTROPY) -> float:
    """The smallest exponent that meets both limits; ``totals`` has a row (t) for each source."""
    row = totals.agg(F.sum("t").alias("all"), F.count("*").alias("n"), F.max("t").alias("most"), F.min("t").alias("least")).first()
    total, n = row["all"], row["n"]
    if not n or n == 1:
        return 1.0
    most, least = row["most"] / total, row["least"] / total
    if budget is not None and budget > max_repeats * total * (1 + 1e-9):
        raise ValueError(f"a budget of {budget} tokens repeats {total} tokens more than {max_repeats} times")

    def met(a: float, z: float, zlog: float) -> bool:
        """z: sum of p ** a; zlog: sum of p ** a * ln(p)."""
        repeats = (most / least) ** (1 - a) if budget is None else budget / total * least ** (a - 1) / z
        return repeats <= max_repeats * (1 + 1e-9) and math.log(z) - a * zlog / z <= max(entropy * math.log(n), floor) + 1e-12

    p = F.col("t") / F.lit(total)
    sums = lambda k, a: [F.sum(F.pow(p, F.lit(a))).alias(f"z{k}"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"l{k}")]
    low, high, floor = 0.0, 1.0, 0.0
    for _ in range(ROUNDS):
        trials = [low + (high - low) * k / (TRIES + 1) for k in range(TRIES + 2)]
        row = totals.agg(*(s for k, a in enumerate(trials) for s in sums(k, a))).first()
        if high == 1.0:  # the sources as they are may already be more even than asked
            floor = math.log(row[f"z{TRIES + 1}"]) - row[f"l{TRIES + 1}"] / row[f"z{TRIES + 1}"]
        good = next(k for k, a in enumerate(trials) if a == 1.0 or met(a, row[f"z{k}"], row[f"l{k}"]) or k == TRIES + 1)
        if good == 0:
            return trials[0]
        low, high = trials[good - 1], trials[good]
    return high


def _keyed(source: str) -> Column:
    """A null source is a source: joins use a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _spot(doc_id: str, text: str) -> Column:
    return F.xxhash64(doc_id, text)


def quotas(sizes: DataFrame, budget: int | None = None, max_repeats: float = MAX_REPEATS, entropy: float = ENTROPY) -> tuple[DataFrame, int]:
    """m_key, st, mix_weight, passes (whole), rest (tokens of the partial pass), quota of the sources with a quota; and the row count.

    ``sizes``: m_key and t (tokens) of each document.
    """
    totals = checkpointed(sizes.groupBy("m_key").agg(F.sum("t").alias("t"), F.count("*").alias("n")))
    a = exponent(totals, budget, max_repeats, entropy)
    row = totals.agg(F.sum("n").alias("n"), F.max("t").alias("most"), F.sum(F.pow("t", F.lit(a))).alias("z")).first()
    most, z = row["most"] or 1, row["z"] or 1.0
    scaled = F.pow("t", F.lit(a))
    if budget is None:
        quota = F.greatest(F.round(scaled * F.lit(float(most) ** (1 - a))).cast("long"), F.col("t"))
    else:
        quota = F.round(scaled * F.lit(budget / z)).cast("long")
    out = totals.withColumn("mix_weight", scaled / F.lit(z)).withColumn("quota", quota).where("quota > 0")
    return out.select("m_key", F.col("t").alias("st"), "mix_weight", F.expr("quota div t").cast("int").alias("passes"), F.expr("quota % t").alias("rest"), "quota"), row["n"] or 0


def _passes(held: DataFrame, blocks: int, seed: int) -> DataFrame:
    """Each block's place in each pass: the columns of ``held`` and mix_pass and before (tokens of the pass before the block).

    ``held``: a row for each block, with its tokens (bt), those of documents that the partial pass takes (fit), and its source's plan.
    """
    each = held.withColumn("mix_pass", F.explode(F.sequence(F.lit(0), F.expr("passes - int(rest = 0)"))))
    each = each.withColumn("b", F.expr("if(mix_pass < passes, bt, fit)")).withColumn("o", F.xxhash64("m_block", "mix_pass", F.lit(seed)))
    bits = max(1, math.ceil(math.log2(max(2, blocks)) / 2))
    each = each.withColumn("m_span", F.shiftright("o", 64 - bits)).drop("bt", "fit")  # the leading bits keep the order
    spans = each.groupBy("m_key", "mix_pass", "m_span").agg(F.sum("b").alias("sb"))
    spans = spans.withColumn("ahead", F.sum("sb").over(Window.partitionBy("m_key", "mix_pass").orderBy("m_span")) - F.col("sb")).drop("sb")
    inside = Window.partitionBy("m_key", "mix_pass", "m_span").orderBy("o", "m_block")
    each = each.join(spans, ["m_key", "mix_pass", "m_span"]).withColumn("before", F.col("ahead") + F.sum("b").over(inside) - F.col("b"))
    return checkpointed(each.where("mix_pass < passes or before < rest").drop("b", "o", "m_span", "ahead"))


def mix(docs: DataFrame, source: str = "source", doc_id: str = "doc_id", text: str = "text", budget: int | None = None,
        max_repeats: float = MAX_REPEATS, entropy: float = ENTROPY, seed: int = 7, columns: tuple[str, ...] | None = None) -> DataFrame:
    """A row for each copy of a document in the mixture.

    Columns: those of ``docs`` (or ``columns``), then mix_tokens, mix_weight, mix_pass and mix_place.
    """
    sizes = checkpointed(docs.select(_keyed(source).alias("m_key"), tokens(text).alias("t"), _spot(doc_id, text).alias("spot")))
    plan, rows = quotas(sizes, budget, max_repeats, entropy)
    plan = broadcast_if_small(plan)
    blocks = max(1, math.ceil(rows / BLOCK))
    slim = sizes.select("m_key", "t", F.pmod("spot", F.lit(blocks)).alias("m_block")).join(plan, "m_key")
    fixed = [F.first(c).alias(c) for c in plan.columns[1:]]
    held = slim.groupBy("m_key", "m_block").agg(F.sum("t").alias("bt"), F.sum(F.expr("if(t <= rest, t, 0)")).alias("fit"), *fixed)
    each = _passes(held, blocks, seed)

    key, tok, spot, block, own = fresh(docs, "key", "tokens", "spot", "block", "id")
    kept = docs.columns if columns is None else list(columns)
    slots = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)]
    full = docs.select(*slots, _keyed(source).alias(key), tokens(text).alias(tok), _spot(doc_id, text).alias(spot), F.col(doc_id).alias(own)).withColumn(block, F.pmod(spot, F.lit(blocks)))
    joined = full.join(each, (F.col(key) == F.col("m_key")) & (F.col(block) == F.col("m_block"))).where(f"mix_pass < passes or `{tok}` <= rest")
    # The join and the window over its result share their key columns, so rows are shuffled once.
    inner = Window.partitionBy(key, block, "mix_pass").orderBy(F.xxhash64(F.col(spot), F.col("mix_pass"), F.lit(seed)), F.col(spot), F.col(own)).rowsBetween(Window.unboundedPreceding, 0)
    joined = joined.withColumn("ends", F.col("before") + F.sum(tok).over(inner)).where("mix_pass < passes or ends <= rest")
    place = (F.col("mix_pass") * F.col("st") + F.col("ends") - F.col(tok)) / F.col("quota")
    out = joined.select(*[F.col(f"c{i}").alias(f"k{i}") for i in range(len(kept))], F.col(tok).alias("mix_tokens"), "mix_weight", "mix_pass", place.alias("mix_place"))
    return out.toDF(*kept, "mix_tokens", "mix_weight", "mix_pass", "mix_place")


def realised(docs: DataFrame) -> DataFrame:
    """doc_id, source, tokens, weight, pass and place of every copy."""
    out = mix(docs, columns=("doc_id", "source"))
    return out.toDF("doc_id", "source", "n_tokens", "weight", "pass", "place")
