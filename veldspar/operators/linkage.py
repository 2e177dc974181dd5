"""Trained record linkage: chances of agreement estimated from unlabelled pairs by expectation maximisation.

A pair is described by the level of agreement of each field (an integer, null: not compared). Given
whether a pair matches, fields are taken to be independent; a level's chance among matches (m) and among
others (u) and the share of matches are the unknowns.

Scale. Training needs only how many pairs have each combination of levels: one aggregate over the pairs,
combined map-side, whose result is bounded by the product of the fields' levels, whatever the number of
pairs (more than ``PATTERNS`` combinations are an error). Scoring is a projection of CASE expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATTERNS = 100_000
ROUNDS = 60
#: Least chance of a level.
LEAST = 1e-6


@dataclass(frozen=True)
class Weights:
    share: float
    m: dict[str, dict[int, float]]
    u: dict[str, dict[int, float]]


def level_sql(similarity: str, cuts: tuple[float, ...] = (0.7, 0.9, 1.0)) -> str:
    """How many of the cuts a similarity reaches; null stays null."""
    return f"case when {similarity} is null then null else " + " + ".join(f"int({similarity} >= {c}D)" for c in cuts) + " end"


def train(pairs: DataFrame, fields: list[str], share: float = 0.1, rounds: int = ROUNDS) -> Weights:
    """Weights of the pairs' fields. At the start a field's highest level is taken to be likely among matches.

    No pair at all, or a field that is never compared, leaves the starting values.
    """
    rows = pairs.groupBy(*fields).agg(F.count("*").alias("n")).limit(PATTERNS + 1).collect()
    if len(rows) > PATTERNS:
        raise ValueError(f"more than {PATTERNS} combinations of levels")
    counted = sorted(((tuple(r[f] for f in fields), r["n"]) for r in rows), key=str)
    levels = {f: sorted({p[i] for p, _ in counted if p[i] is not None}) for i, f in enumerate(fields)}
    m, u = {}, {}
    for f, found in levels.items():
        rank = {v: i + 1 for i, v in enumerate(found)}
        total = sum(rank.values()) or 1
        m[f] = {v: r / total for v, r in rank.items()}
        u[f] = {v: (len(found) + 1 - r) / total for v, r in rank.items()}
    every = sum(n for _, n in counted)
    for _ in range(rounds if every else 0):
        sure = [_posterior(p, fields, Weights(share, m, u)) for p, _ in counted]
        share = min(max(sum(n * s for (_, n), s in zip(counted, sure)) / every, LEAST), 1 - LEAST)
        m, u = _chances(counted, sure, fields, levels), _chances(counted, [1 - s for s in sure], fields, levels)
    return Weights(share, m, u)


def _chances(counted: list, weight: list[float], fields: list[str], levels: dict) -> dict[str, dict[int, float]]:
    out = {}
    for i, f in enumerate(fields):
        sums = {v: 0.0 for v in levels[f]}
        for (p, n), w in zip(counted, weight):
            if p[i] is not None:
                sums[p[i]] += n * w
        total = sum(sums.values()) or 1.0
        out[f] = {v: max(s / total, LEAST) for v, s in sums.items()}
    return out


def _posterior(pattern: tuple, fields: list[str], w: Weights) -> float:
    odds = math.log(w.share / (1 - w.share)) + sum(math.log(w.m[f][v] / w.u[f][v]) for f, v in zip(fields, pattern) if v is not None)
    return 1 / (1 + math.exp(-odds)) if odds > -700 else 0.0


def probability(weights: Weights) -> Column:
    """Chance of a match from the level columns; a level that training has not seen says nothing."""
    odds = F.lit(math.log(weights.share / (1 - weights.share)))
    for f, found in weights.m.items():
        value = F.lit(0.0)
        for level, chance in found.items():
            value = F.when(F.col(f) == level, F.lit(math.log(chance / weights.u[f][level]))).otherwise(value)
        odds = odds + value
    return 1 / (1 + F.exp(-odds))


def trained_links(pairs: DataFrame, fields: list[str], a: str = "a", b: str = "b", threshold: float = 0.5) -> DataFrame:
    """Links (a, b) and their probability, of pairs whose chance of a match reaches the threshold, for ``resolve.clusters``."""
    weights = train(pairs, fields)
    return pairs.select(F.col(a).alias("a"), F.col(b).alias("b"), probability(weights).alias("probability")).where(F.col("probability") >= threshold)
