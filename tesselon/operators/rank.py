"""Fusion of candidate signals: weighted sum or reciprocal ranks, and the best per query.

Candidates are (query_id, id) with one nullable column per signal.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scale as S

# Default weights of the signals and the constant of reciprocal rank fusion.
WEIGHTS = {
    "semantic": 0.28, "lexical": 0.18, "graph": 0.20, "centrality": 0.07, "importance": 0.07,
    "usage": 0.06, "activity": 0.04, "recency": 0.04, "dependency": 0.06,
}
RRF_K = 60
QUERY_SIGNALS = ("lexical", "semantic", "graph")


def _sum(parts: list[Column]) -> Column:
    return reduce(add, parts) if parts else F.lit(0.0)


def shares(candidates: DataFrame, signals: list[str], weights: dict[str, float]) -> dict[str, Column]:
    """Weight of each signal among those that the query has; equal weights if none of them has a weight."""
    w = Window.partitionBy("query_id")
    there = {s: F.count(s).over(w) > 0 for s in signals}
    own = {s: F.when(there[s], float(max(weights.get(s, 0.0), 0.0))).otherwise(0.0) for s in signals}
    total = _sum(list(own.values()))
    equal = _sum([F.when(there[s], 1.0).otherwise(0.0) for s in signals])
    return {s: F.when(total > 0, own[s] / total).otherwise(F.when(there[s], 1.0).otherwise(0.0) / F.greatest(equal, F.lit(1.0))) for s in signals}


def weighted(candidates: DataFrame, signals: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Adds score; signals of the query are scaled among the candidates that have them, corpus signals clamped."""
    share = shares(candidates, signals, WEIGHTS if weights is None else weights)
    value = {s: S.scaled_within(F.col(s), "query_id") if s in QUERY_SIGNALS else F.coalesce(S.clamp01(F.col(s)), F.lit(0.0)) for s in signals}
    return candidates.withColumn("score", _sum([share[s] * value[s] for s in signals]))


def reciprocal(candidates: DataFrame, signals: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """Adds score: each signal gives share * (k + 1) / (k + rank); candidates without it rank last."""
    share = shares(candidates, signals, WEIGHTS if weights is None else weights)

    def rank(s: str) -> Column:
        return F.row_number().over(Window.partitionBy("query_id").orderBy(F.round(s, 9).desc_nulls_last(), "id"))

    return candidates.withColumn("score", _sum([share[s] * F.lit(float(RRF_K + 1)) / (F.lit(float(RRF_K)) + rank(s)) for s in signals]))


def best(scored: DataFrame, limit: int) -> DataFrame:
    """The first `limit` of each query by score, then id, with rank."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max(0, limit))
