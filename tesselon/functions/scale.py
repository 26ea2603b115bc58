"""Scalers. At index time a set without spread scales to 0.5; among the candidates of a query it scales to 1."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

EPSILON = 1e-12


def clamp01(x: Column) -> Column:
    """x within 0 .. 1; null stays null (greatest and least would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def min_max(x: Column, low: Column, high: Column, degenerate: float = 0.5) -> Column:
    """Scale x by given bounds (one-row aggregates or window results)."""
    span = high - low
    return F.when(span.isNull() | (span < EPSILON), F.lit(degenerate)).otherwise(clamp01((x - low) / span))


def log1p_positive(x: Column) -> Column:
    return F.when(x.isNotNull(), F.log1p(F.greatest(x, F.lit(0.0))))


def half_life_decay(age: Column, half_life: float) -> Column:
    """1 up to age 0, then halved every half_life; a half-life that is not positive decays at once."""
    if half_life <= 0:
        return F.when(age <= 0, 1.0).otherwise(0.0)
    return F.when(age <= 0, 1.0).otherwise(F.pow(F.lit(2.0), -age / F.lit(float(half_life))))


def scaled_within(x: Column, *keys: str, degenerate: float = 1.0) -> Column:
    """Min-max over the rows of each key that have x; rows without it are 0."""
    w = Window.partitionBy(*keys)
    return F.when(x.isNull(), 0.0).otherwise(min_max(x, F.min(x).over(w), F.max(x).over(w), degenerate))
