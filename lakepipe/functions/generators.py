"""Columns for made-up rows: weighted choices, null injection, ids, row copies."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_choice(position: Column, weights: Mapping[str | None, float]) -> Column:
    """Pick by cumulative weight; ``position`` lies in [0, 1). A ``None`` entry yields null.

    Weights are scaled to their sum, so they need not add up to one.
    """
    total = sum(weights.values())
    upper = 0.0
    entries = list(weights.items())
    choice = None
    for value, weight in entries[:-1]:
        upper += weight / total
        within = position < F.lit(upper)
        choice = F.when(within, F.lit(value)) if choice is None else choice.when(within, F.lit(value))
    return F.lit(entries[-1][0]) if choice is None else choice.otherwise(F.lit(entries[-1][0]))


def uniform(seed: int) -> Column:
    return F.rand(seed)


def key_position(key: str | Column, buckets: int = 100) -> Column:
    """A repeatable number in [0, 1) from a whole-number key."""
    column = F.col(key) if isinstance(key, str) else key
    return F.pmod(column, F.lit(buckets)) / F.lit(float(buckets))


def inject_nulls(value: Column, position: Column, rate: float) -> Column:
    return F.when(position >= F.lit(rate), value)


def with_ids(df: DataFrame) -> DataFrame:
    return df.withColumns({"uuid": F.uuid(), "row_number": F.monotonically_increasing_id()})


def replicate(df: DataFrame, copies: str | Column, out: str = "copy") -> DataFrame:
    """One row per copy, numbered from 1; rows with zero or null copies vanish."""
    count = F.col(copies) if isinstance(copies, str) else copies
    return df.filter(count >= 1).withColumn(out, F.explode(F.sequence(F.lit(1), count.cast("int"))))
