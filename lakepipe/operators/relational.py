"""Small relational steps: column selection, null handling, unions, samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns; names that do not exist are ignored."""
    return df.drop(*names)


def castable(df: DataFrame, column: str, type_name: str) -> DataFrame:
    """Rows whose value can be read as the type."""
    return df.filter(F.col(column).try_cast(type_name).isNotNull())


def union_many(frames: Sequence[DataFrame], by_name: bool = True) -> DataFrame:
    def add(a: DataFrame, b: DataFrame) -> DataFrame:
        return a.unionByName(b) if by_name else a.union(b)

    return reduce(add, frames)


def merge_shapes(old: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both frames; a column missing on one side is null there."""
    return old.unionByName(new, allowMissingColumns=True)


def key_percent(key: str) -> Column:
    """A repeatable number 0..99 per key, the same on every engine that has md5."""
    digest = F.md5(F.col(key).cast("string"))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(100))


def hash_sample(df: DataFrame, key: str, percent: int) -> DataFrame:
    """Repeatable sample: the same keys are chosen whenever and wherever it runs."""
    return df.filter(key_percent(key) < percent)
