"""Latest row per key, ordering, and row numbers over a whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakepipe.session import cut_lineage


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Keep the row with the greatest ``order`` of each key.

    An aggregate rather than a window: every map task already reduces a hot key
    to one row before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(list(keys))
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
        .select(*keys, "__row.*")
        .select(*df.columns)
    )


def top_rows(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of a stated order (planned as a per-task top-n plus merge)."""
    return df.orderBy(*order).limit(n)


def shuffled(df: DataFrame, seed: int = 0) -> DataFrame:
    return df.orderBy(F.rand(seed))


def with_row_index(df: DataFrame, order: Sequence[str | Column], out: str = "row_index") -> DataFrame:
    """Gap-free positions 0..n-1 of a total order, without a one-task window.

    A hash of the row ranks below ``order``, so that rows which are equal in it
    are spread over partitions too. The range-sorted frame is checkpointed so
    that its partitions stay fixed; only one row per partition is needed to turn local positions into global ones.
    """
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut_lineage(
        df.orderBy(*order, F.xxhash64(*df.columns)).withColumns({"__part": F.spark_partition_id(), "__local": local})
    )
    # both frames below have one row per partition, so the window and the broadcast stay small
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("__part")
        .count()
        .select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    )
    return (
        placed.join(F.broadcast(offsets), "__part")
        .withColumn(out, F.col("__before") + F.col("__local"))
        .drop("__part", "__local", "__before")
    )
