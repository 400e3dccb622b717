"""Lookup, interval and positional joins.

No join here forces a broadcast: Spark broadcasts a side only after checking its
size, and otherwise shuffles and lets adaptive execution split skewed partitions.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepipe.operators.windows import with_row_index


def enrich(
    facts: DataFrame,
    lookup: DataFrame,
    on: Mapping[str, str],
    add: Mapping[str, str],
    how: str = "inner",
) -> DataFrame:
    """Add ``{new column: lookup column}``, joining on ``{fact key: lookup key}``.

    All fact columns are kept as they are; ``facts`` may be a stream. Lookup keys
    carry internal names, so equally named columns on both sides never clash.
    """
    keys = {key: f"__on_{i}" for i, key in enumerate(on.values())}
    side = lookup.select(
        *[F.col(key).alias(name) for key, name in keys.items()],
        *[F.col(source).alias(f"__add_{out}") for out, source in add.items()],
    )
    condition = [F.col(fact) == F.col(keys[key]) for fact, key in on.items()]
    return facts.join(side, condition, how).select(
        *[F.col(c) for c in facts.columns],
        *[F.col(f"__add_{out}").alias(out) for out in add],
    )


#: Bins of an interval that are made at a time.
BINS_PER_BLOCK = 4096


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    at: str,
    start: str,
    end: str,
    method: str = "binned",
) -> DataFrame:
    """Inner join on equal keys and ``start < at < end`` (both borders excluded).

    ``at``, ``start`` and ``end`` are whole numbers (epoch seconds, for example).
    The line is cut into bins as wide as the mean interval: a point lies in one
    bin, an interval in each that it touches, in all at most three times as many
    as there are intervals, whatever their lengths. A key with very many points
    and intervals is so spread over many tasks, and pairs that cannot meet are
    never formed. ``direct`` joins on the keys and filters: the same rows, for
    keys that are known to have few intervals.
    """
    right = intervals.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in intervals.columns if c not in keys])
    same_key = [F.col(k) == F.col(f"__{k}") for k in keys]
    inside = (F.col(start) < F.col(at)) & (F.col(at) < F.col(end))
    output = [*points.columns, *[c for c in intervals.columns if c not in keys]]
    if method == "direct":
        return points.join(right, [*same_key, inside]).select(*output)
    if method != "binned":
        raise ValueError(f"unknown method {method!r}")

    real = right.filter(F.col(start) < F.col(end))
    mean = intervals.filter(F.col(start) < F.col(end)).agg(F.avg(F.col(end) - F.col(start))).first()[0]
    width = max(1, math.ceil(mean or 1))

    def bin_of(value: str) -> Column:
        # dividing whole numbers keeps the order, for negative numbers too
        return F.expr(f"CAST(`{value}` AS BIGINT) DIV {width}")

    # two steps, so that no row holds more than a block of bins, or a list of blocks, of a very long interval
    blocks = F.sequence(bin_of(start), bin_of(end), F.lit(BINS_PER_BLOCK).cast("bigint"))
    blocked = real.withColumn("__block", F.explode(blocks))
    last = F.least(F.col("__block") + (BINS_PER_BLOCK - 1), bin_of(end))
    binned = blocked.withColumn("__right_bin", F.explode(F.sequence(F.col("__block"), last))).drop("__block")
    looked = points.withColumn("__bin", bin_of(at))
    return looked.join(binned, [*same_key, F.col("__bin") == F.col("__right_bin"), inside]).select(*output)


def zip_join(
    left: DataFrame,
    right: DataFrame,
    left_order: Sequence[str | Column],
    right_order: Sequence[str | Column],
) -> DataFrame:
    """Pair the n-th row of one frame with the n-th row of the other, by stated orders."""
    a = with_row_index(left, left_order, "__position")
    b = with_row_index(right, right_order, "__position")
    return a.join(b, "__position").drop("__position")
