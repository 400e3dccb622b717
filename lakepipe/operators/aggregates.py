"""Group aggregates, time-bucketed statistics and numeric summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepipe.operators.ranges import running_totals
from lakepipe.session import cut_lineage

# The percentile grid of the sensor statistics.
PERCENTILES = [0.1, 0.3, 0.6, 0.8, 0.95]

QUARTILES = [0.25, 0.5, 0.75]

DEFAULT_ACCURACY = 10_000


def total_by(df: DataFrame, key: str, measure: str, out: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(measure).alias(out))


def named_aggregates(df: DataFrame, keys: Sequence[str], wanted: Mapping[str, str]) -> DataFrame:
    """Aggregates given as ``{column: function}``, named ``function_column`` (``*`` gives ``count``)."""
    known = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min, "avg": F.avg}
    aggregates = []
    for column, function in wanted.items():
        if column == "*":
            aggregates.append(F.count(F.lit(1)).alias("count"))
        else:
            aggregates.append(known[function](column).alias(f"{function}_{column}"))
    return df.groupBy(*keys).agg(*aggregates)


def first_by(value: str | Column, *order: str | Column) -> Column:
    """The value of the earliest row: a repeatable ``first``."""
    return F.min_by(value, order[0] if len(order) == 1 else F.struct(*order))


def sensor_columns(df: DataFrame, pattern: str = "sensor") -> list[str]:
    return [c for c in df.columns if pattern in c]


def statistics(sensors: Sequence[str], accuracy: int = DEFAULT_ACCURACY) -> list[Column]:
    """Spread and percentile vector of each sensor column."""
    columns = []
    for sensor in sensors:
        columns.append(F.stddev_pop(sensor).alias(f"std_{sensor}"))
        columns.append(
            F.percentile_approx(sensor, PERCENTILES, accuracy).alias(f"percentiles_{sensor}")
        )
    return columns


def bucket_statistics(
    df: DataFrame,
    key: str,
    time: Column,
    measure: str,
    sensors: Sequence[str] | None = None,
    unit: str = "hour",
    bucket: str = "hourly_timestamp",
    accuracy: int = DEFAULT_ACCURACY,
) -> DataFrame:
    """Statistics per key and time bucket; every aggregate is combined before the shuffle."""
    sensors = sensor_columns(df) if sensors is None else sensors
    return (
        df.withColumn(bucket, F.date_trunc(unit, time))
        .groupBy(key, bucket)
        .agg(F.avg(measure).alias(f"avg_{measure}"), *statistics(sensors, accuracy))
    )


def exact_quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Exact discrete quantiles: one row per column with an array of values.

    Equal values are counted first, on the map side already; the running counts
    over the distinct values are then built range by range.
    """
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value"))
            for c in columns
        ]
    )
    counted = cut_lineage(
        df.select(F.explode(pairs).alias("p"))
        .select("p.*")
        .filter(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .count()
    )
    upto = running_totals(counted, "value", {"upto": "count"}, within=["column_name"])
    size = counted.groupBy("column_name").agg(F.sum("count").alias("size"))
    reached = [F.min(F.when(F.col("upto") >= F.col("size") * p, F.col("value"))) for p in probabilities]
    return upto.join(size, "column_name").groupBy("column_name").agg(
        F.array(*reached).alias("quantiles")
    )


def describe_numeric(df: DataFrame, columns: Sequence[str], exact: bool = False) -> DataFrame:
    """One row per column: count, mean, stddev, min, quartiles, max.

    Quartiles are approximate and part of the same single pass, or exact.
    """
    aggregates = []
    for c in columns:
        fields = [
            F.lit(c).alias("column_name"),
            F.count(c).alias("count"),
            F.avg(c).alias("mean"),
            F.stddev(c).alias("stddev"),
            F.min(c).cast("double").alias("min"),
            F.max(c).cast("double").alias("max"),
        ]
        if not exact:
            approximate = F.percentile_approx(F.col(c).cast("double"), QUARTILES, DEFAULT_ACCURACY)
            fields.append(approximate.alias("quantiles"))
        aggregates.append(F.struct(*fields))
    summary = df.agg(F.array(*aggregates).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
    if exact:
        summary = summary.join(exact_quantiles(df, columns, QUARTILES), "column_name", "left")
    names = ["q25", "q50", "q75"]
    return summary.withColumns({n: F.col("quantiles")[i] for i, n in enumerate(names)}).drop("quantiles")
