"""Numeric features of a timestamp column."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _circle(name: str, position: Column) -> dict[str, Column]:
    angle = position * F.lit(2 * math.pi)
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def timestamp_features(
    df: DataFrame, column: str, holidays: DataFrame | None = None, hours: bool = True
) -> DataFrame:
    """Epoch seconds, weekend and holiday flags, hour indicators, and cyclic positions.

    ``holidays`` is a calendar with one column ``holiday`` (dates); without it
    the flag is left out. Cyclic features place the time on the unit circle of
    its day, week, month and year.
    """
    ts = F.col(column)
    hour = F.hour(ts)
    week_hour = F.weekday(ts) * 24 + hour
    month_hour = (F.dayofmonth(ts) - 1) * 24 + hour
    year_hour = (F.dayofyear(ts) - 1) * 24 + hour
    month_length = F.dayofmonth(F.last_day(ts)) * 24
    year_length = F.dayofyear(F.make_date(F.year(ts), F.lit(12), F.lit(31))) * 24
    features = {
        f"{column}_unix": F.unix_timestamp(ts),
        f"{column}_weekend": (F.weekday(ts) >= 5).cast("int"),
    }
    if hours:
        features |= {f"{column}_hour_{h}": (hour == h).cast("int") for h in range(24)}
    features |= _circle(f"{column}_day", hour / 24)
    features |= _circle(f"{column}_week", week_hour / 168)
    features |= _circle(f"{column}_month", month_hour / month_length)
    features |= _circle(f"{column}_year", year_hour / year_length)
    result = df.withColumns(features)
    if holidays is None:
        return result
    days = holidays.select(F.col("holiday").cast("date").alias("__holiday")).distinct()
    return (
        result.join(days, F.to_date(ts) == F.col("__holiday"), "left")
        .withColumn(f"{column}_holiday", F.col("__holiday").isNotNull().cast("int"))
        .drop("__holiday")
    )
