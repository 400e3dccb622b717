"""Time-bucketed statistics as a stream with a watermark and upserted results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakepipe.operators.aggregates import statistics
from lakepipe.streaming.sinks import BATCH, each_batch, read_batches, write_batch

# Fixed value: how long late readings are waited for.
LATENESS = "3 hours"


def windowed_statistics(
    stream: DataFrame,
    key: str,
    time: Column,
    measure: str,
    sensors: Sequence[str],
    width: str = "1 hour",
    lateness: str = LATENESS,
) -> DataFrame:
    """Statistics per key and window; readings later than ``lateness`` are ignored by a stream."""
    return (
        stream.withColumn("__time", time)
        .withWatermark("__time", lateness)
        .groupBy(key, F.window("__time", width).alias("__window"))
        .agg(
            F.count(F.lit(1)).alias("readings"),
            F.avg(measure).alias(f"avg_{measure}"),
            *statistics(sensors),
        )
        .withColumn("hourly_timestamp", F.col("__window.start"))
        .drop("__window")
    )


def start_windowed(
    statistics_stream: DataFrame, target: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Log the windows that changed in each batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, target, batch_id)

    return each_batch(statistics_stream, handle, checkpoint, mode="update", every=every, target=target)


def read_windowed(spark: SparkSession, target: str, key: str) -> DataFrame:
    """Newest result of every window."""
    log = read_batches(spark, target)
    rest = [c for c in log.columns if c not in (key, "hourly_timestamp", BATCH)]
    return (
        log.groupBy(key, "hourly_timestamp")
        .agg(F.max_by(F.struct(*rest), F.col(BATCH)).alias("__row"))
        .select(key, "hourly_timestamp", "__row.*")
    )
