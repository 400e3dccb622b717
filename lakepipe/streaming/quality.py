"""Rules on a stream: clean rows, dropped rows and rule counts of every micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakepipe.operators.expectations import RuleSet
from lakepipe.streaming.sinks import each_batch, read_batches, write_batch


def start_checked(
    stream: DataFrame, rules: RuleSet, target: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Write the rows that pass below ``target/clean`` and the counts below ``target/metrics``.

    The counts are observed while the rows are written, so the batch is read
    once. A violated fail rule ends the batch before its offsets are committed.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        counts = Observation(f"{rules.dataset}_{batch_id}")
        write_batch(rules.apply(rules.observe(batch, counts)), f"{target}/clean", batch_id)
        metrics = rules.observed_metrics(batch, counts.get)
        write_batch(metrics.coalesce(1), f"{target}/metrics", batch_id)

    return each_batch(stream, handle, checkpoint, every=every, target=target)


def read_clean(spark: SparkSession, target: str) -> DataFrame:
    return read_batches(spark, f"{target}/clean").drop("batch_id")


def read_metrics(spark: SparkSession, target: str) -> DataFrame:
    """Rule counts summed over all batches."""
    return (
        read_batches(spark, f"{target}/metrics")
        .groupBy("dataset", "name", "action")
        .agg(
            *[
                F.sum(c).alias(c)
                for c in ("passed_records", "failed_records", "dropped_records", "output_records")
            ]
        )
    )
