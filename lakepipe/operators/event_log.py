"""Read and write the JSON log of a pipeline run: flow definitions and rule results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXPECTATION_SCHEMA = (
    "array<struct<name:string, dataset:string, passed_records:bigint, failed_records:bigint>>"
)


def progress_events(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """One ``flow_progress`` log row per group, with the group's rule results as JSON.

    The list in each row has one entry per rule, so it does not grow with the data.
    """
    entry = F.struct("name", "dataset", "passed_records", "failed_records")
    grouped = metrics.groupBy(*by, "dataset").agg(
        F.sort_array(F.collect_list(entry)).alias("expectations"),
        F.max("dropped_records").alias("dropped_records"),
        F.max("output_records").alias("num_output_rows"),
    )
    quality = F.struct("dropped_records", "expectations")
    details = F.struct(
        F.struct(
            F.lit("COMPLETED").alias("status"),
            F.struct("num_output_rows").alias("metrics"),
            quality.alias("data_quality"),
        ).alias("flow_progress")
    )
    return grouped.select(
        *by,
        F.lit("flow_progress").alias("event_type"),
        F.lit("INFO").alias("level"),
        F.to_json(details).alias("details"),
    )


def rule_results(log: DataFrame, *keep: str) -> DataFrame:
    """Explode the rule results of every progress event that reports metrics."""
    results = F.from_json(
        F.get_json_object("details", "$.flow_progress.data_quality.expectations"),
        EXPECTATION_SCHEMA,
    )
    dropped = F.get_json_object("details", "$.flow_progress.data_quality.dropped_records")
    written = F.get_json_object("details", "$.flow_progress.metrics.num_output_rows")
    return (
        log.filter(F.get_json_object("details", "$.flow_progress.metrics").isNotNull())
        .select(
            *keep,
            F.get_json_object("details", "$.flow_progress.status").alias("status_update"),
            written.cast("bigint").alias("output_records"),
            dropped.cast("bigint").alias("dropped_records"),
            F.explode(results).alias("e"),
        )
        .select(*keep, "status_update", "output_records", "dropped_records", "e.*")
    )


def lineage(log: DataFrame, *keep: str) -> DataFrame:
    """Output, inputs and type of every declared flow."""
    part = {
        "output_dataset": "output_dataset",
        "input_datasets": "input_datasets",
        "flow_type": "flow_type",
        "flow_schema": "schema",
    }
    path = "$.flow_definition"
    return log.filter(F.get_json_object("details", path).isNotNull()).select(
        *keep,
        *[F.get_json_object("details", f"{path}.{key}").alias(out) for out, key in part.items()],
    )
