"""Nested device packages and JSON text columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepipe.functions.nested import (
    expand,
    explode_rows,
    flatten,
    join_arrays,
    json_path,
    parse_json_columns,
    parse_like,
    parse_two_levels,
)
from lakepipe.functions.scalars import unescape_json
from lakepipe.operators.expectations import RuleSet, expect_all
from lakepipe.plans.registry import query, table
from lakepipe.plans.views import device_list, package, with_views

TRACE_RULES = RuleSet(
    "package_trace",
    expect_all({"valid_id": "DeviceIdentifier IS NOT NULL AND InstanceIdentifier IS NOT NULL"}),
)
STEPS = ("package_flat", "package_steps")
_TRACE = """DeviceIdentifier, InstanceIdentifier, PackageIdentifier, DistributionFinished, Identifier, OccurredAt,
            Mailbox, RecipientMail, SenderMail, "Type\""""


def trace_rows(packages: DataFrame) -> DataFrame:
    """One row per step, all nested parts expanded (works on a stream too)."""
    trace = expand(packages.drop("SerializedJsonObject"), "PackageTrace")
    steps = expand(explode_rows(trace, "PackageTraceSteps", "Step"), "Step")
    return TRACE_RULES.apply(expand(expand(steps, "DistributionDetails"), "Source"))


@query("package_trace", with_views(f"SELECT {_TRACE} FROM package_steps", *STEPS))
def package_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace_rows(package(spark, sf_dir))


@query(
    "flatten_struct",
    with_views(
        """SELECT DeviceIdentifier, InstanceIdentifier, PackageIdentifier AS PackageTrace_PackageIdentifier,
                  DistributionFinished AS PackageTrace_DistributionDetails_DistributionFinished,
                  Mailbox AS PackageTrace_DistributionDetails_Source_Mailbox,
                  RecipientMail AS PackageTrace_DistributionDetails_Source_RecipientMail,
                  SenderMail AS PackageTrace_DistributionDetails_Source_SenderMail,
                  "Type" AS PackageTrace_DistributionDetails_Source_Type,
                  Identifier AS PackageTraceSteps_Identifier, OccurredAt AS PackageTraceSteps_OccurredAt
           FROM package_steps""",
        *STEPS,
    ),
)
def flatten_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flatten, explode the step array, flatten again."""
    flat = flatten(package(spark, sf_dir).drop("SerializedJsonObject"))
    exploded = explode_rows(flat, "PackageTrace_PackageTraceSteps", "PackageTraceSteps")
    return flatten(exploded)


_DISTRIBUTION = 'PackageIdentifier, DistributionFinished, OccurredAt, Mailbox, RecipientMail, SenderMail, "Type"'


@query(
    "distribution_view",
    with_views(f"SELECT {_DISTRIBUTION} FROM package_steps WHERE DistributionFinished IS NOT NULL", *STEPS),
)
def distribution_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = [c.strip().strip('"') for c in _DISTRIBUTION.split(",")]
    return trace_rows(package(spark, sf_dir)).select(*wanted).filter(F.col("DistributionFinished").isNotNull())


@query("transport_view", with_views(f"SELECT {_TRACE} FROM package_steps WHERE Identifier = 'Transport'", *STEPS))
def transport_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace_rows(package(spark, sf_dir)).filter(F.col("Identifier") == "Transport")


@query(
    "device_transport",
    with_views(
        f"""SELECT {_TRACE}, DeviceName FROM package_steps LEFT JOIN device_list
            USING (DeviceIdentifier, InstanceIdentifier) WHERE Identifier = 'Transport'""",
        *STEPS,
        "device_list",
    ),
)
def device_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace row stays when its device is not listed."""
    keys = ["DeviceIdentifier", "InstanceIdentifier"]
    return transport_view(spark, sf_dir).join(device_list(spark, sf_dir), keys, "left")


@query(
    "payload_split",
    with_views(
        """SELECT DeviceIdentifier, InstanceIdentifier, 'reading' AS SerializedType,
                  l_partkey AS Part, CAST(l_quantity AS DOUBLE) AS Quantity FROM package_flat""",
        "package_flat",
    ),
)
def payload_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload table of the feed: JSON text inside JSON text, both types inferred."""
    payload = package(spark, sf_dir).drop("PackageTrace")
    return parse_two_levels(payload, "SerializedJsonObject", "SerializedJsonData")


@query(
    "json_two_level",
    "SELECT event_id, event_type AS kind, user_id, value FROM events",
)
def json_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = F.to_json(F.struct("user_id", "value"))
    document = F.to_json(F.struct(F.col("event_type").alias("kind"), inner.alias("inner")))
    events = table(spark, sf_dir, "events").select("event_id", document.alias("document"))
    return parse_two_levels(events, "document", "inner")


@query(
    "json_autoparse",
    """SELECT event_id, CASE WHEN event_id % 97 <> 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k,
              event_id AS first_item, user_id AS second_item, event_type AS word FROM events""",
)
def json_autoparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects (some of them broken text), arrays and bare strings, types inferred in one pass."""
    texts = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 97 == 0, "{broken").otherwise(F.col("props")).alias("object"),
        F.to_json(F.array("event_id", "user_id")).alias("list"),
        F.concat(F.lit('"'), "event_type", F.lit('"')).alias("word"),
    )
    parsed = parse_json_columns(texts, "object", "list", "word")
    return parsed.select(
        "event_id",
        F.col("object.k").alias("k"),
        F.col("list")[0].alias("first_item"),
        F.col("list")[1].alias("second_item"),
        "word",
    )


@query("json_path", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", json_path("props", "k").cast("bigint").alias("k"))


@query(
    "json_path_variant",
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
)
def json_path_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the variant type: parsed once, then addressed by path."""
    events = table(spark, sf_dir, "events")
    return events.select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("json_schema_of", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_schema_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "events").select("event_id", parse_like("props", '{"k": 1}').alias("p"))
    return expand(parsed, "p")


@query(
    "clean_escaped_json",
    """SELECT event_id, '{"payload":' || props || '}' AS cleaned,
              CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""",
)
def clean_escaped_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.to_json(F.struct(F.col("props").alias("payload")))
    cleaned = table(spark, sf_dir, "events").select("event_id", unescape_json(quoted).alias("cleaned"))
    return cleaned.withColumn("k", json_path("cleaned", "payload.k").cast("bigint"))


@query(
    "array_items",
    """SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS first_item, CAST(embedding[2] AS DOUBLE) AS second_item,
              CAST(embedding[len(embedding)] AS DOUBLE) AS last_item FROM embeddings""",
)
def array_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        vector[0].cast("double").alias("first_item"),
        vector.getItem(1).cast("double").alias("second_item"),
        F.element_at(vector, -1).cast("double").alias("last_item"),
    )


@query(
    "array_concat",
    """SELECT vec_id, CAST(2 * len(embedding) + 1 AS INTEGER) AS length, CAST(embedding[1] AS DOUBLE) AS head,
              CAST(label AS DOUBLE) AS middle, CAST(embedding[len(embedding)] AS DOUBLE) AS tail FROM embeddings""",
)
def array_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").withColumn("mark", F.array(F.col("label").cast("float")))
    joined = vectors.withColumn("vector", join_arrays(["embedding", "mark", "embedding"]))
    return joined.select(
        "vec_id",
        F.size("vector").alias("length"),
        F.col("vector")[0].cast("double").alias("head"),
        F.element_at("vector", F.size("embedding") + 1).cast("double").alias("middle"),
        F.element_at("vector", -1).cast("double").alias("tail"),
    )
