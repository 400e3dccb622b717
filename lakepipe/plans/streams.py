"""Streams over the given tables, worked off to the end and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakepipe.operators.joins import enrich
from lakepipe.operators.ranges import shuffle_width
from lakepipe.plans.change_data import (
    HIDDEN,
    IS_DELETE,
    KEYS,
    SCD1_SQL,
    SCD2_SQL,
    SEQUENCE,
    changes_of,
    plain_versions,
)
from lakepipe.plans.quality import CDC_RULES
from lakepipe.plans.registry import plain_time, query, rounded, table
from lakepipe.plans.views import cdc_feed_of, with_views
from lakepipe.session import scratch_path
from lakepipe.sinks.tables import compact, rewrite_without, write_files
from lakepipe.sources.files import read_files, stream_files
from lakepipe.streaming.changes import (
    fold_changes,
    read_scd1,
    read_scd2,
    read_versions,
    start_scd1,
    start_scd2,
    start_scd2_stored,
)
from lakepipe.streaming.ingest import ingest_folder
from lakepipe.streaming.quality import read_metrics, start_checked
from lakepipe.streaming.sinks import append_stream, drain
from lakepipe.streaming.statistics import read_windowed, start_windowed, windowed_statistics


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table folder (or single file) as an incremental source."""
    schema = table(spark, sf_dir, name).schema
    return stream_files(spark, f"{sf_dir}/{name}.parque[t]", "parquet", schema)


def landed_stream(spark: SparkSession, sf_dir: str, name: str, files: int = 5) -> DataFrame:
    """A table as a folder of files in no order, delivered one file per micro-batch."""
    whole = table(spark, sf_dir, name)
    folder = scratch_path(spark, f"landing-{name}")
    whole.repartition(files, F.xxhash64(*whole.columns)).write.parquet(folder)
    return stream_files(spark, folder, "parquet", whole.schema, max_files_per_trigger=1)


def _worked_off(spark: SparkSession, stream: DataFrame, label: str) -> DataFrame:
    root = scratch_path(spark, label)
    drain(append_stream(stream, f"{root}/table", f"{root}/checkpoint"))
    return spark.read.schema(stream.schema).parquet(f"{root}/table")


@query("src_stream_parquet", "SELECT event_type, count(*) AS events FROM events GROUP BY event_type")
def src_stream_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = _worked_off(spark, table_stream(spark, sf_dir, "events"), "stream-parquet")
    return read.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"))


def _landed(spark: SparkSession, df: DataFrame, fmt: str) -> str:
    """The rows of a table as files of a landing folder."""
    path = scratch_path(spark, f"landing-{fmt}")
    write_files(df, path, fmt)
    return path


EVENT_COLUMNS = "SELECT event_id, user_id, event_type, value FROM events"


@query("src_stream_json", EVENT_COLUMNS)
def src_stream_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON folder as a stream, column types inferred and remembered."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    folder, root = _landed(spark, events, "json"), scratch_path(spark, "stream-json")
    drain(ingest_folder(spark, folder, "json", f"{root}/raw", f"{root}/state"))
    return spark.read.parquet(f"{root}/raw").select(*events.columns)


@query("src_stream_csv", EVENT_COLUMNS)
def src_stream_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV folder as a stream, read as text and cast later."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    folder, root = _landed(spark, events, "csv"), scratch_path(spark, "stream-csv")
    drain(ingest_folder(spark, folder, "csv", f"{root}/raw", f"{root}/state", infer_types=False))
    return spark.read.parquet(f"{root}/raw").select(
        F.col("event_id").try_cast("long").alias("event_id"),
        F.col("user_id").try_cast("long").alias("user_id"),
        "event_type",
        F.col("value").try_cast("double").alias("value"),
    )


@query(
    "rescued_data",
    """SELECT event_id, CASE WHEN event_type <> 'error' THEN user_id END AS user_id,
              CASE WHEN event_type = 'error' THEN '{"user_id":"user ' || user_id || '"}'
                   WHEN event_type = 'view' THEN '{"extra":"' || event_id || '"}' END AS _rescued_data FROM events""",
)
def rescued_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value of the wrong type and an unknown field are kept as text; the rest of the row arrives."""
    event_type = F.col("event_type")
    lines = table(spark, sf_dir, "events").select(
        F.when(event_type == "error", F.to_json(F.struct("event_id", F.concat(F.lit("user "), "user_id").alias("user_id"))))
        .when(event_type == "view", F.to_json(F.struct("event_id", "user_id", F.col("event_id").alias("extra"))))
        .otherwise(F.to_json(F.struct("event_id", "user_id")))
        .alias("value")
    )
    path = scratch_path(spark, "rescued")
    lines.write.text(path)
    return read_files(spark, path, "json", "event_id long, user_id long", rescue="fields")


_PLAIN_EVENTS = "event_id long, user_id long, event_type string, value double"


@query(
    "src_csv_by_header",
    """SELECT event_id, CASE WHEN event_id % 3 <> 2 OR event_type <> 'error' THEN user_id END AS user_id, event_type, value,
              CASE WHEN event_id % 3 = 2 AND event_type = 'error'
                   THEN '{"extra":"' || event_id || '","user_id":"user ' || user_id || '"}'
                   WHEN event_id % 3 = 2 THEN '{"extra":"' || event_id || '"}' END AS _rescued_data FROM events""",
)
def src_csv_by_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the columns in different orders, an unknown column, and values of the wrong type."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    odd = F.when(F.col("event_type") == "error", F.concat(F.lit("user "), "user_id")).otherwise(
        F.col("user_id").cast("string")
    )
    folder, root = scratch_path(spark, "landing-headers"), scratch_path(spark, "csv-headers")
    orders = (
        ["event_id", "user_id", "event_type", "value"],
        ["value", "event_type", "user_id", "event_id"],
        ["event_type", F.col("event_id").alias("extra"), "event_id", "value", odd.alias("user_id")],
    )
    for i, columns in enumerate(orders):
        part = events.where(F.col("event_id") % 3 == i).select(*columns)
        part.repartition(4, F.xxhash64("event_id")).write.mode("append").option("header", True).csv(folder)
    drain(ingest_folder(spark, folder, "csv", f"{root}/raw", f"{root}/state", schema=StructType.fromDDL(_PLAIN_EVENTS)))
    return spark.read.parquet(f"{root}/raw").drop("batch_id")


@query(
    "src_parquet_late_column",
    """SELECT event_id, CASE WHEN event_id % 13 = 0 THEN event_type END AS event_type,
              CASE WHEN event_id % 13 = 1 THEN '{"note":"' || user_id || '"}' END AS _rescued_data FROM events""",
)
def src_parquet_late_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that one file in many has arrives; one that comes after the schema was fixed is rescued."""
    events = table(spark, sf_dir, "events")
    folder, root = scratch_path(spark, "landing-late"), scratch_path(spark, "parquet-late")
    rest = F.col("event_id") % 13
    events.where(rest > 1).select("event_id").repartition(12, F.xxhash64("event_id")).write.parquet(folder)
    events.where(rest == 0).select("event_id", "event_type").write.mode("append").parquet(folder)

    def land() -> None:
        drain(ingest_folder(spark, folder, "parquet", f"{root}/raw", f"{root}/state"))

    land()
    events.where(rest == 1).select("event_id", F.col("user_id").alias("note")).write.mode("append").parquet(folder)
    land()
    return spark.read.parquet(f"{root}/raw").drop("batch_id")


@query(
    "src_multiline_json",
    """SELECT n_nationkey::BIGINT AS n_nationkey, CASE WHEN n_regionkey <> 2 THEN n_regionkey::BIGINT END AS n_regionkey,
              CASE WHEN n_regionkey = 2 THEN '{"n_name":"' || n_name || '","n_regionkey":"region 2"}'
                   ELSE '{"n_name":"' || n_name || '"}' END AS _rescued_data FROM nation""",
)
def src_multiline_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents over several lines, a file each with a list of them: unknown and mistyped fields are rescued."""
    nations = table(spark, sf_dir, "nation")
    folder, root = scratch_path(spark, "landing-multiline"), scratch_path(spark, "json-multiline")
    for part in range(5):
        region = F.lit("region 2") if part == 2 else F.col("n_regionkey")
        rows = F.collect_list(F.struct("n_nationkey", "n_name", region.alias("n_regionkey")))
        lists = nations.where(F.col("n_regionkey") == part).agg(F.to_json(rows, {"pretty": "true"}).alias("value"))
        lists.coalesce(1).write.mode("append").text(folder)
    schema = StructType.fromDDL("n_nationkey long, n_regionkey long")
    drain(ingest_folder(spark, folder, "json", f"{root}/raw", f"{root}/state", schema=schema, multi_line=True))
    return spark.read.parquet(f"{root}/raw").drop("batch_id")


@query("sink_stream_append", "SELECT o_orderkey, o_orderstatus FROM orders")
def sink_stream_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run on the same checkpoint finds nothing new and adds no row."""
    root = scratch_path(spark, "stream-append")
    for _ in range(2):
        orders = table_stream(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
        drain(append_stream(orders, f"{root}/table", f"{root}/checkpoint"))
    return spark.read.parquet(f"{root}/table")


@query(
    "compact_and_delete",
    "SELECT o_orderkey, o_orderdate FROM orders WHERE NOT coalesce(o_orderdate < TIMESTAMP '1996-01-01', false)",
)
def compact_and_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small files are merged, then the table is rewritten without the erased rows."""
    root = scratch_path(spark, "compact")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    write_files(orders, f"{root}/small", files=2 * shuffle_width(spark))
    compact(spark, f"{root}/small", f"{root}/large", rows_per_file=1_000_000)
    rewrite_without(spark, f"{root}/large", f"{root}/kept", "o_orderdate < timestamp_ntz'1996-01-01 00:00:00'")
    return spark.read.parquet(f"{root}/kept")


@query(
    "stream_silver",
    """SELECT event_id, user_id, upper(event_type) AS action, round(value * 2, 4) AS doubled,
              CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE value IS NOT NULL""",
)
def stream_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw table as a stream, clean table from the raw table as a second stream."""
    root = scratch_path(spark, "stream-silver")
    raw = table_stream(spark, sf_dir, "events")
    drain(append_stream(raw, f"{root}/raw", f"{root}/raw-checkpoint"))
    silver = stream_files(spark, f"{root}/raw", "parquet", raw.schema).filter("value IS NOT NULL").select(
        "event_id",
        "user_id",
        F.upper("event_type").alias("action"),
        rounded(F.col("value") * 2, 4).alias("doubled"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"),
    )
    drain(append_stream(silver, f"{root}/silver", f"{root}/silver-checkpoint"))
    return spark.read.parquet(f"{root}/silver")


@query(
    "stream_enrich",
    """SELECT o_orderkey, o_custkey, o_totalprice, c_mktsegment AS segment FROM orders
       JOIN customer ON o_custkey = c_custkey""",
)
def stream_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stream of orders joined with a fixed table."""
    orders = table_stream(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    joined = enrich(orders, table(spark, sf_dir, "customer"), {"o_custkey": "c_custkey"}, {"segment": "c_mktsegment"})
    return _worked_off(spark, joined, "stream-enrich")


@query("stream_expect", with_views("SELECT * FROM feed_metrics", "cdc_feed", "feed_counts", "feed_metrics"))
def stream_expect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts observed while the stream writes its clean rows."""
    root = scratch_path(spark, "stream-expect")
    feed = cdc_feed_of(landed_stream(spark, sf_dir, "events"))
    drain(start_checked(feed, CDC_RULES, f"{root}/target", f"{root}/checkpoint"))
    return read_metrics(spark, f"{root}/target")


@query("stream_scd1", SCD1_SQL)
def stream_scd1(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "stream-scd1")
    feed = changes_of(cdc_feed_of(landed_stream(spark, sf_dir, "events")))
    drain(start_scd1(feed, f"{root}/target", f"{root}/checkpoint", KEYS, SEQUENCE, IS_DELETE))
    state = read_scd1(spark, f"{root}/target", KEYS, SEQUENCE, HIDDEN)
    return state.withColumn("operation_date", plain_time("operation_date"))


@query("stream_scd1_restart", SCD1_SQL)
def stream_scd1_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the feed, a fold, then the rest from a new checkpoint on the same target."""
    root = scratch_path(spark, "stream-scd1-restart")
    target = f"{root}/target"
    for half in range(2):
        events = landed_stream(spark, sf_dir, "events", 3).where(F.col("event_id") % 2 == half)
        feed = changes_of(cdc_feed_of(events))
        drain(start_scd1(feed, target, f"{root}/checkpoint-{half}", KEYS, SEQUENCE, IS_DELETE))
        if half == 0:
            fold_changes(spark, target, KEYS, SEQUENCE)
    state = read_scd1(spark, target, KEYS, SEQUENCE, HIDDEN)
    return state.withColumn("operation_date", plain_time("operation_date"))


@query(
    "stream_scd1_new_column",
    """SELECT o_custkey, max(o_orderkey) AS o_orderkey,
              CASE WHEN max(o_orderkey) % 2 = 1 THEN arg_max(o_orderstatus, o_orderkey) END AS status
       FROM orders GROUP BY o_custkey""",
)
def stream_scd1_new_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that only later batches have is part of the state."""
    root = scratch_path(spark, "stream-scd1-column")
    for half, columns in enumerate((["o_custkey", "o_orderkey"], ["o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status")])):
        orders = landed_stream(spark, sf_dir, "orders", 2).where(F.col("o_orderkey") % 2 == half).select(*columns)
        drain(start_scd1(orders, f"{root}/target", f"{root}/checkpoint-{half}", "o_custkey", "o_orderkey"))
    return read_scd1(spark, f"{root}/target", "o_custkey", "o_orderkey")


@query("stream_scd2", SCD2_SQL)
def stream_scd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "stream-scd2")
    feed = changes_of(cdc_feed_of(landed_stream(spark, sf_dir, "events")))
    target = f"{root}/target"
    drain(start_scd2(feed, target, f"{root}/checkpoint", KEYS))
    hidden = [*HIDDEN, "operation_date"]
    return plain_versions(
        read_scd2(spark, target, KEYS, SEQUENCE, apply_as_deletes=IS_DELETE, except_columns=hidden)
    )


@query("stream_scd2_stored", SCD2_SQL)
def stream_scd2_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history as a stored table: each of five micro-batches, in no order, splices its changes in."""
    root = scratch_path(spark, "stream-scd2-stored")
    feed = changes_of(cdc_feed_of(landed_stream(spark, sf_dir, "events")))
    target = f"{root}/target"
    hidden = [*HIDDEN, "operation_date"]
    drain(
        start_scd2_stored(
            feed, target, f"{root}/checkpoint", KEYS, SEQUENCE, IS_DELETE, hidden, buckets=shuffle_width(spark)
        )
    )
    return plain_versions(read_versions(spark, target))


def _in_five_parts(spark: SparkSession, events: DataFrame) -> DataFrame:
    """The readings as a stream of five parts by time, with late ones inside and behind the watermark."""
    second = F.unix_seconds(F.col("ts").cast("timestamp"))
    first, last = events.agg(F.min(second), F.max(second)).first()
    ends = [first + (last - first) * i // 5 for i in range(1, 5)]
    place = sum((F.when(second >= end, 1).otherwise(0) for end in ends), F.lit(0))
    late = F.lit(False)
    for end in ends:
        late |= second.between(end - 2 * 3600, end - 1)
    placed = events.withColumn("__file", place + F.when(late & (F.col("event_id") % 2 == 0), 1).otherwise(0))
    folder, files = scratch_path(spark, "landing-hourly"), shuffle_width(spark)
    for number in range(5):
        part = placed.where(F.col("__file") == number).drop("__file")
        if number == 4:
            part = part.unionByName(events.where(second < first - first % 3600 + 3600))
        part.repartition(files).write.mode("append").parquet(folder)
    return stream_files(spark, folder, "parquet", events.schema, max_files_per_trigger=files)


@query(
    "stream_hourly",
    """SELECT user_id, date_trunc('hour', ts) AS hourly_timestamp, count(*) AS readings,
              round(avg(value), 6) AS avg_value, round(stddev_pop(value), 6) AS std_value,
              quantile_disc(value, 0.6) AS p60 FROM events GROUP BY ALL""",
)
def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five parts in the order of time, a micro-batch each.

    Every second reading of the two hours before a part's end comes with the next part: its window is written again. The
    last part repeats the readings of the first hour: they are behind the watermark, and nothing changes.
    """
    root = scratch_path(spark, "stream-hourly")
    events = _in_five_parts(spark, table(spark, sf_dir, "events"))
    stats = windowed_statistics(events, "user_id", F.col("ts").cast("timestamp"), "value", ["value"])
    drain(start_windowed(stats, f"{root}/target", f"{root}/checkpoint"))
    newest = read_windowed(spark, f"{root}/target", "user_id")
    return newest.select(
        "user_id",
        plain_time("hourly_timestamp").alias("hourly_timestamp"),
        "readings",
        rounded("avg_value").alias("avg_value"),
        rounded("std_value").alias("std_value"),
        F.col("percentiles_value")[2].alias("p60"),
    )
