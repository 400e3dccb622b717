"""Landing zones of several feeds, tables by name, schemas from samples, and state that feeds a gold table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepipe.operators.changes import apply_changes_scd1
from lakepipe.operators.joins import enrich
from lakepipe.operators.relational import union_many
from lakepipe.plans.registry import query, table
from lakepipe.session import cut_lineage, scratch_path
from lakepipe.sinks.tables import append_table, create_table, insert_rows, overwrite_table, write_files
from lakepipe.sources.files import infer_schema, list_files, list_folders, read_files
from lakepipe.streaming.changes import apply_folders, read_scd1
from lakepipe.streaming.ingest import ingest_all, ingest_folder
from lakepipe.streaming.sinks import drain


def _zone(spark: SparkSession, feeds: dict[str, DataFrame], label: str, fmt: str = "json") -> str:
    """A landing zone with one folder per feed, each of several files."""
    root = scratch_path(spark, label)
    for name, feed in feeds.items():
        write_files(feed, f"{root}/{name}", fmt, files=3)
    return root


@query(
    "ingest_zone",
    """SELECT 'customer' AS feed, count(*) AS row_count, sum(c_custkey)::BIGINT AS check_sum FROM customer
       UNION ALL SELECT 'supplier', count(*), sum(s_suppkey)::BIGINT FROM supplier
       UNION ALL SELECT 'nation', count(*), sum(n_nationkey)::BIGINT FROM nation""",
)
def ingest_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every folder that is found in the zone becomes a raw table, all at the same time."""
    keys = {"customer": "c_custkey", "supplier": "s_suppkey", "nation": "n_nationkey"}
    feeds = {name: table(spark, sf_dir, name).select(F.col(key).alias("id")) for name, key in keys.items()}
    zone, out = _zone(spark, feeds, "zone"), scratch_path(spark, "zone-raw")
    made = ingest_all(spark, zone, "json", f"{out}/raw", f"{out}/state")
    if sorted(made) != list_folders(spark, zone):
        raise ValueError("a folder of the zone was not ingested")
    return union_many(
        [
            spark.read.parquet(path).agg(
                F.lit(name).alias("feed"), F.count(F.lit(1)).alias("row_count"), F.sum("id").alias("check_sum")
            )
            for name, path in made.items()
        ]
    )


_LATEST = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM f) WHERE rn = 1"""


@query(
    "cdc_factory_folders",
    f"""WITH o AS (SELECT o_custkey AS id, o_orderkey AS seq, o_orderstatus AS op FROM orders),
             l AS (SELECT l_partkey AS id, l_orderkey * 8 + l_linenumber AS seq, l_returnflag AS op FROM lineitem)
        SELECT 'orders' AS feed, count(*) AS live_keys, sum(seq)::BIGINT AS check_sum
        FROM ({_LATEST.replace("FROM f", "FROM o")}) WHERE op <> 'F'
        UNION ALL
        SELECT 'items', count(*), sum(seq)::BIGINT FROM ({_LATEST.replace("FROM f", "FROM l")}) WHERE op <> 'F'""",
)
def cdc_factory_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folders of a landing zone decide which flows there are: raw table, clean, applied state for each."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("op")
    )
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        F.col("l_returnflag").alias("op"),
    )
    zone, out = _zone(spark, {"orders": orders, "items": items}, "factory"), scratch_path(spark, "factory-out")
    raw = ingest_all(spark, zone, "json", f"{out}/raw", f"{out}/raw-state")
    made = apply_folders(
        spark, raw, lambda feed: feed.where("id IS NOT NULL"), f"{out}/applied", f"{out}/state", "id", "seq", "op = 'F'"
    )
    return union_many(
        [
            read_scd1(spark, path, "id", "seq").agg(
                F.lit(name).alias("feed"), F.count(F.lit(1)).alias("live_keys"), F.sum("seq").alias("check_sum")
            )
            for name, path in made.items()
        ]
    )


@query(
    "gold_on_state",
    """SELECT c_mktsegment AS segment, count(*) AS customers, sum(o_orderkey)::BIGINT AS check_sum FROM (
         SELECT o_custkey, o_orderkey, o_orderstatus,
                row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders)
       JOIN customer ON c_custkey = o_custkey WHERE rn = 1 AND o_orderstatus <> 'F' GROUP BY 1""",
)
def gold_on_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gold table over the applied state: changes and deletes have been taken in before the join."""
    feed = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    state = apply_changes_scd1(feed, "o_custkey", "o_orderkey", "o_orderstatus = 'F'")
    joined = enrich(state, table(spark, sf_dir, "customer"), {"o_custkey": "c_custkey"}, {"segment": "c_mktsegment"})
    return joined.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"), F.sum("o_orderkey").alias("check_sum"))


@query(
    "sink_named_tables",
    """SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation WHERE n_regionkey = 1
       UNION ALL SELECT r_regionkey::BIGINT, r_name FROM region UNION ALL SELECT -1, 'none'""",
)
def sink_named_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed table, inserted values, rows appended; then another table replaced by a selection of it."""
    first = scratch_path(spark, "named").rsplit("/", 1)[-1].replace("-", "_")
    second = f"{first}_copy"
    try:
        create_table(spark, first, "key BIGINT, name STRING")
        insert_rows(spark, first, "(-1, 'none')")
        regions = table(spark, sf_dir, "region")
        append_table(regions.select(F.col("r_regionkey").cast("long").alias("key"), F.col("r_name").alias("name")), first)
        overwrite_table(spark.range(3).toDF("other"), second)
        nations = table(spark, sf_dir, "nation").where("n_regionkey = 1")
        rows = nations.select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
        overwrite_table(spark.table(first).unionByName(rows), second)
        return cut_lineage(spark.table(second))
    finally:
        for name in (first, second):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


@query(
    "schema_from_sample",
    "SELECT event_id::VARCHAR AS event_id, user_id, value, NULL::VARCHAR AS later FROM events",
)
def schema_from_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema of one sample file, with a type replaced and a field added by hints, reads the whole folder."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    folder = _zone(spark, {"events": events}, "sample") + "/events"
    sample = list_files(spark, folder, 1)[0]
    schema = infer_schema(spark, sample, "json", hints="event_id string, later string, value double")
    return read_files(spark, folder, "json", schema)


@query("arrival_stamp", "SELECT n_nationkey::BIGINT AS n_nationkey, true AS stamped FROM nation")
def arrival_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows get the time of their batch, which lies between the start of the ingest and now."""
    started = spark.sql("SELECT current_timestamp() AS t").first()["t"]
    feed = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"))
    zone, out = _zone(spark, {"nation": feed}, "stamp"), scratch_path(spark, "stamp-out")
    drain(ingest_folder(spark, f"{zone}/nation", "json", f"{out}/raw", f"{out}/state", stamp="arrived"))
    inside = (F.col("arrived") >= F.lit(started)) & (F.col("arrived") <= F.current_timestamp())
    return spark.read.parquet(f"{out}/raw").select("n_nationkey", F.coalesce(inside, F.lit(False)).alias("stamped"))
