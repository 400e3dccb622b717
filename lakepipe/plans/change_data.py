"""Change-data-capture queries over the event feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepipe.functions.scalars import parse_timestamp
from lakepipe.operators.changes import apply_changes_scd1, apply_changes_scd2, snapshot_diff
from lakepipe.operators.relational import union_many
from lakepipe.plans.quality import CDC_RULES
from lakepipe.plans.registry import plain_time, query, table
from lakepipe.plans.views import SQL, cdc_feed, cdc_feed_of, with_views

KEYS = "id"
SEQUENCE = ["operation_date", "event_id"]
IS_DELETE = "operation = 'DELETE'"
HIDDEN = ["operation"]


def changes_of(feed: DataFrame) -> DataFrame:
    """Valid changes with the sequence text parsed: text order is wrong across years."""
    valid = CDC_RULES.apply(feed).drop("_rescued_data")
    return valid.withColumn("operation_date", parse_timestamp("operation_date"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes_of(cdc_feed(spark, sf_dir))


SQL["scd1_state"] = """
SELECT id, operation_date, event_id, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY operation_date DESC, event_id DESC) AS rn FROM cdc_changes)
WHERE rn = 1 AND operation <> 'DELETE'"""
SCD1_VIEWS = ("cdc_feed", "cdc_changes", "scd1_state")
SCD1_SQL = with_views("SELECT * FROM scd1_state", *SCD1_VIEWS)


def state_of(feed: DataFrame, **options) -> DataFrame:
    state = apply_changes_scd1(feed, KEYS, SEQUENCE, IS_DELETE, HIDDEN, **options)
    return state.withColumn("operation_date", plain_time("operation_date"))


@query("scd1", SCD1_SQL)
def scd1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state_of(changes(spark, sf_dir))


@query("scd1_out_of_order", SCD1_SQL)
def scd1_out_of_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed arrives in random order; the state is the same."""
    events = table(spark, sf_dir, "events").repartition(16, F.xxhash64("event_id"))
    return state_of(changes_of(cdc_feed_of(events)))


@query(
    "scd1_ignore_nulls",
    with_views(
        """SELECT id, CAST(event_id AS BIGINT) AS event_id, "value", props FROM (
             SELECT id,
               max(event_id) FILTER (NOT gone) AS event_id, max(event_id) FILTER (gone) AS last_delete,
               max_by(v, event_id) FILTER (NOT gone AND v IS NOT NULL) AS v0,
               max(event_id) FILTER (NOT gone AND v IS NOT NULL) AS v_at,
               max_by(p, event_id) FILTER (NOT gone AND p IS NOT NULL) AS p0,
               max(event_id) FILTER (NOT gone AND p IS NOT NULL) AS p_at,
               CASE WHEN v_at > coalesce(last_delete, -1) THEN v0 END AS "value",
               CASE WHEN p_at > coalesce(last_delete, -1) THEN p0 END AS props
             FROM (SELECT id, event_id, operation = 'DELETE' AS gone,
                          CASE WHEN event_id % 3 <> 0 THEN "value" END AS v,
                          CASE WHEN event_id % 2 <> 0 THEN props END AS p FROM cdc_changes)
             GROUP BY id)
           WHERE event_id > coalesce(last_delete, -1)""",
        "cdc_feed",
        "cdc_changes",
    ),
)
def scd1_ignore_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls in an update leave the older value in place."""
    partial = changes(spark, sf_dir).select(
        "id",
        "operation",
        "event_id",
        F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 2 != 0, F.col("props")).alias("props"),
    )
    return apply_changes_scd1(
        partial, KEYS, "event_id", IS_DELETE, HIDDEN, ignore_null_updates=True
    )


SQL["scd2_history"] = """
SELECT * EXCLUDE (operation) FROM (
  SELECT id, event_id, value, props, operation, operation_date AS start_at,
         lead(operation_date) OVER (PARTITION BY id ORDER BY operation_date, event_id) AS end_at
  FROM cdc_changes)
WHERE operation <> 'DELETE'"""
SCD2_VIEWS = ("cdc_feed", "cdc_changes", "scd2_history")
SCD2_SQL = with_views("SELECT * FROM scd2_history", *SCD2_VIEWS)


def plain_versions(df: DataFrame) -> DataFrame:
    return df.withColumns({c: plain_time(c) for c in ("start_at", "end_at")})


@query("scd2", SCD2_SQL)
def scd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = apply_changes_scd2(
        changes(spark, sf_dir), KEYS, SEQUENCE, IS_DELETE, [*HIDDEN, "operation_date"]
    )
    return plain_versions(history)


@query(
    "scd2_track_cols",
    with_views(
        """, flagged AS (
             SELECT *, operation = 'DELETE' AS gone, value > 20 AS big,
                    lag(operation = 'DELETE') OVER w AS prev_gone, lag(value > 20) OVER w AS prev_big
             FROM cdc_changes WINDOW w AS (PARTITION BY id ORDER BY operation_date, event_id)),
           numbered AS (
             SELECT *, sum(CASE WHEN prev_gone IS NULL OR prev_gone OR gone OR big IS DISTINCT FROM prev_big
                           THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY operation_date, event_id) AS version
             FROM flagged),
           versions AS (
             SELECT id, version, bool_or(gone) AS gone, any_value(big) AS big, arg_max(props, event_id) AS props,
                    min(operation_date) AS start_at FROM numbered GROUP BY id, version)
           SELECT id, big, props, start_at, end_at FROM (
             SELECT *, lead(start_at) OVER (PARTITION BY id ORDER BY version) AS end_at FROM versions)
           WHERE NOT gone""",
        "cdc_feed",
        "cdc_changes",
    ),
)
def scd2_track_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only a change of ``big`` opens a version; ``props`` shows the newest value in it."""
    feed = changes(spark, sf_dir).withColumn("big", F.col("value") > 20).drop("value")
    history = apply_changes_scd2(
        feed,
        KEYS,
        SEQUENCE,
        IS_DELETE,
        [*HIDDEN, "operation_date", "event_id"],
        track_history_on=["big"],
    )
    return plain_versions(history)


@query(
    "cdc_factory",
    with_views(
        """SELECT 'events' AS feed, count(*) AS live_keys, CAST(sum(event_id) AS BIGINT) AS check_sum FROM scd1_state
           UNION ALL
           SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM (
             SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
             FROM orders) WHERE rn = 1 AND o_orderstatus <> 'F'""",
        *SCD1_VIEWS,
    ),
)
def cdc_factory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One clean-and-apply flow per feed, built in a loop."""
    events = changes(spark, sf_dir).select("id", "operation", "operation_date", "event_id")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"),
        F.when(F.col("o_orderstatus") == "F", "DELETE").otherwise("UPDATE").alias("operation"),
        F.col("o_orderdate").alias("operation_date"),
        F.col("o_orderkey").alias("event_id"),
    )
    counted = []
    for name, feed in {"events": events, "orders": orders}.items():
        state = apply_changes_scd1(feed, KEYS, SEQUENCE, IS_DELETE, HIDDEN)
        counted.append(
            state.agg(
                F.lit(name).alias("feed"),
                F.count(F.lit(1)).alias("live_keys"),
                F.sum("event_id").alias("check_sum"),
            )
        )
    return union_many(counted)


@query(
    "snapshot_diff",
    """WITH newer AS (
         SELECT c_custkey, c_name, c_acctbal + CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS c_acctbal
         FROM customer WHERE c_acctbal >= 0
         UNION ALL
         SELECT -1 - c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'MACHINERY')
       SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name,
              coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal,
              CASE WHEN o.c_custkey IS NULL THEN 'insert' WHEN n.c_custkey IS NULL THEN 'delete' ELSE 'update' END
                AS change_type
       FROM customer o FULL JOIN newer n ON o.c_custkey = n.c_custkey
       WHERE o.c_custkey IS NULL OR n.c_custkey IS NULL OR o.c_acctbal IS DISTINCT FROM n.c_acctbal""",
)
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserted, updated and deleted rows between two states of a table."""
    customers = table(spark, sf_dir, "customer")
    columns = ["c_custkey", "c_name", "c_acctbal"]
    raised = F.col("c_acctbal") + F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0)
    kept = customers.filter("c_acctbal >= 0").withColumn("c_acctbal", raised)
    added = customers.filter("c_mktsegment = 'MACHINERY'").withColumn("c_custkey", -1 - F.col("c_custkey"))
    new = kept.select(*columns).unionByName(added.select(*columns))
    return snapshot_diff(customers.select(*columns), new, "c_custkey")
