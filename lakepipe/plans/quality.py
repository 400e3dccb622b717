"""Rules on feeds: cleaning, counting, log rows and their analysis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepipe.functions.scalars import HISTORY_TIMESTAMP, parse_timestamp
from lakepipe.operators import event_log
from lakepipe.operators.expectations import (
    RuleSet,
    expect,
    expect_all,
    expect_or_drop,
    expect_or_fail,
    roll_up,
)
from lakepipe.plans.loans import CLEAN_RULES, TX_VIEWS, new_txs
from lakepipe.plans.registry import plain_time, query, table
from lakepipe.plans.views import SQL, cdc_feed, with_views
from lakepipe.sources.files import delimited_table

CDC_RULES = RuleSet(
    "customers_cdc_clean",
    [
        expect_or_drop("valid_id", "id IS NOT NULL"),
        expect_or_drop("valid_operation", "operation IN ('APPEND', 'DELETE', 'UPDATE')"),
        expect_or_drop("valid_json_schema", "_rescued_data IS NULL"),
    ],
)


@query(
    "expect_warn",
    with_views(
        """SELECT id, next_payment_date,
                  CASE WHEN coalesce(next_payment_date > DATE '2020-12-31', false) THEN 0 ELSE 1 END AS failed
           FROM new_txs""",
        *TX_VIEWS,
    ),
)
def expect_warn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A warn rule keeps every row; the row says which rules it breaks."""
    rules = RuleSet("new_txs", [expect("this_year", "next_payment_date > date'2020-12-31'")])
    flagged = rules.flagged(rules.apply(new_txs(spark, sf_dir)))
    return flagged.select(
        "id", plain_time("next_payment_date").alias("next_payment_date"), F.size("failed_rules").alias("failed")
    )


@query("expect_fail_pass", "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 0")
def expect_fail_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fail rule that every row satisfies changes nothing; the drop rule still works."""
    rules = RuleSet(
        "orders",
        [expect_or_fail("has_key", "o_orderkey IS NOT NULL"), expect_or_drop("priced", "o_totalprice > 0")],
    )
    return rules.apply(table(spark, sf_dir, "orders")).select("o_orderkey", "o_custkey")


@query(
    "expect_all",
    """SELECT name, passed_records, total - passed_records AS failed_records FROM (
         SELECT 'valid_id' AS name, count(*) FILTER (user_id IS NOT NULL AND event_id IS NOT NULL) AS passed_records,
                count(*) AS total FROM events
         UNION ALL
         SELECT 'valid_value', count(*) FILTER (value > 10), count(*) FROM events)""",
)
def expect_all_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = RuleSet(
        "events",
        expect_all({"valid_id": "user_id IS NOT NULL AND event_id IS NOT NULL", "valid_value": "value > 10"}),
    )
    return rules.metrics(table(spark, sf_dir, "events")).select("name", "passed_records", "failed_records")


@query(
    "cdc_clean",
    with_views(
        """SELECT id, operation, operation_date, event_id, value, props FROM cdc_feed
           WHERE id IS NOT NULL AND operation IN ('APPEND', 'DELETE', 'UPDATE') AND _rescued_data IS NULL""",
        "cdc_feed",
    ),
)
def cdc_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CDC_RULES.apply(cdc_feed(spark, sf_dir)).drop("_rescued_data")


_COUNTED = """count(*) AS total, count(*) FILTER (id IS NOT NULL) AS ok_id,
       count(*) FILTER (operation IN ('APPEND', 'DELETE', 'UPDATE')) AS ok_operation,
       count(*) FILTER (_rescued_data IS NULL) AS ok_json,
       count(*) FILTER (id IS NOT NULL AND operation IN ('APPEND', 'DELETE', 'UPDATE')
                        AND _rescued_data IS NULL) AS kept"""
_PER_RULE = """'customers_cdc_clean' AS dataset, name, 'drop' AS action, passed AS passed_records,
       total - passed AS failed_records, total - kept AS dropped_records, kept AS output_records"""
_RULE_VALUES = """LATERAL (VALUES ('valid_id', ok_id), ('valid_operation', ok_operation),
                                  ('valid_json_schema', ok_json)) r(name, passed)"""

SQL["feed_counts"] = f"SELECT {_COUNTED} FROM cdc_feed"
SQL["feed_metrics"] = f"SELECT {_PER_RULE} FROM feed_counts, {_RULE_VALUES}"
SQL["daily_counts"] = f"SELECT substr(operation_date, 1, 10) AS day, {_COUNTED} FROM cdc_feed GROUP BY day"
SQL["daily_metrics"] = f"SELECT day, {_PER_RULE} FROM daily_counts, {_RULE_VALUES}"
DAILY_VIEWS = ("cdc_feed", "daily_counts", "daily_metrics")


@query("dq_metrics", with_views("SELECT * FROM feed_metrics", "cdc_feed", "feed_counts", "feed_metrics"))
def dq_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CDC_RULES.metrics(cdc_feed(spark, sf_dir))


def feed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run log with one progress event per day of the feed."""
    feed = cdc_feed(spark, sf_dir).withColumn("day", F.substring("operation_date", 1, 10))
    return event_log.progress_events(CDC_RULES.metrics(feed, by=["day"]), ["day"])


@query(
    "dq_results",
    with_views("SELECT day, dataset, name, passed_records, failed_records, dropped_records, output_records, "
        "'COMPLETED' AS status_update FROM daily_metrics", *DAILY_VIEWS),
)
def dq_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule results read back from the JSON of the log."""
    return event_log.rule_results(feed_log(spark, sf_dir), "day")


@query(
    "dq_rollup",
    with_views(
        """SELECT name, CAST(sum(passed_records) AS BIGINT) AS passed_records,
                  CAST(sum(failed_records) AS BIGINT) AS failed_records FROM daily_metrics GROUP BY name""",
        *DAILY_VIEWS,
    ),
)
def dq_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roll_up(event_log.rule_results(feed_log(spark, sf_dir), "day"))


@query(
    "dq_metrics_loans",
    with_views(
        """SELECT name, action, passed AS passed_records, total - passed AS failed_records,
                  total - kept AS dropped_records, kept AS output_records
           FROM (SELECT count(*) AS total, count(*) FILTER (balance > 0 AND arrears_balance > 0) AS kept,
                        count(*) FILTER (next_payment_date > DATE '2020-12-31') AS on_time,
                        count(*) FILTER (cost_center_code IS NOT NULL) AS centered FROM new_txs),
           LATERAL (VALUES ('Payments should be this year', 'warn', on_time),
                           ('Balance should be positive', 'drop', kept),
                           ('Cost center must be specified', 'fail', centered)) r(name, action, passed)""",
        *TX_VIEWS,
    ),
)
def dq_metrics_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CLEAN_RULES.metrics(new_txs(spark, sf_dir)).drop("dataset")


@query(
    "log_lineage",
    """SELECT event_id, 'clean_' || event_type AS output_dataset, '["raw_' || event_type || '"]' AS input_datasets,
              CASE WHEN event_id % 2 = 0 THEN 'APPEND' ELSE 'COMPLETE' END AS flow_type
       FROM events WHERE event_type IN ('purchase', 'signup')""",
)
def log_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flow definitions inside a mixed log: other kinds of events have no such entry."""
    definition = F.struct(
        F.struct(
            F.concat(F.lit("clean_"), "event_type").alias("output_dataset"),
            F.array(F.concat(F.lit("raw_"), "event_type")).alias("input_datasets"),
            F.when(F.col("event_id") % 2 == 0, "APPEND").otherwise("COMPLETE").alias("flow_type"),
        ).alias("flow_definition")
    )
    progress = F.struct(F.struct(F.lit("RUNNING").alias("status")).alias("flow_progress"))
    log = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type").isin("purchase", "signup"), F.to_json(definition))
        .otherwise(F.to_json(progress))
        .alias("details"),
    )
    return event_log.lineage(log, "event_id").drop("flow_schema")


@query(
    "sort_log",
    with_views("SELECT day, name, failed_records FROM daily_metrics ORDER BY day DESC, name", *DAILY_VIEWS),
)
def sort_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = event_log.rule_results(feed_log(spark, sf_dir), "day")
    return results.select("day", "name", "failed_records").orderBy(F.desc("day"), "name")


HISTORY_COLUMNS = (
    "id string, dataset string, name string, passed_records int, failed_records string, "
    "dropped_records int, output_records int, status_update string, timestamp string"
)


@query(
    "dq_history_load",
    """SELECT CAST(event_id AS VARCHAR) AS id, 'feed' AS dataset, event_type AS name,
              CAST(user_id AS INTEGER) AS passed_records, '0' AS failed_records,
              CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 9 AS INTEGER) END AS dropped_records,
              CAST(event_id AS INTEGER) AS output_records, 'COMPLETED' AS status_update,
              date_trunc('millisecond', ts) AS "timestamp" FROM events""",
)
def dq_history_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited text (ids with stray blanks, a value that is no number) to a typed table."""
    events = table(spark, sf_dir, "events")
    line = F.concat_ws(
        ",",
        F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit("  ")),
        F.lit("feed"),
        "event_type",
        F.col("user_id").cast("string"),
        F.lit("0"),
        F.when(F.col("event_id") % 5 == 0, "n/a").otherwise((F.col("event_id") % 9).cast("string")),
        F.col("event_id").cast("string"),
        F.lit("COMPLETED"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'+0000'"),
    )
    typed = delimited_table(events.select(line.alias("value")), HISTORY_COLUMNS)
    return typed.withColumn(
        "timestamp", plain_time(parse_timestamp("timestamp", HISTORY_TIMESTAMP))
    )
