"""Sensor readings: bucketed statistics, status intervals, latest reading, scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepipe.features.scoring import model_udf, rule_model, score_table
from lakepipe.functions.scalars import epoch_to_timestamp
from lakepipe.operators.aggregates import bucket_statistics, describe_numeric
from lakepipe.operators.expectations import RuleSet, expect_or_drop
from lakepipe.operators.joins import interval_join, zip_join
from lakepipe.operators.relational import drop_columns
from lakepipe.operators.windows import latest_per_key
from lakepipe.plans.registry import plain_time, query, rounded, table
from lakepipe.plans.views import SQL, sensor_bronze, status, turbine, with_views
from lakepipe.session import cut_lineage

SENSORS = ["sensor_A", "sensor_B", "sensor_C", "sensor_D", "sensor_E", "sensor_F"]

BRONZE_RULES = RuleSet(
    "sensor_bronze", [expect_or_drop("correct_energy", "energy IS NOT NULL AND energy > 0")]
)
HOURLY_RULES = RuleSet(
    "sensor_hourly",
    [
        expect_or_drop("turbine_id_valid", "turbine_id IS NOT NULL"),
        expect_or_drop("timestamp_valid", "hourly_timestamp IS NOT NULL"),
    ],
)


def sensor_buckets(spark: SparkSession, sf_dir: str, unit: str) -> DataFrame:
    readings = BRONZE_RULES.apply(sensor_bronze(spark, sf_dir))
    time = epoch_to_timestamp("timestamp")
    return HOURLY_RULES.apply(bucket_statistics(readings, "turbine_id", time, "energy", unit=unit))


def _flat_statistics(df: DataFrame, sensors: list[str]) -> DataFrame:
    """Percentile vectors as one column per percentile, rounded for comparison."""
    flat = {"avg_energy": rounded("avg_energy")}
    for s in sensors:
        flat[f"std_{s}"] = rounded(f"std_{s}")
        for i in range(5):
            flat[f"p{i}_{s}"] = F.col(f"percentiles_{s}")[i]
    wide = df.withColumns(flat).drop(*[f"percentiles_{s}" for s in sensors])
    return wide.withColumn("hourly_timestamp", plain_time("hourly_timestamp"))


def _statistics_sql(sensors: list[str]) -> str:
    parts = ["round(avg(energy), 6) AS avg_energy"]
    for s in sensors:
        parts.append(f"round(stddev_pop({s}), 6) AS std_{s}")
        parts += [
            f"quantile_disc({s}, {p}) AS p{i}_{s}" for i, p in enumerate((0.1, 0.3, 0.6, 0.8, 0.95))
        ]
    return ", ".join(parts)


def _buckets_sql(unit: str) -> str:
    return f"""
SELECT turbine_id, date_trunc('{unit}', make_timestamp("timestamp" * 1000000)) AS hourly_timestamp,
       {_statistics_sql(SENSORS)}
FROM sensor_bronze WHERE energy > 0 GROUP BY ALL"""


SQL["sensor_monthly"] = _buckets_sql("month")
SQL["sensor_daily"] = """
SELECT turbine_id, date_trunc('day', make_timestamp("timestamp" * 1000000)) AS hourly_timestamp,
       avg(energy) AS avg_energy FROM sensor_bronze WHERE energy > 0 GROUP BY ALL"""


@query("sensor_stats", with_views("SELECT * FROM sensor_monthly", "sensor_bronze", "sensor_monthly"))
def sensor_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_statistics(sensor_buckets(spark, sf_dir, "month"), SENSORS)


@query(
    "sensor_hourly",
    """SELECT user_id, date_trunc('hour', ts) AS hourly_timestamp, round(avg(value), 6) AS avg_value,
              round(stddev_pop(value), 6) AS std_value, quantile_disc(value, 0.6) AS p60
       FROM events GROUP BY ALL""",
)
def sensor_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    stats = bucket_statistics(events, "user_id", F.col("ts").cast("timestamp"), "value", ["value"])
    return stats.select(
        "user_id",
        plain_time("hourly_timestamp").alias("hourly_timestamp"),
        rounded("avg_value").alias("avg_value"),
        rounded("std_value").alias("std_value"),
        F.col("percentiles_value")[2].alias("p60"),
    )


@query(
    "epoch_to_ts",
    with_views(
        'SELECT turbine_id, make_timestamp("timestamp" * 1000000) AS at FROM sensor_bronze', "sensor_bronze"
    ),
)
def epoch_to_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = sensor_bronze(spark, sf_dir)
    return readings.select("turbine_id", plain_time(epoch_to_timestamp("timestamp")).alias("at"))


def _training(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    """Bucketed readings, joined with the device list and with the status that was valid then."""
    hourly = sensor_buckets(spark, sf_dir, "day").select("turbine_id", "hourly_timestamp", "avg_energy")
    hourly = hourly.withColumn("at", F.unix_timestamp("hourly_timestamp"))
    intervals = cut_lineage(status(spark, sf_dir))
    labelled = interval_join(
        hourly, intervals, ["turbine_id"], "at", "start_time", "end_time", method
    )
    joined = labelled.join(turbine(spark, sf_dir), "turbine_id")
    return drop_columns(joined, "at", "row", "_rescued_data").withColumns(
        {
            "hourly_timestamp": plain_time("hourly_timestamp"),
            "avg_energy": rounded("avg_energy"),
        }
    )


_TRAINING_SQL = with_views(
    """SELECT m.* REPLACE (round(avg_energy, 6) AS avg_energy), abnormal_sensor, start_time, end_time,
              model, location, state
       FROM sensor_daily m JOIN turbine USING (turbine_id)
       JOIN status s ON m.turbine_id = s.turbine_id
        AND make_timestamp(s.start_time * 1000000) < m.hourly_timestamp
        AND make_timestamp(s.end_time * 1000000) > m.hourly_timestamp""",
    "sensor_bronze",
    "sensor_daily",
    "turbine",
    "status",
)


@query("turbine_training", _TRAINING_SQL)
def turbine_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _training(spark, sf_dir, "direct")


@query("turbine_training_binned", _TRAINING_SQL)
def turbine_training_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join spread over time bins, as used when a device has very many intervals."""
    return _training(spark, sf_dir, "binned")


@query(
    "star_except",
    with_views(
        """SELECT m.* EXCLUDE (avg_energy), t.* EXCLUDE (turbine_id, model)
           FROM sensor_daily m JOIN turbine t ON m.turbine_id = t.turbine_id""",
        "sensor_bronze",
        "sensor_daily",
        "turbine",
    ),
)
def star_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    sensor_buckets(spark, sf_dir, "day").withColumn(
        "hourly_timestamp", plain_time("hourly_timestamp")
    ).select("turbine_id", "hourly_timestamp", "avg_energy").createOrReplaceTempView("sensor_daily_view")
    turbine(spark, sf_dir).createOrReplaceTempView("turbine_view")
    return spark.sql(
        """
        SELECT * EXCEPT (m.avg_energy, t.turbine_id, t.model)
        FROM sensor_daily_view m JOIN turbine_view t ON m.turbine_id = t.turbine_id
        """
    )


@query(
    "join_fanout",
    with_views(
        """SELECT turbine_id, hourly_timestamp, abnormal_sensor FROM sensor_daily JOIN turbine USING (turbine_id)
           JOIN status USING (turbine_id)""",
        "sensor_bronze",
        "sensor_daily",
        "turbine",
        "status",
    ),
)
def join_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant that ignores the interval: one row per status of the device."""
    return (
        sensor_buckets(spark, sf_dir, "day")
        .select("turbine_id", plain_time("hourly_timestamp").alias("hourly_timestamp"))
        .join(turbine(spark, sf_dir), ["turbine_id"])
        .join(status(spark, sf_dir), ["turbine_id"])
        .select("turbine_id", "hourly_timestamp", "abnormal_sensor")
    )


@query(
    "latest_per_key",
    """SELECT user_id, event_id, ts, event_type, value FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
       WHERE rn = 1""",
)
def latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return latest_per_key(events, ["user_id"], ["ts", "event_id"])


METRICS_SIGNATURE = "avg_energy double, std_sensor_A double, state string"
_FAULT_SQL = """CASE WHEN avg_energy < 40000 OR (std_sensor_A > 12 AND state = 'NATION_3') THEN 'sensor_A'
                     ELSE 'ok' END"""


def _faulty(frame) -> list:
    return [
        frame["avg_energy"] < 40000,
        (frame["std_sensor_A"] > 12) & (frame["state"] == "NATION_3"),
    ]


@query(
    "score_latest",
    with_views(
        f"""SELECT turbine_id, hourly_timestamp, location, {_FAULT_SQL} AS prediction FROM (
              SELECT *, row_number() OVER (PARTITION BY turbine_id ORDER BY hourly_timestamp DESC) AS rn
              FROM sensor_monthly) JOIN turbine USING (turbine_id) WHERE rn = 1""",
        "sensor_bronze",
        "sensor_monthly",
        "turbine",
    ),
)
def score_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score the newest statistics of every device."""
    metrics = sensor_buckets(spark, sf_dir, "month").select(
        "turbine_id", "hourly_timestamp", "avg_energy", "std_sensor_A"
    )
    newest = latest_per_key(metrics, ["turbine_id"], ["hourly_timestamp"])
    inputs = newest.join(turbine(spark, sf_dir), "turbine_id")
    udf = model_udf(rule_model(_faulty, "sensor_A", "ok"), METRICS_SIGNATURE, "string")
    return score_table(inputs, udf, METRICS_SIGNATURE).select(
        "turbine_id",
        plain_time("hourly_timestamp").alias("hourly_timestamp"),
        "location",
        "prediction",
    )


@query(
    "damaged_flag",
    with_views("SELECT turbine_id, abnormal_sensor, abnormal_sensor <> 'N' AS damaged FROM status", "status"),
)
def damaged_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    intervals = status(spark, sf_dir)
    return intervals.select("turbine_id", "abnormal_sensor", (F.col("abnormal_sensor") != "N").alias("damaged"))


def _describe_sql(column: str, source: str) -> str:
    return f"""SELECT '{column}' AS column_name, count({column}) AS "count", round(avg({column}), 6) AS mean,
       round(stddev_samp({column}), 6) AS stddev, CAST(min({column}) AS DOUBLE) AS "min",
       CAST(quantile_disc({column}, 0.25) AS DOUBLE) AS q25, CAST(quantile_disc({column}, 0.5) AS DOUBLE) AS q50,
       CAST(quantile_disc({column}, 0.75) AS DOUBLE) AS q75, CAST(max({column}) AS DOUBLE) AS "max" FROM {source}"""


@query(
    "describe_numeric",
    "\nUNION ALL\n".join(
        _describe_sql(c, "lineitem") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
)
def describe_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    summary = describe_numeric(lines, columns, exact=True)
    return summary.withColumns({"mean": rounded("mean"), "stddev": rounded("stddev")})


@query("distinct_pairs", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag").dropDuplicates()


@query(
    "zip_join",
    """SELECT o_orderkey, l.event_id FROM
         (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders) o
         JOIN (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS n FROM events) l USING (n)""",
)
def zip_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    zipped = zip_join(orders, events, ["o_orderdate", "o_orderkey"], ["ts", "event_id"])
    return zipped.select("o_orderkey", "event_id")
