"""The feeds of the six workloads, derived row by row from the given tables.

Each view exists twice: as a DataFrame and as SQL text. Bad values (null ids,
unknown operations, unparsable text) are put in at fixed rates by key, so that
the rules downstream have something to find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepipe.functions.scalars import FEED_TIMESTAMP, padded_id
from lakepipe.plans.registry import table

# Fixed value: the day on which day counts end.
AS_OF = "2024-02-01"

SQL: dict[str, str] = {}


def with_views(body: str, *names: str) -> str:
    """Prefix a query with the views it reads (in the order of their dependence)."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" + body


def _day_text(first: str, key: str, days: int) -> Column:
    day = F.date_add(F.lit(first).cast("date"), F.pmod(F.col(key), F.lit(days)).cast("int"))
    return F.date_format(day, FEED_TIMESTAMP)


def _day_text_sql(first: str, key: str, days: int) -> str:
    return f"strftime(DATE '{first}' + CAST({key} % {days} AS INTEGER), '%m-%d-%Y %H:%M:%S')"


def parsed_sql(column: str) -> str:
    return f"try_strptime({column}, '%m-%d-%Y %H:%M:%S')"


# --- change data capture -----------------------------------------------------

SQL["cdc_feed"] = """
SELECT CASE WHEN event_id % 50 <> 0 THEN user_id END AS id,
       CASE WHEN event_id % 100 = 3 THEN NULL
            WHEN event_type = 'signup' THEN 'APPEND'
            WHEN event_type = 'error' THEN 'DELETE'
            WHEN event_type = 'view' THEN 'READ'
            ELSE 'UPDATE' END AS operation,
       strftime(ts, '%m-%d-%Y %H:%M:%S') AS operation_date,
       event_id, value, props,
       CASE WHEN event_id % 40 = 7 THEN props END AS _rescued_data
FROM events"""


def cdc_feed_of(events: DataFrame) -> DataFrame:
    operation = (
        F.when(F.col("event_id") % 100 == 3, F.lit(None).cast("string"))
        .when(F.col("event_type") == "signup", "APPEND")
        .when(F.col("event_type") == "error", "DELETE")
        .when(F.col("event_type") == "view", "READ")
        .otherwise("UPDATE")
    )
    return events.select(
        F.when(F.col("event_id") % 50 != 0, F.col("user_id")).alias("id"),
        operation.alias("operation"),
        F.date_format("ts", FEED_TIMESTAMP).alias("operation_date"),
        "event_id",
        "value",
        "props",
        F.when(F.col("event_id") % 40 == 7, F.col("props")).alias("_rescued_data"),
    )


def cdc_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc_feed_of(table(spark, sf_dir, "events"))


SQL["cdc_changes"] = f"""
SELECT id, operation, {parsed_sql('operation_date')} AS operation_date, event_id, value, props
FROM cdc_feed
WHERE id IS NOT NULL AND operation IN ('APPEND', 'DELETE', 'UPDATE') AND _rescued_data IS NULL"""

# --- loans -------------------------------------------------------------------

SQL["txs"] = f"""
SELECT c_custkey AS id, c_acctbal AS balance,
       CASE WHEN c_custkey % 37 = 5 THEN NULL ELSE CAST(c_custkey % 500 AS INTEGER) END AS arrears_balance,
       c_mktsegment AS cost_center_code, n_name AS country_code,
       CASE WHEN c_custkey % 10 = 3 THEN 99 ELSE c_nationkey END AS accounting_treatment_id,
       {_day_text_sql('2020-12-01', 'c_custkey', 60)} AS next_payment_date,
       CAST(c_custkey % 7 AS INTEGER) AS "count"
FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def txs(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).select(
        key.alias("id"),
        F.col("c_acctbal").alias("balance"),
        F.when(key % 37 != 5, (key % 500).cast("int")).alias("arrears_balance"),
        F.col("c_mktsegment").alias("cost_center_code"),
        F.col("n_name").alias("country_code"),
        F.when(key % 10 == 3, 99).otherwise(F.col("c_nationkey")).alias("accounting_treatment_id"),
        _day_text("2020-12-01", "c_custkey", 60).alias("next_payment_date"),
        (key % 7).cast("int").alias("count"),
    )


SQL["ref_treatment"] = "SELECT n_nationkey AS id, lower(n_name) AS accounting_treatment FROM nation"


def ref_treatment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("id"), F.lower("n_name").alias("accounting_treatment")
    )


SQL["historical"] = """
SELECT s_suppkey AS id, s_acctbal AS revol_bal, n_name AS addr_state,
       s_nationkey AS accounting_treatment_id,
       substr('ABCDEFGH', CAST(s_suppkey % 8 AS INTEGER) + 1, 1) AS grade,
       CASE WHEN s_suppkey % 9 = 4 THEN 'abc' ELSE CAST(s_suppkey AS VARCHAR) END AS recoveries
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def historical(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    key = F.col("s_suppkey")
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        key.alias("id"),
        F.col("s_acctbal").alias("revol_bal"),
        F.col("n_name").alias("addr_state"),
        F.col("s_nationkey").alias("accounting_treatment_id"),
        F.substring(F.lit("ABCDEFGH"), (key % 8).cast("int") + 1, F.lit(1)).alias("grade"),
        F.when(key % 9 == 4, "abc").otherwise(key.cast("string")).alias("recoveries"),
    )


# --- retail ------------------------------------------------------------------

SQL["users"] = f"""
SELECT CASE WHEN c_custkey % 50 <> 49 THEN c_custkey END AS id,
       lower(c_name) || '@example.com' AS email,
       {_day_text_sql('2013-01-01', 'c_custkey', 4000)} AS creation_date,
       {_day_text_sql('2024-01-01', 'c_custkey', 30)} AS last_activity_date,
       upper(c_mktsegment) AS firstname, lower(c_name) AS lastname,
       'nation ' || c_nationkey AS address,
       CASE c_custkey % 4 WHEN 0 THEN 'WEBAPP' WHEN 1 THEN 'MOBILE' WHEN 2 THEN 'PHONE' END AS canal,
       CASE c_nationkey % 3 WHEN 0 THEN 'FR' WHEN 1 THEN 'USA' ELSE 'SPAIN' END AS country,
       CAST(c_custkey % 2 AS DOUBLE) AS gender, CAST(c_custkey % 11 AS DOUBLE) AS age_group,
       c_acctbal < 0 AS churn
FROM customer"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    return table(spark, sf_dir, "customer").select(
        F.when(key % 50 != 49, key).alias("id"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        _day_text("2013-01-01", "c_custkey", 4000).alias("creation_date"),
        _day_text("2024-01-01", "c_custkey", 30).alias("last_activity_date"),
        F.upper("c_mktsegment").alias("firstname"),
        F.lower("c_name").alias("lastname"),
        F.concat(F.lit("nation "), nation.cast("string")).alias("address"),
        F.when(key % 4 == 0, "WEBAPP").when(key % 4 == 1, "MOBILE").when(key % 4 == 2, "PHONE").alias("canal"),
        F.when(nation % 3 == 0, "FR").when(nation % 3 == 1, "USA").otherwise("SPAIN").alias("country"),
        (key % 2).cast("double").alias("gender"),
        (key % 11).cast("double").alias("age_group"),
        (F.col("c_acctbal") < 0).alias("churn"),
    )


SQL["user_orders"] = """
SELECT CASE WHEN o_orderkey % 50 <> 49 THEN o_orderkey END AS id, o_custkey AS user_id,
       strftime(o_orderdate, '%m-%d-%Y %H:%M:%S') AS transaction_date,
       CAST(o_orderkey % 3 + 1 AS DOUBLE) AS item_count, o_totalprice AS amount
FROM orders"""


def user_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.when(key % 50 != 49, key).alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.date_format("o_orderdate", FEED_TIMESTAMP).alias("transaction_date"),
        (key % 3 + 1).cast("double").alias("item_count"),
        F.col("o_totalprice").alias("amount"),
    )


SQL["app_events"] = """
SELECT user_id, event_id, strftime(ts, '%m-%d-%Y %H:%M:%S') AS "date", event_type AS action,
       CASE event_id % 4 WHEN 0 THEN 'ios' WHEN 1 THEN 'android' WHEN 2 THEN 'other' END AS platform,
       json_extract_string(props, '$.k') AS session_id
FROM events"""


def app_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "user_id",
        "event_id",
        F.date_format("ts", FEED_TIMESTAMP).alias("date"),
        F.col("event_type").alias("action"),
        F.when(key % 4 == 0, "ios").when(key % 4 == 1, "android").when(key % 4 == 2, "other").alias("platform"),
        F.get_json_object("props", "$.k").alias("session_id"),
    )


# --- turbines ----------------------------------------------------------------

SQL["sensor_bronze"] = """
SELECT l_suppkey AS turbine_id, CAST(epoch(l_shipdate) AS BIGINT) AS "timestamp",
       CASE WHEN l_linenumber = 7 AND l_quantity > 45 THEN NULL ELSE l_extendedprice END AS energy,
       l_quantity AS sensor_A, l_discount AS sensor_B, l_tax AS sensor_C,
       l_extendedprice AS sensor_D, CAST(l_linenumber AS DOUBLE) AS sensor_E,
       CAST(l_partkey AS DOUBLE) AS sensor_F
FROM lineitem"""


def sensor_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = (F.col("l_linenumber") == 7) & (F.col("l_quantity") > 45)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("turbine_id"),
        F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("timestamp"),
        F.when(~broken, F.col("l_extendedprice")).alias("energy"),
        F.col("l_quantity").alias("sensor_A"),
        F.col("l_discount").alias("sensor_B"),
        F.col("l_tax").alias("sensor_C"),
        F.col("l_extendedprice").alias("sensor_D"),
        F.col("l_linenumber").cast("double").alias("sensor_E"),
        F.col("l_partkey").cast("double").alias("sensor_F"),
    )


SQL["turbine"] = """
SELECT s_suppkey AS turbine_id, 'standard' AS model, s_name AS location, n_name AS state
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def turbine(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return supplier.join(nation, supplier.s_nationkey == nation.n_nationkey).select(
        F.col("s_suppkey").alias("turbine_id"),
        F.lit("standard").alias("model"),
        F.col("s_name").alias("location"),
        F.col("n_name").alias("state"),
    )


SQL["status"] = """
SELECT l_suppkey AS turbine_id, l_returnflag AS abnormal_sensor,
       CAST(min(epoch(l_shipdate)) AS BIGINT) AS start_time,
       CAST(max(epoch(l_shipdate)) AS BIGINT) AS end_time
FROM lineitem GROUP BY l_suppkey, l_returnflag"""


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_timestamp(F.col("l_shipdate").cast("timestamp"))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("turbine_id"), F.col("l_returnflag").alias("abnormal_sensor"))
        .agg(F.min(seconds).alias("start_time"), F.max(seconds).alias("end_time"))
    )


# --- device packages ---------------------------------------------------------

SQL["package_flat"] = """
SELECT 'DEV' || lpad(CAST(l_suppkey AS VARCHAR), 12, '0') AS DeviceIdentifier,
       CAST(l_linenumber AS VARCHAR) AS InstanceIdentifier,
       CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber || '-' || l_partkey AS PackageIdentifier,
       CASE WHEN l_linestatus = 'F' THEN strftime(l_shipdate, '%Y-%m-%d') END AS DistributionFinished,
       'box' || CAST(l_suppkey % 7 AS VARCHAR) AS Mailbox,
       lower(l_returnflag) || '@example.com' AS RecipientMail,
       'sender' || CAST(l_partkey % 5 AS VARCHAR) || '@example.com' AS SenderMail,
       l_linenumber AS "Type", l_linenumber % 4 AS steps, l_shipdate AS shipped,
       l_orderkey, l_partkey, l_quantity
FROM lineitem"""

SQL["package_steps"] = """
SELECT p.*, s.Identifier, strftime(shipped + to_days(CAST(s.n AS INTEGER)), '%Y-%m-%d') AS OccurredAt
FROM package_flat p
JOIN (VALUES (1, 'Received'), (2, 'Transport'), (3, 'Delivered')) s(n, Identifier) ON s.n <= p.steps"""


def package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents, one per line item, with zero to three steps each (zero: empty or null)."""
    line = F.col("l_linenumber")
    names = ["Received", "Transport", "Delivered"]
    steps = F.array(
        *[
            F.struct(
                F.lit(name).alias("Identifier"),
                F.date_format(F.date_add(F.to_date("l_shipdate"), n), "yyyy-MM-dd").alias("OccurredAt"),
            )
            for n, name in enumerate(names, 1)
        ]
    )
    present = F.slice(steps, 1, (line % 4).cast("int"))
    source = F.struct(
        F.concat(F.lit("box"), (F.col("l_suppkey") % 7).cast("string")).alias("Mailbox"),
        F.concat(F.lower("l_returnflag"), F.lit("@example.com")).alias("RecipientMail"),
        F.concat(F.lit("sender"), (F.col("l_partkey") % 5).cast("string"), F.lit("@example.com")).alias("SenderMail"),
        line.alias("Type"),
    )
    finished = F.when(F.col("l_linestatus") == "F", F.date_format("l_shipdate", "yyyy-MM-dd"))
    inner = F.to_json(F.struct(F.col("l_partkey").alias("Part"), F.col("l_quantity").alias("Quantity")))
    return table(spark, sf_dir, "lineitem").select(
        padded_id("DEV", "l_suppkey").alias("DeviceIdentifier"),
        line.cast("string").alias("InstanceIdentifier"),
        F.to_json(
            F.struct(F.lit("reading").alias("SerializedType"), inner.alias("SerializedJsonData"))
        ).alias("SerializedJsonObject"),
        F.struct(
            F.struct(finished.alias("DistributionFinished"), source.alias("Source")).alias("DistributionDetails"),
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("PackageIdentifier"),
            F.when((line % 4 != 0) | (F.col("l_returnflag") == "N"), present).alias("PackageTraceSteps"),
        ).alias("PackageTrace"),
    )


SQL["device_list"] = """
SELECT 'DEV' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS DeviceIdentifier,
       CAST(s_suppkey % 7 + 1 AS VARCHAR) AS InstanceIdentifier, s_name AS DeviceName
FROM supplier"""


def device_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        padded_id("DEV", "s_suppkey").alias("DeviceIdentifier"),
        (F.col("s_suppkey") % 7 + 1).cast("string").alias("InstanceIdentifier"),
        F.col("s_name").alias("DeviceName"),
    )


# --- scored rows -------------------------------------------------------------

SQL["scored"] = """
SELECT l.doc_id, quality AS label, toxic AS prediction, n_chars AS score, lang, source
FROM labels l JOIN documents d ON l.doc_id = d.doc_id"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    return table(spark, sf_dir, "labels").join(documents, "doc_id").select(
        "doc_id",
        F.col("quality").alias("label"),
        F.col("toxic").alias("prediction"),
        F.col("n_chars").alias("score"),
        "lang",
        "source",
    )


# --- telco-like customers ----------------------------------------------------

# Feed columns: (column, values, after how many customers the value changes).
_YES_NO = ("No", "Yes")
_WITH_PHONE = ("No", "No phone service", "Yes")
_WITH_NET = ("No", "No internet service", "Yes")
TELCO_FLAGS = (
    ("partner", _YES_NO, 2),
    ("dependents", _YES_NO, 3),
    ("phone_service", _YES_NO, 5),
    ("multiple_lines", _WITH_PHONE, 1),
    ("online_security", _WITH_NET, 2),
    ("online_backup", _WITH_NET, 3),
    ("device_protection", _WITH_NET, 4),
    ("tech_support", _WITH_NET, 5),
    ("streaming_tv", _WITH_NET, 6),
    ("streaming_movies", _WITH_NET, 7),
    ("paperless_billing", _YES_NO, 7),
)


def _flag_sql(column: str, values: tuple[str, ...], every: int) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE (c_custkey // {every}) % {len(values)} {cases} END AS {column}"


SQL["telco"] = f"""
SELECT c_custkey AS customer_id, c_mktsegment AS contract,
       CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
       CASE c_nationkey % 3 WHEN 0 THEN 'DSL' WHEN 1 THEN 'Fiber optic' ELSE 'No' END AS internet_service,
       CASE c_custkey % 4 WHEN 0 THEN 'Bank transfer (automatic)' WHEN 1 THEN 'Mailed check'
                          WHEN 2 THEN 'Credit card (automatic)' ELSE 'Electronic check' END AS payment_method,
       {", ".join(_flag_sql(*flag) for flag in TELCO_FLAGS)},
       CAST(c_custkey % 72 AS INTEGER) AS tenure,
       CASE WHEN c_custkey % 17 <> 0 THEN c_acctbal END AS monthly_charges,
       CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_acctbal < 2000 THEN 'Yes' ELSE 'No' END AS churn
FROM customer"""


def telco(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    null = F.lit(None).cast("string")
    return table(spark, sf_dir, "customer").select(
        key.alias("customer_id"),
        F.col("c_mktsegment").alias("contract"),
        F.when(key % 13 == 0, null).when(key % 2 == 0, "Male").otherwise("Female").alias("gender"),
        F.when(nation % 3 == 0, "DSL").when(nation % 3 == 1, "Fiber optic").otherwise("No").alias("internet_service"),
        F.when(key % 4 == 0, "Bank transfer (automatic)")
        .when(key % 4 == 1, "Mailed check")
        .when(key % 4 == 2, "Credit card (automatic)")
        .otherwise("Electronic check")
        .alias("payment_method"),
        *[
            F.element_at(F.array(*map(F.lit, values)), (F.floor(key / every) % len(values) + 1).cast("int")).alias(column)
            for column, values, every in TELCO_FLAGS
        ],
        (key % 72).cast("int").alias("tenure"),
        F.when(key % 17 != 0, F.col("c_acctbal")).alias("monthly_charges"),
        F.when(key % 29 == 0, null)
        .when(F.col("c_acctbal") < 2000, "Yes")
        .otherwise("No")
        .alias("churn"),
    )
