"""Sources, projections, filters, ordering, unions, scalar functions, generated columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepipe.features.scoring import map_frames
from lakepipe.functions.generators import inject_nulls, key_position, replicate, uniform, weighted_choice, with_ids
from lakepipe.functions.naming import normalize_columns
from lakepipe.functions.scalars import padded_id, wrap_json
from lakepipe.operators.joins import enrich
from lakepipe.operators.relational import hash_sample, union_many
from lakepipe.operators.windows import shuffled, top_rows
from lakepipe.plans.registry import query, rounded, table
from lakepipe.plans.views import txs, with_views
from lakepipe.session import scratch_path
from lakepipe.operators.ranges import shuffle_width
from lakepipe.sinks.tables import delete_rows, read_evolved, write_clustered, write_files
from lakepipe.sources.files import preview, read_files, table_on_path


@query("src_parquet_full_scan", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def src_parquet_full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")


@query(
    "src_parquet_scan",
    "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'",
)
def src_parquet_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four columns are read and the date test reaches the file reader."""
    lines = table(spark, sf_dir, "lineitem").filter("l_shipdate >= timestamp_ntz'1998-01-01 00:00:00'")
    return lines.select("l_orderkey", "l_linenumber", "l_quantity")


@query("src_sql_on_files", "SELECT o_orderkey, o_orderstatus FROM orders")
def src_sql_on_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table_on_path(spark, "parquet", f"{sf_dir}/orders.parquet", "o_orderkey, o_orderstatus")


# The accounting treatments.
TREATMENTS = [
    (0, "held_to_maturity"),
    (1, "available_for_sale"),
    (2, "amortised_cost"),
    (3, "loans_and_recs"),
    (4, "held_for_hedge"),
    (5, "fv_designated"),
]


@query(
    "src_inline_values",
    "SELECT c_custkey, treatment FROM customer JOIN (VALUES "
    + ", ".join(f"({i}, '{name}')" for i, name in TREATMENTS)
    + ") r(id, treatment) ON c_nationkey = id",
)
def src_inline_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    lookup = spark.createDataFrame(TREATMENTS, "id int, treatment string")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = enrich(customers, lookup, {"c_nationkey": "id"}, {"treatment": "treatment"})
    return joined.drop("c_nationkey")


@query(
    "src_range",
    """SELECT CAST(r.day AS DATE) AS day, count(event_id) AS events
       FROM (SELECT unnest(generate_series(min(CAST(ts AS DATE)) - INTERVAL 3 DAY, max(CAST(ts AS DATE)), INTERVAL 1 DAY)) AS day
             FROM events) r LEFT JOIN events ON CAST(ts AS DATE) = CAST(r.day AS DATE) GROUP BY ALL""",
)
def src_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated calendar over the days of the table; days without events count zero."""
    per_day = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).count()
    span = per_day.agg(F.unix_date(F.min("day")).alias("lo"), F.unix_date(F.max("day")).alias("hi")).first()
    days = spark.range(span["lo"] - 3, span["hi"] + 1).select(
        F.date_from_unix_date(F.col("id").cast("int")).alias("day")
    )
    return days.join(per_day, "day", "left").select(
        "day", F.coalesce("count", F.lit(0)).alias("events")
    )


@query("project_subset", "SELECT event_id, user_id, value FROM events")
def project_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "value")


@query(
    "normalize_columns",
    """SELECT p_partkey AS part_id, p_name AS part_name_full, p_brand AS brand_name, p_type AS part__type,
              p_size AS streaming_tv FROM part""",
)
def normalize_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("partID"),
        F.col("p_name").alias("partName (full)"),
        F.col("p_brand").alias("BrandName"),
        F.col("p_type").alias("Part-Type"),
        F.col("p_size").alias("StreamingTV"),
    )
    return normalize_columns(raw, {"part_i_d": "part_id", "streaming_t_v": "streaming_tv"})


@query("filter_eq", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


@query(
    "dropna_any",
    with_views(
        """SELECT id, balance, arrears_balance FROM txs
           WHERE id IS NOT NULL AND balance IS NOT NULL AND arrears_balance IS NOT NULL""",
        "txs",
    ),
)
def dropna_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txs(spark, sf_dir).select("id", "balance", "arrears_balance").dropna("any")


@query(
    "hash_sample",
    """SELECT event_id, value FROM events
       WHERE CAST('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 20""",
)
def sample_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: a fifth of the keys, the same ones on every run."""
    return hash_sample(table(spark, sf_dir, "events"), "event_id", 20).select("event_id", "value")


@query("random_sample")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").sample(0.2, seed=11).select("event_id", "value")


@query("row_count", "SELECT count(*) AS n_rows, count(*) > 0 AS ready FROM lineitem")
def row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n_rows"))
    return counted.withColumn("ready", F.col("n_rows") > 0)


@query(
    "top_n",
    "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10",
)
def top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return top_rows(orders, [F.desc("o_orderdate"), F.asc("o_orderkey")], 10)


@query("limit_n", "SELECT event_id, value FROM events ORDER BY event_id LIMIT 10")
def limit_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(table(spark, sf_dir, "events").select("event_id", "value").orderBy("event_id"))


@query("shuffle_rows", "SELECT o_orderkey FROM orders")
def shuffle_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shuffled(table(spark, sf_dir, "orders").select("o_orderkey"), seed=3)


@query(
    "union_many",
    """SELECT c_nationkey AS nation, 'customer' AS kind, c_acctbal AS balance FROM customer
       UNION ALL SELECT s_nationkey, 'supplier', s_acctbal FROM supplier
       UNION ALL SELECT n_nationkey, 'nation', 0 FROM nation""",
)
def union_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    def part(name: str, key: str, balance) -> DataFrame:
        return table(spark, sf_dir, name).select(
            F.col(key).alias("nation"), F.lit(name).alias("kind"), balance.alias("balance")
        )

    return union_many(
        [
            part("customer", "c_nationkey", F.col("c_acctbal")),
            part("supplier", "s_nationkey", F.col("s_acctbal")),
            part("nation", "n_nationkey", F.lit(0.0)),
        ]
    )


@query(
    "sink_file_roundtrip",
    """SELECT f.fmt, c_custkey, c_name, c_acctbal FROM customer,
       LATERAL (VALUES ('csv'), ('json'), ('parquet')) f(fmt)""",
)
def sink_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write in every file format, read back, stack."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    frames = []
    for fmt in ("csv", "json", "parquet"):
        path = scratch_path(spark, f"roundtrip-{fmt}")
        write_files(customers, path, fmt)
        back = read_files(spark, path, fmt, customers.schema)
        frames.append(back.select(F.lit(fmt).alias("fmt"), "c_custkey", "c_name", "c_acctbal"))
    return union_many(frames)


@query(
    "sink_schema_evolution",
    """SELECT c_custkey, c_name, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END AS c_mktsegment FROM customer""",
)
def sink_schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that gained a column: the older files have none, their rows read as null."""
    customers = table(spark, sf_dir, "customer")
    path = scratch_path(spark, "evolved")
    write_files(customers.filter("c_acctbal < 0").select("c_custkey", "c_name"), path)
    gained = customers.filter("c_acctbal >= 0").select("c_custkey", "c_name", "c_mktsegment")
    write_files(gained, path, mode="append")
    return read_evolved(spark, path)


@query("layout_clustered_write", "SELECT l_suppkey, l_orderkey, l_linenumber, l_shipdate FROM lineitem")
def layout_clustered_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate")
    path = scratch_path(spark, "clustered")
    write_clustered(lines, path, ["l_suppkey", "l_shipdate"])
    return spark.read.parquet(path)


@query("layout_interleaved_write", "SELECT l_suppkey, l_orderkey, l_linenumber, l_shipdate FROM lineitem")
def layout_interleaved_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table laid out for filters on any of two columns."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate")
    path = scratch_path(spark, "interleaved")
    write_clustered(lines, path, ["l_suppkey", "l_shipdate"], interleave=True)
    return spark.read.parquet(path)


@query(
    "delete_in_files",
    "SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders WHERE NOT coalesce(o_orderdate < TIMESTAMP '1993-01-01', false)",
)
def delete_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows are deleted from a stored table; files without such rows stay as they are."""
    path = scratch_path(spark, "delete-in-files")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    write_clustered(orders, path, ["o_orderdate"], files=2 * shuffle_width(spark))
    delete_rows(spark, path, "o_orderdate < timestamp_ntz'1993-01-01 00:00:00'")
    return spark.read.parquet(path)


@query(
    "concat_pad",
    """SELECT c_custkey, 'DEV' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS device,
              '{"data": ' || c_custkey || '}' AS wrapped FROM customer""",
)
def concat_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        padded_id("DEV", "c_custkey").alias("device"),
        wrap_json(F.col("c_custkey").cast("string")).alias("wrapped"),
    )


@query(
    "arith_round",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * 2 + 1, 0) AS doubled,
              round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem""",
)
def arith_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.round(F.col("l_quantity") * 2 + 1, 0).alias("doubled"),
        rounded(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).alias("net"),
    )


@query("ts_to_string", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, strftime(ts, '%Y-%m-%d') AS day FROM events")
def ts_to_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"),
        F.to_date("ts").cast("string").alias("day"),
    )


# Weights of the operations; they add up to 0.91 and are scaled.
OPERATION_WEIGHTS = {"APPEND": 0.5, "DELETE": 0.1, "UPDATE": 0.3, None: 0.01}


@query(
    "weighted_choice",
    """SELECT o_orderkey, CASE WHEN p < 0.5 / 0.91 THEN 'APPEND' WHEN p < 0.6 / 0.91 THEN 'DELETE'
              WHEN p < 0.9 / 0.91 THEN 'UPDATE' END AS operation
       FROM (SELECT o_orderkey, (o_orderkey % 1000) / 1000.0::DOUBLE AS p FROM orders)""",
)
def choose_operation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey",
        weighted_choice(key_position("o_orderkey", 1000), OPERATION_WEIGHTS).alias("operation"),
    )


@query("weighted_choice_random")
def choose_operation_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select("o_orderkey", weighted_choice(uniform(5), OPERATION_WEIGHTS).alias("operation"))


@query(
    "null_inject",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 100 >= 2 THEN o_custkey END AS user_id FROM orders",
)
def null_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        "o_orderkey", inject_nulls(F.col("o_custkey"), key_position("o_orderkey"), 0.02).alias("user_id")
    )


@query("unique_ids")
def unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_ids(table(spark, sf_dir, "orders").select("o_orderkey"))


@query(
    "unique_ids_check",
    "SELECT count(*) AS n_rows, count(*) AS uuids, count(*) AS numbers FROM orders",
)
def unique_ids_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No generated id occurs twice."""
    return unique_ids(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct("uuid").alias("uuids"),
        F.count_distinct("row_number").alias("numbers"),
    )


@query("uniform_random")
def uniform_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(uniform(9) * 1000).alias("amount"))


@query(
    "uniform_random_check",
    "SELECT count(*) AS n_rows, count(*) AS in_range, true AS centered FROM orders",
)
def uniform_random_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every draw lies in the range, and their mean in its middle."""
    return uniform_random(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("amount").between(0, 1000)).alias("in_range"),
        F.avg("amount").between(450, 550).alias("centered"),
    )


@query(
    "replicate_rows",
    """SELECT c_custkey, CAST(n AS INTEGER) AS copy FROM customer,
       LATERAL (SELECT unnest(generate_series(1, c_custkey % 5)) AS n)""",
)
def replicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replicate(table(spark, sf_dir, "customer").select("c_custkey"), F.col("c_custkey") % 5)


@query(
    "udf_scalar",
    "SELECT p_partkey, upper(substr(p_name, 1, 1)) || ':' || length(p_name) AS tag FROM part",
)
def udf_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain Python function per value, moved in Arrow batches."""

    @F.udf(returnType="string", useArrow=True)
    def tag(name: str | None) -> str | None:
        return None if name is None else f"{name[:1].upper()}:{len(name)}"

    return table(spark, sf_dir, "part").select("p_partkey", tag("p_name").alias("tag"))


@query(
    "map_in_pandas",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity * 2 AS twice FROM lineitem WHERE l_quantity > 10",
)
def map_in_pandas(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")

    def large(frame):
        kept = frame[frame["l_quantity"] > 10]
        return kept.assign(twice=kept["l_quantity"] * 2).drop(columns="l_quantity")

    return map_frames(lines, large, "l_orderkey long, l_linenumber int, l_partkey long, twice double")
