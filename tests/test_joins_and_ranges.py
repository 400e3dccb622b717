from __future__ import annotations

import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lakepipe.operators.aggregates import (
    bucket_statistics,
    describe_numeric,
    exact_quantiles,
    first_by,
    named_aggregates,
    sensor_columns,
)
from lakepipe.operators import joins
from lakepipe.operators.joins import enrich, interval_join, zip_join
from lakepipe.operators.ranges import HEAD, PART, running_totals, sorted_ranges, with_neighbours
from lakepipe.operators.relational import castable, drop_columns, hash_sample, merge_shapes, union_many
from lakepipe.operators.windows import latest_per_key, shuffled, top_rows, with_row_index


def test_enrich_inner_drops_unknown_and_left_keeps(spark):
    facts = spark.createDataFrame([(1, 0), (2, 99), (3, None)], "id int, code int")
    lookup = spark.createDataFrame([(0, "zero"), (1, "one")], "id int, label string")
    inner = enrich(facts, lookup, {"code": "id"}, {"label": "label"})
    assert rows(inner) == [(1, 0, "zero")]
    left = enrich(facts, lookup, {"code": "id"}, {"label": "label"}, how="left")
    assert rows(left, "id", "label") == [(1, "zero"), (2, None), (3, None)]


def test_enrich_with_equal_column_names(spark):
    a = spark.createDataFrame([(1, "x")], "id int, name string")
    b = spark.createDataFrame([(1, "y")], "id int, name string")
    assert rows(enrich(a, b, {"id": "id"}, {"other_name": "name"})) == [(1, "x", "y")]


@pytest.mark.parametrize("method", ["direct", "binned"])
def test_interval_join_excludes_borders(spark, method):
    points = spark.createDataFrame([("a", 10), ("a", 15), ("a", 20), ("b", 15), (None, 15)], "k string, at long")
    intervals = spark.createDataFrame(
        [("a", 10, 20, "one"), ("a", 12, 18, "two"), ("b", 15, 15, "empty")],
        "k string, start_time int, end_time int, label string",
    )
    found = interval_join(points, intervals, ["k"], "at", "start_time", "end_time", method)
    assert rows(found, "k", "at", "label") == [("a", 15, "one"), ("a", 15, "two")]


def test_interval_join_methods_against_brute_force(spark):
    draw = random.Random(5)
    points = [(i, draw.choice("aab"), draw.randrange(-500, 500)) for i in range(200)]
    spans = []
    for i in range(150):
        start = draw.randrange(-600, 500)
        spans.append((draw.choice("aab"), start, start + draw.choice([0, 1, 2, 7, 8, 9, 100, 900]), i))
    expected = sorted((p[0], s[3]) for p in points for s in spans if p[1] == s[0] and s[1] < p[2] < s[2])
    left = spark.createDataFrame(points, "id int, k string, at long")
    right = spark.createDataFrame(spans, "k string, lo long, hi long, n int")
    for method in ("direct", "binned"):
        found = interval_join(left, right, ["k"], "at", "lo", "hi", method)
        assert rows(found, "id", "n") == expected
    assert interval_join(left, right.limit(0), ["k"], "at", "lo", "hi", "binned").count() == 0
    with pytest.raises(ValueError):
        interval_join(left, right, ["k"], "at", "lo", "hi", "other")


def test_row_index_is_gap_free_and_ordered(spark):
    values = list(range(500))
    random.Random(1).shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    assert rows(with_row_index(df, ["v"]), "v", "row_index") == [(v, v) for v in range(500)]


def test_one_interval_over_the_whole_line_among_short_ones(spark):
    n = 1_000_000
    short = spark.range(0, n, 10).select(F.lit("k").alias("k"), (F.col("id") - 1).alias("a"), (F.col("id") + 1).alias("b"), F.lit("s").alias("w"))
    wide = spark.createDataFrame([("k", -10, n + 10, "w"), ("k", 4096, 8192, "m")], "k string, a long, b long, w string")
    points = spark.range(0, n, 1000).select(F.lit("k").alias("k"), F.col("id").alias("t"))
    found = interval_join(points, short.unionByName(wide), ["k"], "t", "a", "b")
    longest = joins.BINS_PER_BLOCK
    assert rows(found.groupBy("w").count()) == [("m", 4), ("s", 1000), ("w", 1000)]
    blocks = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("explode(") if "sequence" in x]
    assert len(blocks) >= 2 and longest == 4096


def test_zip_join_pairs_by_position_and_drops_the_rest(spark):
    left = spark.createDataFrame([(i,) for i in (30, 10, 20)], "a int").repartition(3)
    right = spark.createDataFrame([("x",), ("z",), ("y",), ("w",)], "b string").repartition(2)
    assert rows(zip_join(left, right, ["a"], ["b"])) == [(10, "w"), (20, "x"), (30, "y")]


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_against_brute_force(spark, descending):
    draw = random.Random(2)
    data = [(g, v, draw.randrange(10)) for g in "ab" for v in draw.sample(range(1000), 200)]
    df = spark.createDataFrame(data, "g string, v int, n int")
    found = running_totals(df, "v", {"upto": "n"}, within=["g"], descending=descending, ranges=9)
    expected = []
    for g in "ab":
        total = 0
        for _, v, n in sorted((r for r in data if r[0] == g), key=lambda r: r[1], reverse=descending):
            total += n
            expected.append((g, v, total))
    assert rows(found, "g", "v", "upto") == sorted(expected)


def test_running_totals_of_many_groups_with_null_ones(spark):
    data = [(g, v, 1) for g in (None, *range(40)) for v in range(5)]
    df = spark.createDataFrame(data, "g int, v int, n int")
    found = running_totals(df, "v", {"upto": "n"}, within=["g"], ranges=7)
    assert rows(found) == rows(spark.createDataFrame([(*r, r[1] + 1) for r in data], "g int, v int, n int, upto int"))
    assert running_totals(df.limit(0), "v", {"upto": "n"}, within=["g"]).collect() == []


def test_ranges_are_filled_evenly_and_ordered(spark):
    df = spark.range(10_000).withColumn("v", (F.col("id") % 4999).cast("double"))
    sizes = sorted_ranges(df, ["v"], 8).groupBy(PART).agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.min_by(HEAD, "v").alias("head")
    )
    found = sorted(sizes.collect(), key=lambda r: r[PART])
    assert len(found) == 8 and max(r["n"] for r in found) < 2 * 10_000 / 8
    assert all(a["hi"] < b["lo"] for a, b in zip(found, found[1:]))
    assert [r["head"] for r in found] == [False] + [True] * 7


@pytest.mark.parametrize("ranges", [2, 9])
def test_ranges_of_every_type(spark, ranges):
    stamp = dt.datetime(2024, 1, 1)
    data = [
        (float("nan") if i == 39 else i - 20.5, f"2024 {i:03d}", stamp + dt.timedelta(microseconds=i), i % 2 == 0, i % 5 or None)
        for i in range(40)
    ]
    df = spark.createDataFrame(data, "n double, s string, t timestamp, b boolean, k int").withColumns(
        {"z": F.col("t").cast("timestamp_ntz"), "d": F.col("t").cast("date"), "x": F.col("s").cast("binary")}
    )
    for columns in (["n"], ["s"], ["t"], ["z"], ["d"], ["b"], ["x"], ["k", "s"]):
        parted = sorted_ranges(df, columns, ranges).orderBy(*columns).select(PART, HEAD, *columns).collect()
        numbers = [r[0] for r in parted]
        assert numbers == sorted(numbers) and max(numbers) < ranges
        # one value never stands in two ranges, and the first rows of a range are marked
        values = [tuple(map(str, r[2:])) for r in parted]
        assert len(set(zip(numbers, values))) == len(set(values))
        first_of = {}
        for n, v in zip(numbers, values):
            first_of.setdefault(n, v)
        assert [bool(r[1]) for r in parted] == [n > 0 and first_of[n] == v for n, v in zip(numbers, values)]


@pytest.mark.parametrize("ranges", [2, 50])
def test_neighbours_across_ranges_with_nulls(spark, ranges):
    data = [(k, v) for k in ("k", None, "m") for v in (None, 1, 2, 5, 9, 9, 12)] + [("n", 3), ("o", None)]
    df = spark.createDataFrame([(*r, i, -i) for i, r in enumerate(data)], "k string, v int, t int, w int")
    for sides in ({"lead": {"nxt": "v", "wn": "w"}}, {"lag": {"prv": "v"}}, {"lead": {"nxt": "w"}, "lag": {"prv": "v"}}):
        plain = with_neighbours(df, ["k"], ["v", "t"], **sides)
        assert rows(with_neighbours(df, ["k"], ["v", "t"], **sides, ranges=ranges)) == rows(plain)


def test_latest_per_key_and_all_null_order(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, None, "c")], "k int, t int, v string")
    assert rows(latest_per_key(df, ["k"], ["t"])) == [(1, 2, "b"), (2, None, "c")]


def test_top_rows_and_shuffled(spark):
    df = spark.range(100)
    assert [r[0] for r in top_rows(df, [F.desc("id")], 3).collect()] == [99, 98, 97]
    assert [r[0] for r in shuffled(df, 1).collect()] == [r[0] for r in shuffled(df, 1).collect()]


def test_exact_quantiles_and_describe(spark):
    draw = random.Random(3)
    values = [draw.randrange(0, 50) for _ in range(1000)]
    df = spark.createDataFrame([(v, float(v * 2)) for v in values], "a int, b double")
    ordered = sorted(values)
    wanted = [float(ordered[int(p * 1000) - 1]) for p in (0.25, 0.5, 0.75)]
    found = {r["column_name"]: r["quantiles"] for r in exact_quantiles(df, ["a", "b"], [0.25, 0.5, 0.75]).collect()}
    assert found["a"] == wanted and found["b"] == [2 * v for v in wanted]
    exact = {r["column_name"]: r for r in describe_numeric(df, ["a", "b"], exact=True).collect()}
    near = {r["column_name"]: r for r in describe_numeric(df, ["a", "b"]).collect()}
    assert exact["a"]["q50"] == wanted[1] and exact["a"]["count"] == 1000
    assert near["a"]["q50"] == wanted[1] and near["b"]["max"] == 2.0 * ordered[-1]


def test_describe_of_an_all_null_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "a double")
    found = describe_numeric(df, ["a"], exact=True).first()
    assert found["count"] == 0 and found["q50"] is None


def test_bucket_statistics_on_the_hour_border(spark):
    data = [("t", 3599, 1.0, 1.0), ("t", 3600, 3.0, 1.0), ("t", 7199, 5.0, 3.0)]
    df = spark.createDataFrame(data, "turbine_id string, ts long, energy double, sensor_A double")
    assert sensor_columns(df) == ["sensor_A"]
    found = bucket_statistics(df, "turbine_id", F.timestamp_seconds("ts"), "energy")
    assert rows(found, "avg_energy", "std_sensor_A") == [(1.0, 0.0), (4.0, 1.0)]
    assert found.orderBy("hourly_timestamp").collect()[1]["percentiles_sensor_A"] == [1.0, 1.0, 3.0, 3.0, 3.0]


def test_named_aggregates_and_first_by(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "k string, n int, v string")
    assert rows(named_aggregates(df, ["k"], {"n": "sum", "*": "count"})) == [("a", 3, 2)]
    assert df.agg(first_by("v", "n").alias("v")).first()["v"] == "x"


def test_relational_helpers(spark):
    df = spark.createDataFrame([(1, "5"), (2, "abc"), (3, None)], "id int, v string")
    assert rows(castable(df, "v", "int"), "id") == [(1,)]
    assert drop_columns(df, "v", "missing").columns == ["id"]
    assert union_many([df, df, df]).count() == 9
    merged = merge_shapes(df.drop("v"), df)
    assert merged.filter("v IS NULL").count() == 4


def test_hash_sample_is_repeatable_and_near_its_share(spark):
    df = spark.range(20_000)
    first = rows(hash_sample(df, "id", 20))
    assert first == rows(hash_sample(df.repartition(5), "id", 20))
    assert 3600 < len(first) < 4400
