from __future__ import annotations

import bz2
import glob
import gzip
import json
import os
import shutil
import time

import pyarrow.parquet as pq
import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T
from test_changes import DELETE, SCHEMA, expected_history, expected_state, feed_of, key

from lakepipe import session
from lakepipe.operators.changes import apply_changes_scd2
from lakepipe.operators.expectations import RuleSet, expect, expect_or_drop, expect_or_fail
from lakepipe.operators.joins import enrich
from lakepipe.sinks import tables
from lakepipe.sources import files
from lakepipe.streaming import changes, ingest, quality, sinks, statistics


def write_lines(folder, name: str, lines: list) -> None:
    os.makedirs(folder, exist_ok=True)
    text = "\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines)
    (folder / name).write_text(text + "\n")


@pytest.fixture
def landing(tmp_path):
    folder = tmp_path / "landing"
    write_lines(folder, "a.json", [{"id": 1, "v": 1.5}, {"id": 2, "v": 2.5}])
    write_lines(folder, "b.json", [{"id": 3, "v": 3.5}])
    return folder


# --- schemas and batch reads ---------------------------------------------------


def test_infer_with_and_without_types(spark, landing):
    typed = files.infer_schema(spark, str(landing), "json")
    assert [f.dataType for f in typed.fields] == [T.LongType(), T.DoubleType()]
    text = files.infer_schema(spark, str(landing), "json", infer_types=False)
    assert {f.dataType for f in text.fields} == {T.StringType()}


def test_hints_replace_and_add(spark, landing):
    schema = files.infer_schema(spark, str(landing), "json", hints="id string, extra int", sample_files=1)
    assert schema.simpleString() == "struct<id:string,v:double,extra:int>"


def test_schema_is_remembered(spark, landing, tmp_path):
    location = str(tmp_path / "schema")
    first = files.remembered_schema(spark, location, lambda: files.infer_schema(spark, str(landing), "json"))
    again = files.remembered_schema(spark, location, lambda: pytest.fail("inferred twice"))
    assert first == again


def test_rescue_keeps_whole_records(spark, tmp_path):
    folder = tmp_path / "bad"
    write_lines(folder, "x.json", [{"id": 1}, {"id": "abc"}, "no json"])
    found = files.read_files(spark, str(folder), "json", "id int", rescue="record").cache()
    assert found.count() == 3
    assert found.filter("_rescued_data IS NULL").count() == 1
    assert found.filter("_rescued_data LIKE '%no json%'").count() == 1


def test_rescue_of_single_fields(spark):
    lines = ['{"id": 1, "v": 2.5}', '{"id": "abc", "v": 1.0}', '{"id": 3, "new": {"x": 1}}', "no json", '{"id": null}']
    df = spark.createDataFrame(list(enumerate(lines)), "n int, value string")
    found = files.rescue_fields(df, "id int, v double", keep=["n"]).orderBy("n").collect()
    result = [(r["id"], r["v"], r["_rescued_data"]) for r in found]
    assert result[0] == (1, 2.5, None)
    assert result[1] == (None, 1.0, '{"id":"abc"}')
    assert result[2][0] == 3 and json.loads(result[2][2]) == {"new": '{"x":1}'}
    assert result[3] == (None, None, "no json")
    assert result[4] == (None, None, None)


def test_rescue_inside_nested_fields(spark):
    lines = [
        '{"id": 1, "a": {"b": 2, "c": "x"}, "l": [{"n": 1}, {"n": null}]}',
        '{"id": 2, "a": {"b": "bad", "c": "x"}}',
        '{"id": 3, "a": {"b": 2, "new": true}}',
        '{"id": 4, "l": [{"n": 1}, {"n": "bad"}]}',
        '{"id": 5, "l": [{"n": 1, "m": 2}], "a": null}',
        '{"id": 6, "l": "no list", "a": {}}',
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    schema = "id int, a struct<b: int, c: string>, l array<struct<n: int>>"
    found = {r["id"]: r["_rescued_data"] for r in files.rescue_fields(df, schema).collect()}
    kept = {i: sorted(json.loads(text)) if text else None for i, text in found.items()}
    assert kept == {1: None, 2: ["a"], 3: ["a"], 4: ["l"], 5: ["l"], 6: ["l"]}


def test_delimited_table(spark):
    df = spark.createDataFrame([(" a , 1,x",), ("b,n/a,",)], "value string")
    assert rows(files.delimited_table(df, "k string, n int, t string")) == [("a", 1, "x"), ("b", None, None)]


def test_folders_paths_and_multi_line(spark, tmp_path, landing):
    write_lines(tmp_path / "zone" / "customers", "x.json", [{"id": 1}])
    write_lines(tmp_path / "zone" / "orders", "x.json", [{"id": 1}])
    assert files.list_folders(spark, str(tmp_path / "zone")) == ["customers", "orders"]
    assert len(files.list_files(spark, str(landing))) == 2
    assert files.table_on_path(spark, "json", str(landing), "id").count() == 3
    (tmp_path / "doc.json").write_text('[{"a": {"b": 1}},\n {"a": {"b": 2}}]')
    read = files.read_files(spark, str(tmp_path / "doc.json"), "json", multi_line=True)
    assert rows(read.select("a.b")) == [(1,), (2,)]
    assert files.preview(spark.range(50)).count() == 10


# --- batch sinks -----------------------------------------------------------------


@pytest.mark.parametrize("fmt", ["json", "csv", "parquet"])
def test_write_files_count_and_append(spark, tmp_path, fmt):
    df = spark.range(100).withColumn("s", F.col("id").cast("string"))
    path = str(tmp_path / fmt)
    tables.write_files(df, path, fmt, files=3)
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) == 3
    tables.write_files(df, path, fmt, mode="append")
    assert files.read_files(spark, path, fmt, df.schema).count() == 200


def test_tables(spark):
    tables.create_table(spark, "power", "hour int, low float")
    tables.insert_rows(spark, "power", "(1, 2.5), (2, 3.5)")
    assert spark.table("power").count() == 2
    tables.overwrite_table(spark.range(3).withColumn("x", F.lit("new")), "power")
    assert spark.table("power").columns == ["id", "x"]
    tables.append_table(spark.range(1).withColumn("x", F.lit("more")), "power")
    assert spark.table("power").count() == 4
    spark.sql("DROP TABLE power")


def test_clustered_layout(spark, tmp_path):
    # a third of the rows share one value
    df = spark.range(6000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")))
    path = str(tmp_path / "clustered")
    tables.write_clustered(df, path, ["k"], files=6)
    sizes = [r["count"] for r in spark.read.parquet(path).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) == 6 and max(sizes) < 2000
    assert spark.read.parquet(path).agg(F.sum("id")).first()[0] == sum(range(6000))
    with pytest.raises(ValueError, match="gone"):
        tables.clustered(df, ["gone"])


def footers(path, column):
    """(least, greatest) value of a column in each file, from its statistics."""
    found = []
    for file in sorted(glob.glob(f"{path}/*.parquet")):
        groups = pq.ParquetFile(file).metadata
        at = groups.schema.to_arrow_schema().names.index(column)
        stats = [groups.row_group(i).column(at).statistics for i in range(groups.num_row_groups)]
        found.append((min(s.min for s in stats), max(s.max for s in stats)))
    return found


@pytest.mark.parametrize("interleave", [False, True])
def test_file_count_follows_rows_not_compressed_files(spark, tmp_path, interleave):
    constant = spark.range(0, 30_000, 1, 4).select(
        F.lit(7).alias("a"), F.lit(3.5).alias("b"), F.repeat(F.lit("x"), 60).alias("t"), F.array(F.lit("yy")).alias("n")
    )
    constant.write.parquet(str(tmp_path / "constant"))
    stored = spark.read.parquet(str(tmp_path / "constant"))
    size = 30_000 * (8 + 4 * 8 + 60 + 4)
    assert tables.file_count(stored, size // 10) in (10, 11) and tables.file_count(stored.limit(0)) == 1
    varied = stored.withColumn("k", F.monotonically_increasing_id())
    tables.write_clustered(varied, str(tmp_path / "out"), ["a", "k"], tables.file_count(varied, 500_000), interleave=interleave)
    rows_ = spark.read.parquet(str(tmp_path / "out")).groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in rows_) == 30_000 and max(r["count"] for r in rows_) < 10_000


def test_interleaved_layout_skips_files_on_every_column(spark, tmp_path):
    df = spark.range(40_000).select(
        "id",
        F.pmod(F.xxhash64("id"), F.lit(1000)).alias("a"),
        F.format_string("%05d", F.pmod(F.xxhash64(F.col("id") + 1), F.lit(5000))).alias("b"),
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.pmod(F.xxhash64(F.col("id") + 2), F.lit(1000)).cast("double")).alias("c"),
    )
    paths = {way: str(tmp_path / way) for way in ("sorted", "interleaved", "three")}
    tables.write_clustered(df, paths["sorted"], ["a", "b"], files=16)
    tables.write_clustered(df, paths["interleaved"], ["a", "b"], files=16, interleave=True)
    tables.write_clustered(df, paths["three"], ["a", "b", "c"], files=16, interleave=True)

    def share_read(way, column, values):
        files_ = footers(paths[way], column)
        return sum(low <= v <= high for low, high in files_ for v in values) / len(files_) / len(values)

    a, b = list(range(25, 1000, 50)), [f"{v:05d}" for v in range(125, 5000, 250)]
    assert share_read("sorted", "a", a) < 0.15 and share_read("sorted", "b", b) == 1
    assert share_read("interleaved", "a", a) < 0.5 and share_read("interleaved", "b", b) < 0.5
    for column, values in (("a", a), ("b", b), ("c", [float(v) for v in a])):
        assert share_read("three", column, values) < 0.85
    for path in paths.values():
        stored = spark.read.parquet(path)
        assert rows(stored.select("id")) == [(i,) for i in range(40_000)]
        sizes = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
        assert len(sizes) == 16 and max(sizes) < 2 * 40_000 / 16
    assert tables.clustered(df.limit(0), ["a", "b"], interleave=True).count() == 0
    nulls = df.limit(100).withColumn("a", F.lit(None).cast("int"))
    assert tables.clustered(nulls, ["a", "b"], 2, interleave=True).count() == 100


@pytest.mark.parametrize("levels", [[], ["p"]])
def test_delete_touches_only_files_with_hits(spark, tmp_path, levels):
    path = str(tmp_path / "a table")
    df = spark.range(1000).select("id", (F.col("id") % 2).cast("int").alias("p"), F.when(F.col("id") > 5, F.col("id")).alias("v"))
    df.repartitionByRange(8, "id").write.partitionBy(*levels).parquet(path)

    def state():
        return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}

    before = state()
    assert tables.delete_rows(spark, path, "v BETWEEN 10 AND 20") == 1 + len(levels)
    after = state()
    assert len(before.items() - after.items()) == 1 + len(levels) == len(after.items() - before.items())
    expected = [(i,) for i in range(1000) if not 10 <= i <= 20]
    assert rows(spark.read.parquet(path), "id") == expected and spark.read.parquet(path).columns == (df.columns if not levels else ["id", "v", "p"])
    # no hit: nothing is written; whole files: they go
    assert tables.delete_rows(spark, path, "v < 0") == 0 and state() == after
    tables.delete_rows(spark, path, F.col("id") < 700)
    assert rows(spark.read.parquet(path), "id") == [(i,) for i in range(700, 1000)]
    with pytest.raises(ValueError, match="rewrite"):
        tables.delete_rows(spark, path, "id >= 700", max_files=1)


def test_a_delete_that_was_cut_short_is_finished(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    spark.range(100).repartitionByRange(4, "id").write.parquet(path)
    with monkeypatch.context() as m:
        m.setattr(tables, "finish_delete", lambda *_: None)
        tables.delete_rows(spark, path, "id < 10")
    assert spark.read.parquet(path).count() == 100
    os.makedirs(f"{path}/_delete-without-mark/rows")
    tables.finish_delete(spark, path)
    assert rows(spark.read.parquet(path), "id") == [(i,) for i in range(10, 100)]
    assert not glob.glob(f"{path}/_delete-*")


def test_compact_delete_and_evolve(spark, tmp_path):
    many, few, kept = (str(tmp_path / n) for n in ("many", "few", "kept"))
    tables.write_files(spark.range(100), many, files=20)
    assert tables.compact(spark, many, few, rows_per_file=50) == 2
    assert spark.read.parquet(few).count() == 100
    tables.rewrite_without(spark, few, kept, "id < 40")
    assert spark.read.parquet(kept).count() == 60
    tables.write_files(spark.range(1).withColumn("extra", F.lit(1)), kept, mode="append")
    assert tables.read_evolved(spark, kept).filter("extra IS NULL").count() == 60


def test_shared_root_needs_a_setting_on_a_cluster(spark, monkeypatch):
    assert session.shared_root(spark) == spark.conf.get("spark.checkpoint.dir")
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")

    class Unset:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "yarn", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_root(Unset)


# --- streams ---------------------------------------------------------------------


def test_ingest_is_exactly_once_over_restarts(spark, landing, tmp_path):
    target, state = str(tmp_path / "raw"), str(tmp_path / "state")

    def run():
        sinks.drain(ingest.ingest_folder(spark, str(landing), "json", target, state))
        return spark.read.parquet(target).count()

    assert run() == 3
    assert run() == 3
    write_lines(landing, "c.json", [{"id": 4, "v": 1.0}, "broken"])
    assert run() == 5
    assert spark.read.parquet(target).filter("_rescued_data IS NOT NULL").count() == 1


def test_ingest_several_folders(spark, tmp_path):
    write_lines(tmp_path / "in" / "users", "a.json", [{"id": 1}])
    write_lines(tmp_path / "in" / "visits", "a.csv", ["id,page", "1,home", "2,shop"])
    made = ingest.ingest_folders(
        spark, {"users": "json", "visits": "csv"}, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    )
    assert spark.read.parquet(made["users"]).count() == 1
    assert rows(spark.read.parquet(made["visits"]), "id", "page") == [(1, "home"), (2, "shop")]


def test_multi_line_stream_with_fixed_schema(spark, tmp_path):
    folder = tmp_path / "docs"
    write_lines(folder, "a.json", ['{"a":', ' {"b": 7}}'])
    schema = files.infer_schema(spark, str(folder / "a.json"), "json", options={"multiLine": "true"})
    stream = files.stream_files(spark, str(folder), "json", schema, multi_line=True)
    stamped = stream.select("a.*", F.current_timestamp().alias("processing_time"))
    sinks.drain(sinks.append_stream(stamped, str(tmp_path / "out"), str(tmp_path / "cp")))
    found = spark.read.parquet(str(tmp_path / "out")).first()
    assert found["b"] == 7 and found["processing_time"] is not None


def test_interval_trigger_and_table_sink(spark, landing, tmp_path):
    stream = files.stream_files(spark, str(landing), "json", "id int")
    query = sinks.append_stream(stream, str(tmp_path / "t"), str(tmp_path / "cp"), every="6 hours")
    # the first batch runs at once, the next one would come six hours later
    for _ in range(300):
        if query.lastProgress:
            break
        time.sleep(0.1)
    query.stop()
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3
    sinks.drain(sinks.append_stream_to_table(stream, "streamed", str(tmp_path / "cp2")))
    assert spark.table("streamed").count() == 3
    upstream = spark.readStream.table("streamed")
    sinks.drain(sinks.append_stream(upstream, str(tmp_path / "u"), str(tmp_path / "cp3")))
    assert spark.read.parquet(str(tmp_path / "u")).count() == 3
    spark.sql("DROP TABLE streamed")


def change_files(folder, feed, parts):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for i in range(parts):
        lines = [dict(zip(names, r)) for r in feed[i::parts]]
        write_lines(folder, f"part{i}.json", lines)


@pytest.mark.parametrize("parts", [1, 4])
def test_streamed_changes_equal_brute_force(spark, tmp_path, parts):
    feed = feed_of(20 + parts)
    change_files(tmp_path / "in", feed, parts)
    stream = files.stream_files(spark, str(tmp_path / "in"), "json", SCHEMA, max_files_per_trigger=1)
    target = str(tmp_path / "scd1")
    sinks.drain(changes.start_scd1(stream, target, str(tmp_path / "cp1"), "id", "seq", DELETE))
    assert sinks.read_batches(spark, f"{target}/changes").select("batch_id").distinct().count() == parts
    wanted = sorted(expected_state(feed), key=key)

    def state():
        found = changes.read_scd1(spark, target, "id", "seq", ["op"])
        return sorted((tuple(r) for r in found.select("id", "seq", "name", "city").collect()), key=key)

    assert state() == wanted
    assert changes.fold_changes(spark, target, "id", "seq") == parts - 1
    assert state() == wanted

    target = str(tmp_path / "scd2")
    sinks.drain(changes.start_scd2(stream, target, str(tmp_path / "cp2"), "id"))
    found = changes.read_scd2(spark, target, "id", "seq", apply_as_deletes=DELETE, except_columns=["op", "seq"])
    got = sorted((tuple(r) for r in found.select("id", "name", "city", "start_at", "end_at").collect()), key=key)
    assert got == sorted(expected_history(feed), key=key)


def test_late_changes_after_folding(spark, tmp_path):
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def arrive(n, *changes_):
        write_lines(tmp_path / "in", f"{n}.json", [dict(zip(names, c)) for c in changes_])
        stream = files.stream_files(spark, str(tmp_path / "in"), "json", SCHEMA)
        sinks.drain(changes.start_scd1(stream, str(tmp_path / "t"), str(tmp_path / "cp"), "id", "seq", DELETE))

    def state():
        return rows(changes.read_scd1(spark, str(tmp_path / "t"), "id", "seq"), "id", "name")

    arrive(1, (1, "APPEND", 1, "a", "p"), (2, "APPEND", 1, "b", "p"))
    arrive(2, (1, "DELETE", 5, None, None))
    changes.fold_changes(spark, str(tmp_path / "t"), "id", "seq")
    arrive(3, (1, "UPDATE", 3, "late", "p"), (2, "UPDATE", 2, "B", "p"))
    assert state() == [(2, "B")]
    arrive(4, (1, "APPEND", 9, "back", "p"))
    assert state() == [(1, "back"), (2, "B")]


def test_replayed_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.write_batch(spark.range(5), path, 0)
    sinks.write_batch(spark.range(5), path, 0)
    sinks.write_batch(spark.range(2), path, 1)
    assert sinks.read_batches(spark, path).count() == 7


RULES = RuleSet("feed", [expect("high", "v > 2"), expect_or_drop("odd", "id % 2 = 1")])


def test_stream_rules_equal_batch_rules(spark, landing, tmp_path):
    stream = files.stream_files(spark, str(landing), "json", "id int, v double", max_files_per_trigger=1)
    target = str(tmp_path / "t")
    sinks.drain(quality.start_checked(stream, RULES, target, str(tmp_path / "cp")))
    batch = files.read_files(spark, str(landing), "json", "id int, v double")
    assert rows(quality.read_clean(spark, target)) == rows(RULES.apply(batch))
    columns = ["name", "passed_records", "failed_records", "dropped_records", "output_records"]
    assert rows(quality.read_metrics(spark, target), *columns) == rows(RULES.metrics(batch), *columns)


def test_stream_fail_rule_does_not_advance(spark, landing, tmp_path):
    target, checkpoint = str(tmp_path / "t"), str(tmp_path / "cp")
    strict = RuleSet("feed", [expect_or_fail("small", "id < 3")])
    stream = files.stream_files(spark, str(landing), "json", "id int, v double")
    with pytest.raises(Exception, match="small"):
        sinks.drain(quality.start_checked(stream, strict, target, checkpoint))
    # the same rows arrive again once the rule is relaxed
    sinks.drain(quality.start_checked(stream, RuleSet("feed", []), target, checkpoint))
    assert quality.read_clean(spark, target).count() == 3


def test_stream_static_join(spark, landing, tmp_path):
    lookup = spark.createDataFrame([(1, "one"), (3, "three")], "key int, label string")
    stream = files.stream_files(spark, str(landing), "json", "id int")
    joined = enrich(stream, lookup, {"id": "key"}, {"label": "label"}, how="left")
    sinks.drain(sinks.append_stream(joined, str(tmp_path / "t"), str(tmp_path / "cp")))
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == [(1, "one"), (2, None), (3, "three")]


def test_hourly_stream_updates_windows_and_drops_late_rows(spark, tmp_path):
    folder, target, checkpoint = tmp_path / "in", str(tmp_path / "t"), str(tmp_path / "cp")

    def arrive(n, *readings):
        write_lines(folder, f"{n}.json", [{"k": "a", "at": at, "v": v} for at, v in readings])
        stream = files.stream_files(spark, str(folder), "json", "k string, at long, v double")
        stats = statistics.windowed_statistics(stream, "k", F.timestamp_seconds("at"), "v", ["v"])
        sinks.drain(statistics.start_windowed(stats, target, checkpoint))
        return rows(statistics.read_windowed(spark, target, "k"), "readings", "avg_v")

    hour = 3600
    assert arrive(1, (0, 1.0), (10 * hour, 5.0)) == [(1, 1.0), (1, 5.0)]
    # within three hours of the newest reading: the window is updated
    assert arrive(2, (10 * hour + 1, 7.0)) == [(1, 1.0), (2, 6.0)]
    # ten hours late: ignored
    assert arrive(3, (1, 100.0)) == [(1, 1.0), (2, 6.0)]


@pytest.mark.parametrize("logged", [False, True])
def test_stored_versions_grow_by_what_changes(spark, tmp_path, logged):
    names, folder, target = [c.split()[0] for c in SCHEMA.split(", ")], tmp_path / "in", str(tmp_path / "t")
    options = {"apply_as_deletes": DELETE, "except_columns": ["op", "seq"], "tie_breaker": "name"}
    seen = []

    def arrive(n, feed):
        seen.extend(feed)
        write_lines(folder, f"{n}.json", [dict(zip(names, c)) for c in feed])
        stream = files.stream_files(spark, str(folder), "json", SCHEMA)
        cp = str(tmp_path / "cp")
        if logged:
            sinks.drain(changes.start_scd2(stream, target, cp, "id", buckets=4))
            assert changes.refresh_scd2(spark, target, "id", "seq", **options) == n
            assert changes.refresh_scd2(spark, target, "id", "seq", **options) == n
        else:
            sinks.drain(changes.start_scd2_stored(stream, target, cp, "id", "seq", **options, buckets=4))
        stored = changes.read_versions(spark, target)
        derived = apply_changes_scd2(spark.createDataFrame(seen, SCHEMA), "id", "seq", **options)
        assert rows(stored, *derived.columns) == rows(derived)
        return rows(sinks.read_batches(spark, f"{target}/versions").filter(F.col("batch_id") == n), "id", "seq")

    feed = feed_of(40)
    assert len(arrive(0, feed[::2])) == len(feed[::2])
    assert len(feed[1::2]) <= len(arrive(1, feed[1::2])) < len(feed)
    # one key only: its new entry, and the one whose end moves
    newest = max(c[2] for c in feed if c[0] == 3)
    assert arrive(2, [(3, "UPDATE", 5000, "n", "p")]) == [(3, newest), (3, 5000)]
    assert changes.fold_versions(spark, target) == 2
    # late: splits one version; known already: nothing; a greater tie breaker: one entry
    assert arrive(3, [(3, "UPDATE", 4000, "l", "p")]) == [(3, newest), (3, 4000)]
    assert arrive(4, [(3, "UPDATE", 4000, "l", "p"), (3, "UPDATE", 4000, "k", "p")]) == []
    assert arrive(5, [(3, "DELETE", 4000, "z", "p"), (9, "APPEND", 1, None, "q")]) == [(3, 4000), (9, 1)]
    with pytest.raises(ValueError, match="was begun with"):
        changes.refresh_scd2(spark, target, "id", "name", **options)


def test_a_cut_short_batch_is_not_read(spark, tmp_path):
    target = str(tmp_path / "t")
    feed = spark.createDataFrame([(1, "UPDATE", 1, "a", "p"), (2, "UPDATE", 1, "a", "p")], SCHEMA)
    sinks.write_batch(feed.withColumn("__bucket", F.col("id") % 2), f"{target}/changes", 0, ["__bucket"])
    changes.refresh_scd2(spark, target, "id", "seq", DELETE, tie_breaker="name")
    half = f"{target}/versions/batch_id=1/__bucket=0"
    shutil.copytree(glob.glob(f"{target}/versions/batch_id=0/__bucket=*")[0], half)
    assert changes.read_versions(spark, target).count() == 2
    # a delete at the same sequence wins the tie, and all versions of its bucket are gone
    late = spark.createDataFrame([(1, "DELETE", 1, "z", "p", 1)], SCHEMA + ", __bucket int")
    sinks.write_batch(late, f"{target}/changes", 1, ["__bucket"])
    changes.refresh_scd2(spark, target, "id", "seq", DELETE, tie_breaker="name")
    assert rows(changes.read_versions(spark, target), "id") == [(2,)]


def test_new_fields_are_rescued_then_added(spark, landing, tmp_path):
    target, state = str(tmp_path / "raw"), str(tmp_path / "state")

    def run(**options):
        sinks.drain(ingest.ingest_folder(spark, str(landing), "json", target, state, **options))
        return tables.read_evolved(spark, target)

    assert "color" not in run().columns
    write_lines(landing, "d.json", [{"id": 8, "v": 1.0, "color": "red"}])
    assert rows(run().filter("id = 8"), "_rescued_data") == [('{"color":"red"}',)]
    write_lines(landing, "e.json", [{"id": 9, "v": 1.0, "color": "blue"}])
    found = run(evolve=True)
    assert rows(found.filter("color IS NOT NULL"), "id", "color", "_rescued_data") == [(9, "blue", None)]
    assert found.count() == 5


def test_rescue_arguments_are_checked(spark, landing):
    with pytest.raises(ValueError, match="JSON lines"):
        files.read_files(spark, str(landing), "json", "id int", multi_line=True, rescue="fields")
    with pytest.raises(ValueError, match="unknown"):
        files.read_files(spark, str(landing), "json", "id int", rescue="all")


def test_one_flow_per_folder(spark, tmp_path):
    for name, n in {"customers": 1, "transactions": 2}.items():
        change_files(tmp_path / "zone" / name, feed_of(n), 2)
    raw = ingest.ingest_all(spark, str(tmp_path / "zone"), "json", str(tmp_path / "raw"), str(tmp_path / "s1"))
    made = changes.apply_folders(
        spark, raw, lambda df: df.filter("_rescued_data IS NULL"), str(tmp_path / "t"), str(tmp_path / "s2"), "id", "seq", DELETE
    )
    for name, n in {"customers": 1, "transactions": 2}.items():
        state = changes.read_scd1(spark, made[name], "id", "seq")
        found = sorted((tuple(r) for r in state.select("id", "seq", "name", "city").collect()), key=key)
        assert found == sorted(expected_state(feed_of(n)), key=key)


def test_unfinished_batch_is_not_read(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.write_batch(spark.range(5), path, 0)
    sinks.write_batch(spark.range(5), path, 1)
    os.remove(f"{path}/batch_id=1/_SUCCESS")
    assert sinks.last_batch(spark, path) == 0
    assert sinks.read_batches(spark, path).count() == 5


def test_cluster_settings_are_known_to_spark(spark):
    for name in session.CLUSTER_CONF:
        spark.conf.get(name)


def test_csv_headers_of_compressed_encoded_and_quoted_files(spark, tmp_path):
    folder = tmp_path / "csv"
    os.makedirs(folder)
    (folder / "a.csv.gz").write_bytes(gzip.compress(b"x,y\n1,2\n3,4\n"))
    (folder / "b.csv.bz2").write_bytes(bz2.compress(b"y,x\n20,10\n"))
    (folder / "c d%20e.csv").write_text('"extra\nover, lines",x,y\nlost,100,200\nand,300,400\n')
    (folder / "empty.csv").write_text("")
    (folder / "only header.csv").write_text("y,x\n")
    for rescue in ("fields", None):
        found = files.read_files(spark, str(folder), "csv", "x int, y int", rescue=rescue)
        assert rows(found, "x", "y") == [(1, 2), (3, 4), (10, 20), (100, 200), (300, 400)]
    lost = files.read_files(spark, str(folder), "csv", "x int, y int", rescue="fields").where("x >= 100")
    assert [json.loads(r[0]) for r in rows(lost, "_rescued_data")] == [{"extra\nover, lines": v} for v in ("and", "lost")]
    inferred = files.infer_schema(spark, str(folder), "csv")
    assert {f.name: f.dataType for f in inferred.fields} == {
        "x": T.IntegerType(), "y": T.IntegerType(), "extra\nover, lines": T.StringType(),
    }
    target, state = str(tmp_path / "raw"), str(tmp_path / "state")
    sinks.drain(ingest.ingest_folder(spark, str(folder), "csv", target, state, schema=T.StructType.fromDDL("x int, y int")))
    assert rows(spark.read.parquet(target), "x", "y") == [(1, 2), (3, 4), (10, 20), (100, 200), (300, 400)]


def test_csv_headers_in_another_encoding(spark, tmp_path):
    folder = tmp_path / "wide"
    os.makedirs(folder)
    (folder / "a.csv").write_bytes("größe;y\n1;2\n".encode("iso-8859-1"))
    (folder / "b.csv").write_bytes("y;größe\n4;3\n".encode("iso-8859-1"))
    options = {"encoding": "iso-8859-1", "sep": ";"}
    found = files.read_files(spark, str(folder), "csv", "`größe` int, y int", rescue="fields", options=options)
    assert rows(found) == [(1, 2, None), (3, 4, None)]


def test_headers_of_many_files_are_read_by_tasks(spark, tmp_path):
    folder = tmp_path / "many"
    os.makedirs(folder)
    paths = []
    for i in range(300):
        paths.append(str(folder / f"{i}.csv"))
        (folder / f"{i}.csv").write_text(("x,y" if i % 3 else "y,x") + "\n1,2" * (i % 2) + "\n")
    groups = files.csv_headers(spark, paths)
    assert {names: len(found) for names, found in groups.items()} == {("x", "y"): 200, ("y", "x"): 100}
    assert files.csv_headers(spark, []) == {}


def test_csv_is_bound_by_header(spark, tmp_path):
    folder = tmp_path / "csv"
    write_lines(folder, "a.csv", ["x,y", "1,one"])
    write_lines(folder, "b.csv", ["y,x", "two,2", "three,many"])
    write_lines(folder, "c.csv", ["z,x", "left,4", "too,5,long"])
    found = files.read_files(spark, str(folder), "csv", "x int, y string", rescue="fields")
    assert rows(found.where("x < 5"), "x", "y", "_rescued_data") == [
        (1, "one", None), (2, "two", None), (4, None, '{"z":"left"}')
    ]
    assert rows(found.where("x IS NULL"), "y", "_rescued_data") == [("three", '{"x":"many"}')]
    long = found.where("x = 5").first()["_rescued_data"]
    assert json.loads(long)["_record"] == "too,5,long"
    inferred = files.infer_schema(spark, str(folder), "csv")
    assert set(inferred.names) == {"x", "y", "z"}


def test_foreign_and_former_writers_are_refused(spark, landing, tmp_path):
    def start(target, checkpoint, **options):
        stream = files.stream_files(spark, str(landing), "json", "id int, v double")
        sinks.drain(changes.start_scd2(stream, str(tmp_path / target), str(tmp_path / checkpoint), "id", **options))

    start("t", "one", buckets=4)
    with pytest.raises(ValueError, match="another target"):
        start("u", "one")
    with pytest.raises(ValueError, match="4 buckets"):
        start("t", "two", buckets=7)
    start("t", "two")
    assert changes.read_scd2(spark, str(tmp_path / "t"), "id", "v").where("end_at IS NULL").count() == 3
    with pytest.raises(ValueError, match="later checkpoint"):
        start("t", "one")


def test_arrival_stamp(spark, landing, tmp_path):
    target = str(tmp_path / "raw")
    sinks.drain(ingest.ingest_folder(spark, str(landing), "json", target, str(tmp_path / "s"), stamp="arrived"))
    assert spark.read.parquet(target).where("arrived IS NOT NULL").count() == 3
