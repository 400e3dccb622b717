from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from lakepipe.operators.changes import (
    apply_changes_scd1,
    apply_changes_scd2,
    keep_unless,
    reduce_changes,
    snapshot_diff,
)
from lakepipe.operators import ranges
from lakepipe.operators.ranges import PART, sorted_ranges

SCHEMA = "id int, op string, seq int, name string, city string"
DELETE = "op = 'DELETE'"


def feed_of(seed: int, n: int = 120, keys: int = 6) -> list[tuple]:
    draw = random.Random(seed)
    feed, seqs = [], list(range(n))
    draw.shuffle(seqs)
    for seq in seqs:
        op = draw.choices(["APPEND", "UPDATE", "DELETE"], [4, 5, 2])[0]
        # one key holds about a third of the rows
        key = 0 if draw.random() < 0.33 else draw.randrange(1, keys)
        name = draw.choice(["x", "y", None])
        feed.append((key, op, seq, name, draw.choice(["p", "q", "r"])))
    return feed


def by_key(feed: list[tuple]) -> dict[int, list[tuple]]:
    grouped: dict[int, list[tuple]] = {}
    for row in sorted(feed, key=lambda r: r[2]):
        grouped.setdefault(row[0], []).append(row)
    return grouped


def expected_state(feed):
    last = [changes[-1] for changes in by_key(feed).values()]
    return [(r[0], r[2], r[3], r[4]) for r in last if r[1] != "DELETE"]


def expected_history(feed):
    out = []
    for changes in by_key(feed).values():
        for i, r in enumerate(changes):
            if r[1] != "DELETE":
                end = changes[i + 1][2] if i + 1 < len(changes) else None
                out.append((r[0], r[3], r[4], r[2], end))
    return out


def expected_tracked(feed, tracked: int):
    """Versions on one tracked column (index in the row); the other shows its last value."""
    out = []
    for changes in by_key(feed).values():
        open_version = None
        for r in changes:
            if r[1] == "DELETE":
                if open_version:
                    out.append((*open_version, r[2]))
                open_version = None
            elif open_version and open_version[1 if tracked == 3 else 2] == r[tracked]:
                open_version = (open_version[0], r[3], r[4], open_version[3])
            else:
                if open_version:
                    out.append((*open_version, r[2]))
                open_version = (r[0], r[3], r[4], r[2])
        if open_version:
            out.append((*open_version, None))
    return out


def key(t):
    return tuple((v is not None, str(v)) for v in t)


def frame(spark, feed):
    return spark.createDataFrame(feed, SCHEMA)


def history(df, **options):
    found = apply_changes_scd2(df, "id", "seq", DELETE, ["op", "seq"], **options)
    return sorted((tuple(r) for r in found.select("id", "name", "city", "start_at", "end_at").collect()), key=key)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_scd1_and_scd2_against_brute_force(spark, seed):
    feed = feed_of(seed)
    df = frame(spark, feed)
    state = apply_changes_scd1(df, "id", "seq", DELETE, ["op"])
    found = [(r["id"], r["seq"], r["name"], r["city"]) for r in state.collect()]
    assert sorted(found, key=key) == sorted(expected_state(feed), key=key)
    assert history(df) == sorted(expected_history(feed), key=key)


@pytest.mark.parametrize("seed", [4, 5])
@pytest.mark.parametrize("column,place", [("city", 4), ("name", 3)])
def test_tracked_history_against_brute_force(spark, seed, column, place):
    feed = feed_of(seed)
    assert history(frame(spark, feed), track_history_on=[column]) == sorted(
        expected_tracked(feed, place), key=key
    )


def test_track_except_is_the_complement(spark):
    df = frame(spark, feed_of(6))
    assert history(df, track_history_except=["name"]) == history(df, track_history_on=["city"])


@pytest.mark.parametrize("options", [{}, {"track_history_on": ["city"]}])
@pytest.mark.parametrize("count", [2, 64])
def test_ranges_give_the_same_history(spark, options, count):
    feed = feed_of(7, n=300)
    # repeated changes and several changes of one sequence value
    feed += feed[:40] + [(r[0], r[1], r[2], "tied", r[4]) for r in feed[50:60]]
    df = frame(spark, feed)
    for tie in (None, "name"):
        assert history(df, ranges=count, tie_breaker=tie, **options) == history(df, ranges=None, tie_breaker=tie, **options)


def text_feed(spark, n):
    """A third of the changes on one key, ISO text that agrees in its first 19 characters as sequence."""
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.pmod(F.xxhash64("id"), F.lit(500)) + 1).cast("int").alias("id"),
        F.lit("UPDATE").alias("op"),
        F.format_string("2024-01-01T00:00:00.%09d", "id").alias("seq"),
        F.col("id").cast("string").alias("name"),
        F.lit("p").alias("city"),
    )


def test_no_range_of_a_hot_key_holds_more_than_its_share(spark):
    n, count = 60_000, 24
    feed = text_feed(spark, n)
    parts = sorted_ranges(feed, ["id", "seq"], count)
    sizes = [r["count"] for r in parts.groupBy(PART, "id").count().where("id = 0").collect()]
    assert sum(sizes) == n // 3 and max(sizes) < 2 * n / count
    widest = max(r["count"] for r in parts.groupBy(PART).count().collect())
    assert widest < 2 * n / count
    ends = apply_changes_scd2(feed, "id", "seq", except_columns=["op", "seq"], ranges=count).where("id = 0")
    found = {r["name"]: r["end_at"] for r in ends.select("name", "end_at").collect()}
    expected = [f"2024-01-01T00:00:00.{i:09d}" for i in range(3, n, 3)]
    assert [found[str(i)] for i in range(0, n, 3)] == [*expected, None]


@pytest.mark.parametrize("options", [{}, {"track_history_on": ["city"]}])
def test_ranges_are_cut_where_a_key_is_too_large_for_a_task(spark, monkeypatch, options):
    df = frame(spark, feed_of(8, n=300))
    cut = []
    plain = ranges.sorted_ranges
    monkeypatch.setattr(ranges, "sorted_ranges", lambda *a: cut.append(a[-1]) or plain(*a))
    wanted = history(df, **options)
    assert not cut
    # one key has some hundred changes, the others sixty at most
    monkeypatch.setattr(ranges, "MAX_ROWS_PER_KEY", 80)
    assert history(df, **options) == wanted
    assert cut and set(cut) == {ranges.default_ranges(spark)}


def test_current_versions_equal_scd1(spark):
    df = frame(spark, feed_of(9))
    current = apply_changes_scd2(df, "id", "seq", DELETE, ["op"]).filter("end_at IS NULL")
    state = apply_changes_scd1(df, "id", "seq", DELETE, ["op"])
    assert rows(current, "id", "seq", "name", "city") == rows(state, "id", "seq", "name", "city")


def test_versions_of_a_key_do_not_overlap(spark):
    previous: dict[int, int | None] = {}
    for r in sorted(history(frame(spark, feed_of(10))), key=lambda r: (r[0], r[3])):
        if r[0] in previous:
            assert previous[r[0]] is not None and previous[r[0]] <= r[3]
        previous[r[0]] = r[4]


@pytest.mark.parametrize("seed", [11, 12])
def test_reduction_does_not_depend_on_batches(spark, seed):
    feed = feed_of(seed)
    whole = reduce_changes(frame(spark, feed), "id", "seq", DELETE)
    parts = [reduce_changes(frame(spark, feed[i::3]), "id", "seq", DELETE) for i in range(3)]
    merged = reduce_changes(parts[2].unionByName(parts[0]).unionByName(parts[1]), "id", "seq")
    assert rows(merged) == rows(whole)


def test_late_update_does_not_revive_a_deleted_key(spark):
    feed = [(1, "APPEND", 1, "a", "p"), (1, "DELETE", 5, None, None), (1, "UPDATE", 3, "late", "p")]
    assert apply_changes_scd1(frame(spark, feed), "id", "seq", DELETE).count() == 0
    assert [r[3:] for r in history(frame(spark, feed))] == [(1, 3), (3, 5)]


def test_sequence_ties_are_resolved_repeatably(spark):
    feed = [(1, "UPDATE", 1, "a", "p"), (1, "UPDATE", 1, "b", "p"), (1, "UPDATE", 2, "c", "p")]
    first = history(frame(spark, feed))
    assert len(first) == 2 and history(frame(spark, feed[::-1])) == first
    assert [r[1] for r in history(frame(spark, feed), tie_breaker="name")] == ["b", "c"]


def test_ignore_null_updates(spark):
    feed = [
        (1, "APPEND", 1, "a", "p"),
        (1, "UPDATE", 2, None, "q"),
        (2, "APPEND", 1, "a", "p"),
        (2, "DELETE", 2, None, None),
        (2, "APPEND", 3, None, "r"),
        (3, "DELETE", 9, None, None),
        (3, "APPEND", 1, "z", "z"),
    ]
    found = apply_changes_scd1(frame(spark, feed), "id", "seq", DELETE, ["op"], ignore_null_updates=True)
    assert rows(found, "id", "name", "city") == [(1, "a", "q"), (2, None, "r")]


def test_empty_feed(spark):
    empty = frame(spark, [])
    assert apply_changes_scd1(empty, "id", "seq", DELETE).count() == 0
    assert apply_changes_scd2(empty, "id", "seq", DELETE).count() == 0


def test_composite_keys_and_sequences(spark):
    data = [(1, "a", 1, 1, "x"), (1, "a", 1, 2, "y"), (1, "b", 1, 1, "z")]
    df = spark.createDataFrame(data, "k1 int, k2 string, s1 int, s2 int, v string")
    state = apply_changes_scd1(df, ["k1", "k2"], ["s1", "s2"])
    assert rows(state, "k2", "v") == [("a", "y"), ("b", "z")]


def test_snapshot_diff(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "d")], "id int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (3, None), (5, "e")], "id int, v string")
    assert rows(snapshot_diff(old, new, "id")) == [(2, "B", "update"), (4, "d", "delete"), (5, "e", "insert")]
    assert snapshot_diff(old, old, "id").count() == 0


def test_keep_unless_keeps_unknown(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "v int")
    assert rows(keep_unless(df, "v > 3")) == [(None,), (1,)]
