from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import Observation

from lakepipe.operators.expectations import (
    ExpectationFailed,
    Rule,
    RuleSet,
    expect,
    expect_all,
    expect_or_drop,
    expect_or_fail,
    roll_up,
)


@pytest.fixture(scope="module")
def txs(spark):
    data = [(1, 10, 5, "a"), (2, -3, 5, "a"), (3, 10, 0, "b"), (4, None, 5, "b"), (5, 7, 7, None)]
    return spark.createDataFrame(data, "id int, balance int, arrears int, center string")


RULES = RuleSet(
    "txs", [expect("small", "balance < 8"), expect_or_drop("positive", "balance > 0 AND arrears > 0")]
)


def test_drop_removes_rows_that_are_not_true(txs):
    assert [r[0] for r in rows(RULES.apply(txs))] == [1, 5]


def test_warn_keeps_rows(txs):
    assert RuleSet("txs", [expect("never", "false")]).apply(txs).count() == 5


def test_clean_and_quarantine_partition_the_input(txs):
    kept, dropped = RULES.apply(txs), RULES.quarantine(txs)
    assert rows(kept.unionByName(dropped)) == rows(txs)
    assert rows(dropped, "id") == [(2,), (3,), (4,)]


def test_written_out_inverse_loses_null_rows(txs):
    inverse = RuleSet("bad", [expect_or_drop("negative", "balance <= 0 OR arrears <= 0")])
    assert rows(inverse.apply(txs), "id") == [(2,), (3,)]


def test_metrics(txs):
    found = {r["name"]: r for r in RULES.metrics(txs).collect()}
    assert (found["small"]["passed_records"], found["small"]["failed_records"]) == (2, 3)
    assert (found["positive"]["passed_records"], found["positive"]["failed_records"]) == (2, 3)
    assert {(r["dropped_records"], r["output_records"]) for r in found.values()} == {(3, 2)}


def test_metrics_of_empty_input(spark, txs):
    found = RULES.metrics(txs.limit(0)).collect()
    assert {(r["passed_records"], r["failed_records"], r["dropped_records"]) for r in found} == {(0, 0, 0)}


def test_metrics_by_group_and_roll_up(txs):
    by_center = RULES.metrics(txs.filter("center IS NOT NULL"), by=["center"])
    assert by_center.count() == 4
    assert rows(roll_up(by_center), "name", "passed_records") == [("positive", 1), ("small", 1)]


def test_fail_rule_stops_the_job(txs):
    rules = RuleSet("txs", [expect_or_fail("center given", "center IS NOT NULL")])
    with pytest.raises(Exception, match="center given"):
        rules.apply(txs).collect()
    with pytest.raises(ExpectationFailed, match="center given"):
        rules.check(txs)
    rules.check(txs.filter("center IS NOT NULL"))


def test_fail_rule_sees_rows_a_drop_rule_removes(txs):
    rules = RuleSet(
        "txs", [expect_or_drop("low", "id < 3"), expect_or_fail("center given", "center IS NOT NULL")]
    )
    with pytest.raises(Exception, match="center given"):
        rules.apply(txs).count()


def test_two_fail_rules_are_both_checked(txs):
    rules = RuleSet("txs", [expect_or_fail("first", "id > 0"), expect_or_fail("second", "id < 5")])
    with pytest.raises(Exception, match="second"):
        rules.apply(txs).count()
    assert rules.apply(txs.filter("id < 5")).count() == 4


def test_flagged_names_the_broken_rules(txs):
    found = {r["id"]: r["failed_rules"] for r in RULES.flagged(txs).collect()}
    assert found[1] == ["small"] and found[2] == ["positive"] and found[5] == []


def test_observed_counts_equal_metrics(txs):
    seen = Observation("seen")
    RULES.apply(RULES.observe(txs, seen)).write.format("noop").mode("overwrite").save()
    assert rows(RULES.observed_metrics(txs, seen.get)) == rows(RULES.metrics(txs))


def test_expect_all_and_unknown_action():
    assert [r.name for r in expect_all({"a": "true", "b": "true"}, "drop")] == ["a", "b"]
    with pytest.raises(ValueError):
        Rule("x", "true", "explode")


def test_fail_rule_ignores_rows_the_input_leaves_out(spark, txs):
    known = spark.createDataFrame([(1,), (2,), (3,), (4,)], "known_id int")
    joined = txs.join(known, txs.id == known.known_id)
    rules = RuleSet("txs", [expect_or_fail("center given", "center IS NOT NULL"), expect_or_drop("late", "id > 1")])
    assert rows(rules.apply(joined), "id") == [(2,), (3,), (4,)]
    assert rows(rules.apply(txs.filter("id < 5")), "id") == [(2,), (3,), (4,)]


def test_drop_rules_reach_the_file_reader(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    kept = RuleSet("lines", [expect_or_drop("many", "l_quantity > 49")]).apply(lines).select("l_orderkey")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,49.0)" in plan
