"""Data-quality rules on a dataset: warn, drop, fail, quarantine, count.

A row passes a rule only if the rule's predicate is true; null does not pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

WARN, DROP, FAIL = "warn", "drop", "fail"


RULE_COUNTS = (
    "array<struct<name:string, action:string, passed_records:bigint, failed_records:bigint>>"
)


class ExpectationFailed(ValueError):
    """A fail rule found violating rows."""


@dataclass(frozen=True)
class Rule:
    name: str
    predicate: str
    action: str = WARN

    def __post_init__(self) -> None:
        if self.action not in (WARN, DROP, FAIL):
            raise ValueError(f"unknown action {self.action!r} of rule {self.name!r}")

    @property
    def passes(self) -> Column:
        return F.coalesce(F.expr(self.predicate), F.lit(False))


def expect(name: str, predicate: str) -> Rule:
    return Rule(name, predicate, WARN)


def expect_or_drop(name: str, predicate: str) -> Rule:
    return Rule(name, predicate, DROP)


def expect_or_fail(name: str, predicate: str) -> Rule:
    return Rule(name, predicate, FAIL)


def expect_all(rules: Mapping[str, str], action: str = WARN) -> list[Rule]:
    return [Rule(name, predicate, action) for name, predicate in rules.items()]


def _every(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


@dataclass(frozen=True)
class RuleSet:
    dataset: str
    rules: Sequence[Rule] = field(default_factory=tuple)

    def _with(self, action: str) -> list[Rule]:
        return [r for r in self.rules if r.action == action]

    def kept(self) -> Column:
        """True for rows that no drop rule removes."""
        return _every([r.passes for r in self._with(DROP)])

    def apply(self, df: DataFrame) -> DataFrame:
        """Rows that survive the drop rules; a violated fail rule ends the job.

        Drop rules alone are a plain filter that can reach the file reader. Fail
        rules look at every row of ``df``, also at rows that a drop rule removes,
        but at no row that ``df`` itself leaves out (in a join, say): the check is
        one expression and is not deterministic for Spark, so it is neither
        split nor moved.
        """
        fails, drops = self._with(FAIL), self._with(DROP)
        if not fails:
            return df.filter(_every([F.expr(r.predicate) for r in drops])) if drops else df
        checked = F.spark_partition_id() >= 0  # always true, but differs by task
        for rule in fails:
            checked = F.when(rule.passes, checked).otherwise(self._raise(rule))
        return df.filter(F.when(checked, self.kept()))

    def _raise(self, rule: Rule) -> Column:
        message = f"expectation {rule.name!r} of {self.dataset!r} failed"
        return F.raise_error(F.lit(message)).cast("boolean")

    def check(self, df: DataFrame) -> None:
        """Gate before a write: one aggregate over the fail rules, then raise."""
        fails = self._with(FAIL)
        if not fails:
            return
        counts = df.agg(*[F.count_if(~r.passes).alias(str(i)) for i, r in enumerate(fails)]).first()
        broken = {r.name: counts[str(i)] for i, r in enumerate(fails) if counts[str(i)]}
        if broken:
            raise ExpectationFailed(f"{self.dataset}: {broken}")

    def quarantine(self, df: DataFrame) -> DataFrame:
        """Exactly the rows that ``apply`` drops."""
        return df.filter(~self.kept())

    def flagged(self, df: DataFrame) -> DataFrame:
        """All rows plus the names of the rules each row breaks."""
        broken = F.array(*[F.when(~r.passes, F.lit(r.name)) for r in self.rules])
        return df.withColumn("failed_rules", F.array_compact(broken))

    def _counters(self) -> list[Column]:
        counters = [
            F.count(F.lit(1)).alias("input_records"),
            F.count_if(self.kept()).alias("output_records"),
        ]
        for i, rule in enumerate(self.rules):
            counters.append(F.count_if(rule.passes).alias(f"passed_{i}"))
        return counters

    def _per_rule(self, counted: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        entries = [
            F.struct(
                F.lit(rule.name).alias("name"),
                F.lit(rule.action).alias("action"),
                F.col(f"passed_{i}").alias("passed_records"),
                (F.col("input_records") - F.col(f"passed_{i}")).alias("failed_records"),
            )
            for i, rule in enumerate(self.rules)
        ]
        return counted.select(
            *by,
            F.lit(self.dataset).alias("dataset"),
            "output_records",
            (F.col("input_records") - F.col("output_records")).alias("dropped_records"),
            F.explode(F.array(*entries).cast(RULE_COUNTS)).alias("rule"),
        ).select(*by, "dataset", "rule.*", "dropped_records", "output_records")

    def metrics(self, df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        """One row per rule (and group): passed, failed, dropped and output rows, in one pass."""
        grouped = df.groupBy(*by) if by else df
        return self._per_rule(grouped.agg(*self._counters()), by)

    def observe(self, df: DataFrame, name: str | Observation) -> DataFrame:
        """Count while the frame is written, without a second pass; rules are not applied yet."""
        return df.observe(name, *self._counters())

    def observed_metrics(self, df: DataFrame, counts: Mapping[str, int]) -> DataFrame:
        """Turn the counters of ``observe`` into the rows of ``metrics``."""
        names = [f"passed_{i}" for i in range(len(self.rules))]
        names = ["input_records", "output_records", *names]
        row = [tuple(int(counts.get(n) or 0) for n in names)]
        schema = ", ".join(f"{n} long" for n in names)
        return self._per_rule(df.sparkSession.createDataFrame(row, schema))


def roll_up(metrics: DataFrame) -> DataFrame:
    """Totals per rule name over any number of metric rows."""
    return metrics.groupBy("name").agg(
        F.sum("passed_records").alias("passed_records"),
        F.sum("failed_records").alias("failed_records"),
    )
