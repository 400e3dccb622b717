"""Judge a scored table: confusion counts, metrics, curves, slices, release checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepipe.functions.scalars import matches
from lakepipe.operators.ranges import running_totals
from lakepipe.session import written

# Fixed value: every slice must be more accurate than this.
SLICE_THRESHOLD = 0.55


def confusion_matrix(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("rows"))


def binary_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of a 0/1 prediction, as one row."""
    said, true = F.col(prediction) == 1, F.col(label) == 1
    counted = df.agg(
        F.count_if(said & true).alias("tp"),
        F.count_if(said & ~true).alias("fp"),
        F.count_if(~said & true).alias("fn"),
        F.count_if(~said & ~true).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counted.select(
        "tp",
        "fp",
        "fn",
        "tn",
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def _cumulative(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives at or above each distinct score, and the totals, of the table or of each group.

    Rows are first added up per group and score (stored, as they are read several times); the running sums are then built
    range by range, so no task sees the whole score axis or a whole group.
    """
    by = list(by)
    per_score = written(
        df.filter(F.col(score).isNotNull())
        .groupBy(*by, score)
        .agg(
            F.count_if(F.col(label) == 1).alias("positives"),
            F.count_if(F.col(label) == 0).alias("negatives"),
        )
    )
    summed = running_totals(per_score, score, {"tp": "positives", "fp": "negatives"}, within=by, descending=True)
    totals = per_score.groupBy(*[F.col(c).alias(f"__of_{c}") for c in by]).agg(
        F.sum("positives").alias("all_positives"), F.sum("negatives").alias("all_negatives")
    )
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"__of_{c}")), by, F.lit(True))
    # one row per group: without groups a single one
    totals = totals if by else F.broadcast(totals)
    return summed.join(totals, same).drop(*[f"__of_{c}" for c in by])


def roc_points(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """False and true positive rate at every threshold; with ``by`` a curve for each group."""
    return _cumulative(df, label, score, by).select(
        *by,
        F.col(score).alias("threshold"),
        F.try_divide("fp", "all_negatives").alias("fpr"),
        F.try_divide("tp", "all_positives").alias("tpr"),
    )


def pr_points(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at every threshold; with ``by`` a curve for each group."""
    return _cumulative(df, label, score, by).select(
        *by,
        F.col(score).alias("threshold"),
        F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide("tp", "all_positives").alias("recall"),
    )


def area_under_roc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of (positive, negative) pairs that the score orders rightly; ties count half."""
    summed = _cumulative(df, label, score, by)
    pairs = F.col("negatives") * (F.col("tp") - F.col("positives") + F.col("positives") / 2)
    all_pairs = F.max(F.col("all_positives") * F.col("all_negatives"))
    return summed.groupBy(*by).agg(F.try_divide(F.sum(pairs), all_pairs).alias("area_under_roc"))


def log_loss(df: DataFrame, label: str, probabilities: str) -> DataFrame:
    """Mean negative log of the probability given to the true class, from an array of class probabilities."""
    given = F.greatest(F.get(F.col(probabilities), F.col(label)), F.lit(1e-15))
    return df.filter(F.col(label).isNotNull()).agg(F.avg(-F.log(given)).alias("log_loss"))


def slice_accuracy(
    df: DataFrame, slices: Sequence[str], label: str, prediction: str
) -> DataFrame:
    return (
        df.groupBy(*slices)
        .agg(
            F.sum(matches(label, prediction)).alias("correct"),
            F.count(F.lit(1)).alias("observations"),
        )
        .withColumn("accuracy", F.col("correct") / F.col("observations"))
    )


def slice_gate(
    df: DataFrame,
    slices: Sequence[str],
    label: str,
    prediction: str,
    threshold: float = SLICE_THRESHOLD,
) -> DataFrame:
    """One row: does every slice exceed the threshold?"""
    passed = F.col("accuracy") > threshold
    return slice_accuracy(df, slices, label, prediction).agg(
        F.count(F.lit(1)).alias("slices"),
        F.count_if(passed).alias("passed_slices"),
        F.coalesce(F.every(passed), F.lit(False)).alias("passed"),
    )


def validation_report(
    scored: DataFrame,
    slices: Sequence[str],
    label: str,
    prediction: str,
    expected_inputs: Sequence[str],
    description: str = "",
    threshold: float = SLICE_THRESHOLD,
    min_description: int = 20,
) -> DataFrame:
    """One row of release checks; a single failed check rejects the model."""
    has_signature = bool(expected_inputs) and all(c in scored.columns for c in expected_inputs)
    # missing predictions are counted in the slice aggregate: one pass over the rows
    per_slice = (
        scored.groupBy(*slices)
        .agg(
            F.count_if(F.col(prediction).isNull()).alias("missing"),
            F.sum(matches(label, prediction)).alias("correct"),
            F.count(F.lit(1)).alias("observations"),
        )
        .withColumn("slice_passed", F.col("correct") / F.col("observations") > threshold)
    )
    report = per_slice.agg(
        F.coalesce(F.sum("missing") == 0, F.lit(False)).alias("predicts"),
        F.coalesce(F.every("slice_passed"), F.lit(False)).alias("slices_passed"),
    ).withColumns(
        {
            "has_signature": F.lit(has_signature),
            "has_description": F.lit(len(description) > min_description),
        }
    )
    accepted = (
        F.col("predicts")
        & F.col("slices_passed")
        & F.col("has_signature")
        & F.col("has_description")
    )
    return report.withColumn("decision", F.when(accepted, "accept").otherwise("reject"))
