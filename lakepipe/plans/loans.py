"""Loan transactions: enrich, apply rules, quarantine, roll up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepipe.functions.scalars import parse_timestamp
from lakepipe.operators.aggregates import total_by
from lakepipe.operators.expectations import RuleSet, expect, expect_or_drop, expect_or_fail
from lakepipe.operators.joins import enrich
from lakepipe.plans.registry import plain_time, query, rounded
from lakepipe.plans.views import SQL, historical, parsed_sql, ref_treatment, txs, with_views

# Rule names, and the first payment day that counts as this year.
PAYMENT_RULE = "Payments should be this year"
BALANCE_RULE = "Balance should be positive"
CENTER_RULE = "Cost center must be specified"
GRADE_RULE = "Grade should be valid"
RECOVERY_RULE = "Recoveries should be int"
LAST_YEAR_END = "2020-12-31"

CLEAN_RULES = RuleSet(
    "cleaned_new_txs",
    [
        expect(PAYMENT_RULE, f"next_payment_date > date'{LAST_YEAR_END}'"),
        expect_or_drop(BALANCE_RULE, "balance > 0 AND arrears_balance > 0"),
        expect_or_fail(CENTER_RULE, "cost_center_code IS NOT NULL"),
    ],
)
QUARANTINE_RULES = RuleSet(
    "quarantine_bad_txs",
    [
        expect(PAYMENT_RULE, f"next_payment_date <= date'{LAST_YEAR_END}'"),
        expect_or_drop(BALANCE_RULE, "balance <= 0 OR arrears_balance <= 0"),
    ],
)
HISTORY_RULES = RuleSet(
    "historical_txs",
    [
        expect(GRADE_RULE, "grade IN ('A', 'B', 'C', 'D', 'E', 'F', 'G')"),
        expect_or_drop(RECOVERY_RULE, "try_cast(recoveries AS INT) IS NOT NULL"),
    ],
)

SQL["new_txs"] = f"""
SELECT t.* REPLACE ({parsed_sql('t.next_payment_date')} AS next_payment_date), r.accounting_treatment
FROM txs t JOIN ref_treatment r ON t.accounting_treatment_id = r.id"""
SQL["clean_txs"] = "SELECT * FROM new_txs WHERE balance > 0 AND arrears_balance > 0"
SQL["historical_txs"] = """
SELECT l.*, r.accounting_treatment FROM historical l JOIN ref_treatment r ON l.accounting_treatment_id = r.id
WHERE try_cast(recoveries AS INTEGER) IS NOT NULL"""

TX_VIEWS = ("txs", "ref_treatment", "new_txs")
CLEAN_VIEWS = (*TX_VIEWS, "clean_txs")
TREATMENT = {"accounting_treatment_id": "id"}
ADDED = {"accounting_treatment": "accounting_treatment"}


def new_txs_of(raw: DataFrame, ref: DataFrame) -> DataFrame:
    """Works on a table and on a stream of transactions."""
    parsed = raw.withColumn("next_payment_date", parse_timestamp("next_payment_date"))
    return enrich(parsed, ref, TREATMENT, ADDED)


def new_txs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return new_txs_of(txs(spark, sf_dir), ref_treatment(spark, sf_dir))


def _plain(df: DataFrame) -> DataFrame:
    return df.withColumn("next_payment_date", plain_time("next_payment_date"))


@query("loans_enrich", with_views("SELECT * FROM new_txs", *TX_VIEWS))
def loans_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(new_txs(spark, sf_dir))


@query("loans_clean", with_views("SELECT * FROM clean_txs", *CLEAN_VIEWS))
def loans_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(CLEAN_RULES.apply(new_txs(spark, sf_dir)))


@query(
    "loans_quarantine",
    with_views("SELECT * FROM new_txs WHERE balance <= 0 OR arrears_balance <= 0", *TX_VIEWS),
)
def loans_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hand-written inverse rules: a null balance is in neither table."""
    return _plain(QUARANTINE_RULES.apply(new_txs(spark, sf_dir)))


@query(
    "loans_quarantine_complement",
    with_views(
        "SELECT * FROM new_txs WHERE NOT coalesce(balance > 0 AND arrears_balance > 0, false)",
        *TX_VIEWS,
    ),
)
def loans_quarantine_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly the rows the clean table drops, nulls included."""
    return _plain(CLEAN_RULES.quarantine(new_txs(spark, sf_dir)))


@query("historical_enrich", with_views("SELECT * FROM historical_txs", "historical", "ref_treatment", "historical_txs"))
def historical_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = enrich(historical(spark, sf_dir), ref_treatment(spark, sf_dir), TREATMENT, ADDED)
    return HISTORY_RULES.apply(joined)


@query(
    "castable_filter",
    with_views("SELECT id, recoveries FROM historical WHERE try_cast(recoveries AS INTEGER) IS NOT NULL", "historical"),
)
def castable_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakepipe.operators.relational import castable

    return castable(historical(spark, sf_dir).select("id", "recoveries"), "recoveries", "int")


@query(
    "balance_by_center",
    with_views(
        "SELECT cost_center_code, round(sum(balance), 2) AS sum_balance FROM clean_txs GROUP BY cost_center_code",
        *CLEAN_VIEWS,
    ),
)
def balance_by_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = CLEAN_RULES.apply(new_txs(spark, sf_dir))
    totals = total_by(clean, "cost_center_code", "balance", "sum_balance")
    return totals.withColumn("sum_balance", rounded("sum_balance", 2))


@query(
    "balance_by_country",
    with_views(
        'SELECT country_code, CAST(sum("count") AS BIGINT) AS sum_count FROM clean_txs GROUP BY country_code',
        *CLEAN_VIEWS,
    ),
)
def balance_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return total_by(CLEAN_RULES.apply(new_txs(spark, sf_dir)), "country_code", "count", "sum_count")


_BOTH_BALANCES = """
SELECT round(sum(revol_bal), 2) AS bal, addr_state AS location_code FROM historical_txs GROUP BY addr_state
UNION {how}
SELECT round(sum(balance), 2) AS bal, country_code AS location_code FROM clean_txs GROUP BY country_code"""
_BALANCE_VIEWS = (*CLEAN_VIEWS, "historical", "historical_txs")


def _location_balances(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    old = total_by(historical_enrich(spark, sf_dir), "addr_state", "revol_bal", "bal")
    new = total_by(CLEAN_RULES.apply(new_txs(spark, sf_dir)), "country_code", "balance", "bal")
    return tuple(
        df.select(rounded("bal", 2).alias("bal"), F.col(key).alias("location_code"))
        for df, key in ((old, "addr_state"), (new, "country_code"))
    )


@query("total_balances_all", with_views(_BOTH_BALANCES.format(how="ALL"), *_BALANCE_VIEWS))
def total_balances_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _location_balances(spark, sf_dir)
    return old.union(new)


@query("total_balances_distinct", with_views(_BOTH_BALANCES.format(how=""), *_BALANCE_VIEWS))
def total_balances_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _location_balances(spark, sf_dir)
    return old.union(new).distinct()
