"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepipe.session import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters, digits and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANY_CASE_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """Lower-cased words; null and empty text give an empty array."""
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))


def count_words(text: Column) -> Column:
    """The number of ``words_of``, without making them."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(ANY_CASE_WORD)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is worked out once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def positions(count: Column) -> Column:
    """1 .. count; empty when count is below 1."""
    return F.when(count >= 1, F.sequence(F.lit(1), count.cast("int"))).otherwise(F.array().cast("array<int>"))


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _h, _text): a row is known by its id and a hash of its text.

    The hash tells apart rows that share an id; it is never taken as proof that texts are equal.
    Rows repeated with the same id and text are one document and share one answer.
    """
    return docs.select(
        F.col(id_col).alias("_id"),
        F.xxhash64(F.col(text_col)).alias("_h"),
        F.col(text_col).cast("string").alias("_text"),
    )


def join_rows(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on (_id, _h), null ids included; the right side's key columns go."""
    other = right.withColumnsRenamed({"_id": "_gid", "_h": "_gh"})
    on = F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_h") == F.col("_gh"))
    joined = left.join(other, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop("_gid", "_gh")


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows whose (_id, _h) is in ``gone``; columns as given, whatever their names."""
    names = docs.columns
    inner = docs.select(
        *[F.col(f"`{n}`").alias(f"_c{i}") for i, n in enumerate(names)],
        F.col(f"`{id_col}`").alias("_id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("_h"),
    )
    left = join_rows(inner, gone, "left_anti")
    return left.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder and read back: lineage is cut and survives lost executors.

    Takes less room than a checkpoint, as Parquet is compressed, and the job's shuffle files go at once. The table is
    deleted when the session ends.
    """
    return written(df, label)
