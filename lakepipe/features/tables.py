"""Feature tables and model inputs: keys, signatures, data splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakepipe.operators.relational import key_percent
from lakepipe.sinks.tables import overwrite_table

# Shares of the train, validation and test rows.
SPLIT_SHARES = {"train": 60, "validate": 20, "test": 20}


def primary_key_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, rows with a null key, and keys that occur more than once - as one row."""
    null_key = F.lit(False)
    for key in keys:
        null_key = null_key | F.col(key).isNull()
    per_key = df.groupBy(*keys).count()
    return per_key.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("row_count"),
        F.coalesce(F.sum(F.when(null_key, F.col("count"))), F.lit(0)).alias("null_key_rows"),
        F.count_if(~null_key & (F.col("count") > 1)).alias("duplicate_keys"),
    )


def assert_primary_key(df: DataFrame, keys: Sequence[str]) -> None:
    found = primary_key_report(df, keys).first()
    if found["null_key_rows"] or found["duplicate_keys"]:
        raise ValueError(f"not a primary key {list(keys)}: {found.asDict()}")


def write_feature_table(df: DataFrame, name: str, keys: Sequence[str]) -> None:
    """Replace a feature table after its key has been checked."""
    assert_primary_key(df, keys)
    overwrite_table(df, name)


def select_signature(df: DataFrame, signature: T.StructType | str) -> DataFrame:
    """Columns in the order and of the types a model expects; missing ones are an error."""
    if isinstance(signature, str):
        signature = T.StructType.fromDDL(signature)
    missing = [f.name for f in signature.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"model inputs not in the table: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in signature.fields])


def split_by(position: Column, shares: Mapping[str, int] | None = None) -> Column:
    """Name of the part for a whole number in 0..99."""
    upper, label = 0, None
    names = list((shares or SPLIT_SHARES).items())
    for name, share in names[:-1]:
        upper += share
        label = (F if label is None else label).when(position < upper, F.lit(name))
    last = F.lit(names[-1][0])
    return last if label is None else label.otherwise(last)


def assign_split(
    df: DataFrame, key: str, shares: Mapping[str, int] | None = None, out: str = "split"
) -> DataFrame:
    """Repeatable split: a key always lands in the same part."""
    return df.withColumn(out, split_by(key_percent(key), shares))
