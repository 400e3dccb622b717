"""Categories to indicator columns; numbers to imputed, standardised columns."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepipe.operators.windows import with_row_index
from lakepipe.session import written


#: Indicator columns of one category at most, unless more are asked for: each value becomes a column of the table.
MAX_INDICATORS = 1_000


def _distinct_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(name, value): the distinct values of each column as text, without null."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    return df.select(F.explode(pairs).alias("p")).select("p.*").filter(F.col("value").isNotNull()).distinct()


def check_categories(df: DataFrame, columns: Sequence[str], limit: int = MAX_INDICATORS) -> None:
    """Refuse columns of more than ``limit`` values, by an exact count on the executors."""
    sizes = _distinct_values(df, columns).groupBy("name").count().filter(F.col("count") > limit).collect()
    if sizes:
        wide = {r["name"]: r["count"] for r in sizes}
        raise ValueError(f"too many categories for indicator columns: {wide}; see CategoryIndex")


def learn_categories(
    df: DataFrame, columns: Sequence[str], limit: int = MAX_INDICATORS
) -> dict[str, list[str]]:
    """Sorted distinct values of each column, as text: each becomes a column later.

    A column of more than ``limit`` values is refused, by an exact count and before its values are collected. Known
    values need not be learned: hand them to ``one_hot``.
    """
    check_categories(df, columns, limit)
    found: dict[str, list[str]] = {c: [] for c in columns}
    for row in _distinct_values(df, columns).orderBy("name", "value").collect():
        found[row["name"]].append(row["value"])
    return found


@dataclass(frozen=True)
class CategoryIndex:
    """Indicators for columns of any number of values: a dictionary that stays a table, and sparse vectors.

    ``fit`` numbers the distinct values of each column in text order with range-sorted row numbers; only the number of
    values per column reaches the driver. ``transform`` joins the numbers on.
    """

    dictionary: DataFrame  # (name, value, place): places of a column from 0
    sizes: Mapping[str, int]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> CategoryIndex:
        numbered = written(with_row_index(_distinct_values(df, columns), ["name", "value"], "row"), "categories")
        spans = {
            r["name"]: (r["first"], r["size"])
            for r in numbered.groupBy("name").agg(F.min("row").alias("first"), F.count("*").alias("size")).collect()
        }
        first = F.create_map(*[F.lit(x) for c in columns for x in (c, spans.get(c, (0, 0))[0])])
        placed = numbered.select("name", "value", (F.col("row") - F.element_at(first, F.col("name"))).cast("int").alias("place"))
        return cls(placed, {c: spans.get(c, (0, 0))[1] for c in columns})

    def index(self, df: DataFrame, suffix: str = "_index") -> DataFrame:
        """Add the number of each column's value; null for null, the column's size for a value that was not learned."""
        out = df
        for c, size in self.sizes.items():
            own = self.dictionary.where(F.col("name") == c).select(
                F.col("value").alias("__value"), F.col("place").alias(f"{c}{suffix}")
            )
            out = out.join(own, F.col(c).cast("string") == F.col("__value"), "left").drop("__value")
            known = F.coalesce(F.col(f"{c}{suffix}"), F.when(F.col(c).isNotNull(), size))
            out = out.withColumn(f"{c}{suffix}", known)
        return out

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        """Add a sparse vector of 0/1 indicators, columns one after the other, each with a last place for unknown values.

        A null value has no indicator.
        """
        encoded = self.index(df, "__place")
        places = []
        for c, size in self.sizes.items():
            # the encoder is told the number of places; null takes one behind them, which is dropped
            encoded = encoded.withColumn(f"{c}__place", F.coalesce(F.col(f"{c}__place"), F.lit(size + 1)).cast("double"))
            places.append(f"{c}__place")
        hot = [f"{c}__hot" for c in places]
        sizes = [size + 2 for size in self.sizes.values()]
        encoder = OneHotEncoder(inputCols=places, outputCols=hot, dropLast=True).fit(_edge_rows(df, places, sizes))
        assembled = VectorAssembler(inputCols=hot, outputCol=out).transform(encoder.transform(encoded))
        return assembled.drop(*places, *hot)


def _edge_rows(df: DataFrame, names: Sequence[str], sizes: Sequence[int]) -> DataFrame:
    """One row with the greatest number of each column."""
    return df.sparkSession.createDataFrame(
        [tuple(float(s - 1) for s in sizes)], ", ".join(f"`{n}` double" for n in names)
    )


def one_hot(
    df: DataFrame,
    categories: Mapping[str, Sequence[str]],
    drop_first: bool = False,
    unknown: str | None = None,
) -> DataFrame:
    """Replace each column by 0/1 columns ``column_value``; null gives all zeros.

    ``unknown`` names an extra indicator for values that were not learned.
    """
    indicators = []
    for column, values in categories.items():
        for value in values[1:] if drop_first else values:
            hit = F.coalesce(F.col(column).cast("string") == F.lit(value), F.lit(False))
            indicators.append(hit.cast("long").alias(f"{column}_{value}"))
        if unknown:
            known = F.coalesce(F.col(column).cast("string").isin(list(values)), F.lit(False))
            indicators.append((~known).cast("long").alias(f"{column}_{unknown}"))
    return df.select(*[c for c in df.columns if c not in categories], *indicators)


@dataclass(frozen=True)
class Scaler:
    """Mean and spread per column, learned in one pass; applied as plain expressions."""

    means: Mapping[str, float]
    spreads: Mapping[str, float]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> Scaler:
        """The spread is the population deviation after nulls are filled with the mean."""
        aggregates = [F.count(F.lit(1)).alias("rows")]
        for c in columns:
            aggregates += [
                F.avg(c).alias(f"mean_{c}"),
                F.var_pop(c).alias(f"var_{c}"),
                F.count(c).alias(f"known_{c}"),
            ]
        row = df.agg(*aggregates).first()
        means = {c: row[f"mean_{c}"] or 0.0 for c in columns}
        spreads = {}
        for c in columns:
            filled = (row[f"var_{c}"] or 0.0) * row[f"known_{c}"] / max(row["rows"], 1)
            spreads[c] = math.sqrt(filled) or 1.0
        return cls(means, spreads)

    def impute(self, column: str) -> Column:
        return F.coalesce(F.col(column).cast("double"), F.lit(self.means[column]))

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns(
            {c: (self.impute(c) - self.means[c]) / self.spreads[c] for c in self.means}
        )
