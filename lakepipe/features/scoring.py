"""Apply a model to a table in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakepipe.features.tables import select_signature

Model = Callable[[pd.DataFrame], pd.Series]


def _field_names(signature: T.StructType | str) -> list[str]:
    fields = signature if isinstance(signature, T.StructType) else T.StructType.fromDDL(signature)
    return fields.names


def model_udf(model: Model, signature: T.StructType | str, returns: str):
    """A vectorised function over one struct of the signature's fields."""
    names = _field_names(signature)

    @F.pandas_udf(returns)
    def score(frame: pd.DataFrame) -> pd.Series:
        return model(frame[names])

    return score


def model_udf_of_columns(model: Model, signature: T.StructType | str, returns: str):
    """The same, called with the signature's columns in order."""
    names = _field_names(signature)

    @F.pandas_udf(returns)
    def score(*columns: pd.Series) -> pd.Series:
        return model(pd.concat(columns, axis=1, keys=names))

    return score


def register_model(spark: SparkSession, name: str, udf) -> None:
    """Make the model callable from SQL."""
    spark.udf.register(name, udf)


def score_table(
    df: DataFrame, udf, signature: T.StructType | str, out: str = "prediction"
) -> DataFrame:
    """Add the prediction; only the model's inputs travel to Python."""
    inputs = select_signature(df, signature).schema
    return df.withColumn(out, udf(F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in inputs])))


def map_frames(
    df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str
) -> DataFrame:
    """Frame-to-frame function over the batches of each partition."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield function(frame)

    return df.mapInPandas(batches, schema)


def rule_model(conditions: Callable[[pd.DataFrame], Sequence], yes, no) -> Model:
    """A model that answers ``yes`` where any of the conditions holds."""

    def predict(frame: pd.DataFrame) -> pd.Series:
        hit = pd.Series(False, index=frame.index)
        for condition in conditions(frame):
            hit = hit | condition.fillna(False).astype(bool)
        return hit.map({True: yes, False: no})

    return predict
