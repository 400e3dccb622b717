"""Train classifiers with Spark's own distributed learners."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit, TrainValidationSplitModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepipe.features.encoding import check_categories


def preparation(numeric: Sequence[str], categorical: Sequence[str] = ()) -> list:
    """Mean imputation and scaling of numbers; indicators with an unknown bucket for categories."""
    stages: list = [
        Imputer(inputCols=list(numeric), outputCols=[f"__{c}_filled" for c in numeric]),
        VectorAssembler(inputCols=[f"__{c}_filled" for c in numeric], outputCol="__numbers"),
        StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=True),
    ]
    parts = ["__scaled"]
    if categorical:
        indexed = [f"__{c}_index" for c in categorical]
        encoded = [f"__{c}_hot" for c in categorical]
        stages += [
            StringIndexer(
                inputCols=list(categorical),
                outputCols=indexed,
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            ),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=False),
        ]
        parts += encoded
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


def learner(classes: int, label: str, trees: int = 20, depth: int = 5, seed: int = 42):
    """Boosted trees for two classes, a forest for more; ``boosting.boost`` has boosted trees for any number."""
    if classes <= 2:
        return GBTClassifier(labelCol=label, maxIter=trees, maxDepth=depth, seed=seed)
    return RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)


def train(
    df: DataFrame,
    label: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    classes: int = 2,
    **options,
) -> PipelineModel:
    """Fit preparation and learner. Categories of more than ``MAX_INDICATORS`` values are refused."""
    if categorical:
        check_categories(df, categorical)
    stages = [*preparation(numeric, categorical), learner(classes, label, **options)]
    return Pipeline(stages=stages).fit(df)


def search(
    df: DataFrame,
    label: str,
    numeric: Sequence[str],
    grid: Mapping[str, Sequence],
    categorical: Sequence[str] = (),
    classes: int = 2,
    parallelism: int = 2,
    seed: int = 42,
) -> TrainValidationSplitModel:
    """Try every combination of ``{learner parameter: values}`` and keep the best by F1."""
    if categorical:
        check_categories(df, categorical)
    estimator = learner(classes, label, seed=seed)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), list(values))
    return TrainValidationSplit(
        estimator=Pipeline(stages=[*preparation(numeric, categorical), estimator]),
        estimatorParamMaps=builder.build(),
        evaluator=MulticlassClassificationEvaluator(labelCol=label, metricName="f1"),
        trainRatio=0.75,
        parallelism=parallelism,
        seed=seed,
    ).fit(df)


def predict(model, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Key columns, prediction and the probability of the predicted class."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(df)
    best = F.array_max(vector_to_array("probability")) if "probability" in scored.columns else F.lit(None)
    return scored.select(*keep, F.col("prediction").cast("int"), best.alias("probability"))
