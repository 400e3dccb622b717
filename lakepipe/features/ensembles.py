"""Fitted tree ensembles as plain column expressions: scoring and SQL calls then need no Python and no model file.

A tree is a nest of CASE expressions over the model's input columns, a class' margin the sum over its trees, and the
probabilities follow from the margins. ``of_pipeline`` reads a model that Spark's learners have fitted, ``softmax_ensemble``
(boosting) makes its own.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A leaf's value, or (input, threshold, tree at or below it, tree above it); an input that is null or NaN goes above.
Tree = float | tuple[int, float, "Tree", "Tree"]


def number(value: float) -> str:
    """A double as SQL that gives the same double."""
    return f"{float(value)!r}D" if value == value and abs(value) != float("inf") else f"double('{value}')"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


@dataclass(frozen=True)
class Ensemble:
    """Trees of each class over inputs given as SQL; ``link`` turns margins into probabilities.

    ``logistic``: one list of trees, the margin of class 1. ``softmax``: a list for each class. ``mean``: leaves are
    class probabilities, averaged.
    """

    inputs: tuple[str, ...]
    trees: tuple[tuple[Tree, ...], ...]
    bases: tuple[float, ...]
    link: str
    columns: tuple[str, ...]  # columns of the table that the inputs are made of

    def _tree(self, tree: Tree) -> str:
        if not isinstance(tree, (tuple, list)):
            return number(tree)
        at, threshold, low, high = tree
        return f"CASE WHEN {self.inputs[at]} <= {number(threshold)} THEN {self._tree(low)} ELSE {self._tree(high)} END"

    def margins(self) -> list[str]:
        """One SQL expression for each list of trees."""
        return [
            " + ".join([number(base), *[f"({self._tree(t)})" for t in trees]])
            for base, trees in zip(self.bases, self.trees, strict=True)
        ]

    def probabilities(self) -> str:
        """SQL of the array of class probabilities."""
        if self.link == "logistic":
            return f"transform(array({self.margins()[0]}), m -> array(1 - 1 / (1 + exp(-m)), 1 / (1 + exp(-m))))[0]"
        held = f"array({', '.join(self.margins())})"
        if self.link == "mean":
            return held
        raised = f"transform(array({held}), m -> transform(m, x -> exp(x - array_max(m))))[0]"
        return f"transform(array({raised}), e -> transform(e, x -> x / aggregate(e, 0D, (a, b) -> a + b)))[0]"

    def probability_column(self) -> Column:
        return F.expr(self.probabilities())

    def score(self, df: DataFrame, prediction: str = "prediction", probability: str = "probability") -> DataFrame:
        """Add the class with the greatest probability (ties: the smallest) and that probability."""
        held = df.withColumn("__p", self.probability_column())
        return held.withColumns(
            {
                prediction: (F.array_position("__p", F.array_max("__p")) - 1).cast("int"),
                probability: F.array_max("__p"),
            }
        ).drop("__p")

    def register(self, spark: SparkSession, name: str, kinds: dict[str, str]) -> None:
        """Make the class probabilities callable from SQL, with the columns as arguments in their order."""
        arguments = ", ".join(f"{quoted(c)} {kinds[c]}" for c in self.columns)
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS ARRAY<DOUBLE> RETURN {self.probabilities()}"
        )

    def save(self, spark: SparkSession, path: str) -> None:
        """One row of JSON, as a table."""
        spark.createDataFrame([(json.dumps(asdict(self)),)], "model string").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Ensemble:
        held = json.loads(spark.read.parquet(path).first()["model"])

        def tree(t):
            return (t[0], t[1], tree(t[2]), tree(t[3])) if isinstance(t, list) else float(t)

        return Ensemble(
            tuple(held["inputs"]),
            tuple(tuple(tree(t) for t in trees) for trees in held["trees"]),
            tuple(held["bases"]),
            held["link"],
            tuple(held["columns"]),
        )


def _tree_of(node, leaf) -> Tree:
    """A tree of Spark's learners; ``leaf`` gives the value of a leaf node."""
    if node.subtreeDepth() == 0:
        return leaf(node)
    split = node.split()
    low, high = _tree_of(node.leftChild(), leaf), _tree_of(node.rightChild(), leaf)
    if "Categorical" in split.getClass().getSimpleName():
        # an indicator: 0 goes one way, 1 the other
        left = {float(c) for c in split.leftCategories()}
        if left not in ({0.0}, {1.0}) or {float(c) for c in split.rightCategories()} != {0.0, 1.0} - left:
            raise ValueError("splits on unordered categories are not supported: encode them as indicators")
        return (split.featureIndex(), 0.5, *((low, high) if left == {0.0} else (high, low)))
    return (split.featureIndex(), split.threshold(), low, high)


def _inputs_of(model: PipelineModel) -> tuple[list[str], list[str]]:
    """SQL of each place of the feature vector that ``preparation`` makes, and the columns behind them."""
    stages = {type(s).__name__: s for s in model.stages}
    imputer, scaler = stages["ImputerModel"], stages["StandardScalerModel"]
    means = imputer.surrogateDF.first()
    columns = list(imputer.getInputCols())
    inputs = []
    for i, c in enumerate(columns):
        value = f"CAST({quoted(c)} AS DOUBLE)"
        filled = f"CASE WHEN {value} IS NULL OR isnan({value}) THEN {number(means[c])} ELSE {value} END"
        shifted = f"(({filled}) - {number(scaler.mean[i])})"
        # the scaler multiplies by the inverse; a constant column becomes zero
        inverse = 1.0 / scaler.std[i] if scaler.std[i] != 0 else 0.0
        inputs.append(f"({shifted} * {number(inverse)})")
    if "StringIndexerModel" in stages:
        indexer, encoder = stages["StringIndexerModel"], stages["OneHotEncoderModel"]
        for c, labels, size in zip(indexer.getInputCols(), indexer.labelsArray, encoder.categorySizes, strict=True):
            columns.append(c)
            texts = ["'" + label.replace("\\", "\\\\").replace("'", "\\'") + "'" for label in labels]
            inputs += [f"double(coalesce(CAST({quoted(c)} AS STRING) = {t}, false))" for t in texts]
            known = f"coalesce(CAST({quoted(c)} AS STRING) IN ({', '.join(texts)}), false)" if texts else "false"
            inputs += [f"double(NOT {known})"] * (size - len(texts))
    return inputs, columns


def of_pipeline(model: PipelineModel) -> Ensemble:
    """The ensemble behind a pipeline fitted by ``training.train``: boosted trees or a forest."""
    inputs, columns = _inputs_of(model)
    learned = model.stages[-1]
    kind = type(learned).__name__
    if kind == "GBTClassificationModel":
        # the margin is twice the weighted sum
        trees = [
            _scaled(_tree_of(t._java_obj.rootNode(), lambda n: n.prediction()), 2 * w)
            for t, w in zip(learned.trees, learned.treeWeights, strict=True)
        ]
        return Ensemble(tuple(inputs), (tuple(trees),), (0.0,), "logistic", tuple(columns))
    if kind == "RandomForestClassificationModel":
        classes, count = learned.numClasses, len(learned.trees)

        def share(of: int):
            def leaf(node) -> float:
                held = list(node.impurityStats().stats())
                return held[of] / (sum(held) or 1.0) / count

            return leaf

        trees = [tuple(_tree_of(t._java_obj.rootNode(), share(k)) for t in learned.trees) for k in range(classes)]
        return Ensemble(tuple(inputs), tuple(trees), (0.0,) * classes, "mean", tuple(columns))
    raise TypeError(f"not a tree ensemble: {kind}")


def _scaled(tree: Tree, factor: float) -> Tree:
    if not isinstance(tree, tuple):
        return tree * factor
    at, threshold, low, high = tree
    return (at, threshold, _scaled(low, factor), _scaled(high, factor))
