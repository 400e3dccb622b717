"""Gradient boosting for any number of classes, from histograms that Spark adds up.

Every round grows one tree a class on the gradients of the softmax loss. A level of all its trees costs one job: tasks add
up gradients per (tree node, input, bin) over their rows, and only these cells are shuffled. What reaches the driver is
bounded by the model's size: classes x nodes x inputs x bins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepipe.features.ensembles import Ensemble, quoted
from lakepipe.session import written

CELL = "tree int, node int, input int, bin int, gradient double, curvature double, rows long"


@dataclass(frozen=True)
class Settings:
    rounds: int = 20
    depth: int = 4
    bins: int = 32
    rate: float = 0.3
    least_rows: int = 1  # rows on each side of a split
    ridge: float = 1.0  # added to the curvature
    keep_every: int = 5  # rounds between stored margins


def bin_edges(df: DataFrame, inputs: Sequence[str], bins: int) -> list[list[float]]:
    """Upper edges of about equally full bins of each input (SQL), without the last."""
    shares = [i / bins for i in range(1, bins)]
    row = df.agg(
        *[F.percentile_approx(F.expr(f"CAST({x} AS DOUBLE)"), shares, 10_000).alias(f"e{i}") for i, x in enumerate(inputs)]
    ).first()
    # NaN ranks above every edge
    return [sorted({e for e in row[f"e{i}"] or [] if e == e}) for i in range(len(inputs))]


def _bin(value: str, edges: Sequence[float]):
    """Bin of an input: the number of edges below it; null and NaN fall into the last bin."""
    x = F.expr(f"CAST({value} AS DOUBLE)")
    if not edges:
        return F.lit(0).cast("short")
    bounds = F.array(*[F.lit(e) for e in edges])
    place = F.size(F.filter(bounds, lambda e: e < x))
    return F.when(x.isNull() | F.isnan(x), len(edges)).otherwise(place).cast("short")


class _Trees:
    """The trees of one round as they grow: node n has the children 2n + 1 and 2n + 2."""

    def __init__(self, count: int, depth: int):
        size = (1 << (depth + 1)) - 1
        self.input = np.full((count, size), -1, np.int64)
        self.bin = np.zeros((count, size), np.int64)
        self.value = np.zeros((count, size))

    def nodes(self, tree: int, bins: np.ndarray) -> np.ndarray:
        """Where the rows of ``bins`` (row, input) end up in a tree."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while True:
            split = self.input[tree][at]
            moving = split >= 0
            if not moving.any():
                return at
            high = bins[rows, np.maximum(split, 0)] > self.bin[tree][at]
            at = np.where(moving, 2 * at + 1 + high, at)


def _softmax(margins: np.ndarray) -> np.ndarray:
    raised = np.exp(margins - margins.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def _columns(batch: pa.RecordBatch, inputs: int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bins = np.asarray(batch.column(0).flatten()).reshape(-1, inputs).astype(np.int64)
    label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
    return bins, label, np.asarray(batch.column(2).flatten()).reshape(-1, classes)


def boost(
    df: DataFrame, label: str, inputs: Sequence[str], classes: int, settings: Settings = Settings()
) -> Ensemble:
    """Boosted trees for the classes 0 .. ``classes`` - 1 over numeric inputs, given as column names.

    Rows with a null label, or one outside the classes, are not learned from. A null or NaN input counts as greater than
    every number. The table is binned and stored once; every few rounds the margins of its rows are stored anew.
    """
    names = [quoted(c) for c in inputs]
    known = df.where(F.col(label).between(0, classes - 1)).select(
        F.col(label).cast("int").alias("label"), *[F.expr(f"CAST({n} AS DOUBLE)").alias(f"x{i}") for i, n in enumerate(names)]
    )
    edges = bin_edges(known, [f"x{i}" for i in range(len(names))], settings.bins)
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(counts.values())
    if not total:
        raise ValueError("no row with a known label")
    bases = np.log([max(counts.get(k, 0), 0.5) / total for k in range(classes)])
    binned = F.array(*[_bin(f"x{i}", e) for i, e in enumerate(edges)]).alias("bins")
    rows = written(known.select(binned, "label", F.array(*[F.lit(float(b)) for b in bases]).alias("margins")), "boost")
    kept: list[_Trees] = []
    pending: list[_Trees] = []
    for number in range(settings.rounds):
        trees = _Trees(classes, settings.depth)
        for level in range(settings.depth + 1):
            cells = _histogram(rows, pending, trees, level, len(names), classes)
            if not _grow(trees, level, cells, settings, classes):
                break
        kept.append(trees)
        pending.append(trees)
        if len(pending) == settings.keep_every and number + 1 < settings.rounds:
            rows = written(_moved(rows, pending, len(names), classes), "boost")
            pending = []
    grown = tuple(tuple(_as_tree(t, k, 0, edges) for t in kept) for k in range(classes))
    return Ensemble(tuple(f"CAST({n} AS DOUBLE)" for n in names), grown, tuple(map(float, bases)), "softmax", tuple(inputs))


def _margins(margins: np.ndarray, bins: np.ndarray, pending: Sequence[_Trees]) -> np.ndarray:
    margins = margins.copy()
    for trees in pending:
        for k in range(margins.shape[1]):
            margins[:, k] += trees.value[k][trees.nodes(k, bins)]
    return margins


def _moved(rows: DataFrame, pending: Sequence[_Trees], inputs: int, classes: int) -> DataFrame:
    """The rows with the margins that the pending trees add."""
    pending = list(pending)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, _, margins = _columns(batch, inputs, classes)
            moved = _margins(margins, bins, pending)
            flat = pa.ListArray.from_arrays(np.arange(0, moved.size + 1, classes, dtype=np.int32), moved.reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat], names=["bins", "label", "margins"])

    return rows.mapInArrow(move, "bins array<smallint>, label int, margins array<double>")


def _histogram(
    rows: DataFrame, pending: Sequence[_Trees], trees: _Trees, level: int, inputs: int, classes: int
) -> np.ndarray:
    """Rows of (tree, node, input, bin, gradient, curvature, rows) over the nodes of a level."""
    pending = list(pending)
    first, count = (1 << level) - 1, 1 << level

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: np.ndarray | None = None
        width = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            bins, label, margins = _columns(batch, inputs, classes)
            chances = _softmax(_margins(margins, bins, pending))
            width = max(width, int(bins.max()) + 1)
            if sums is None or sums.shape[-1] < width:
                grown = np.zeros((3, classes, count, inputs, width))
                if sums is not None:
                    grown[..., : sums.shape[-1]] = sums
                sums = grown
            for k in range(classes):
                node = trees.nodes(k, bins) - first
                here = (node >= 0) & (node < count)
                gradient = chances[here, k] - (label[here] == k)
                curvature = chances[here, k] * (1 - chances[here, k])
                weights = (gradient, curvature, np.ones(len(gradient)))
                for i in range(inputs):
                    cell = node[here] * sums.shape[-1] + bins[here, i]
                    for s, w in enumerate(weights):
                        sums[s, k, :, i] += np.bincount(cell, w, count * sums.shape[-1]).reshape(count, -1)
        if sums is not None:
            at = np.argwhere(sums[2] > 0)
            picked = sums[(slice(None), *at.T)]
            columns = [*[pa.array(at[:, j].astype(np.int32)) for j in range(4)], pa.array(picked[0]), pa.array(picked[1])]
            columns.append(pa.array(picked[2].astype(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "node", "input", "bin", "gradient", "curvature", "rows"])

    cells = rows.mapInArrow(add, CELL).groupBy("tree", "node", "input", "bin")
    summed = cells.agg(*[F.sum(c).alias(c) for c in ("gradient", "curvature", "rows")])
    # at most classes x nodes x inputs x bins rows
    return np.array([tuple(r) for r in summed.collect()], float).reshape(-1, 7)


def _grow(trees: _Trees, level: int, cells: np.ndarray, settings: Settings, classes: int) -> bool:
    """Split the nodes of a level where that lowers the loss, else make them leaves; says whether any was split."""
    first = (1 << level) - 1
    split = False
    for k in range(classes):
        for node in range(1 << level):
            held = cells[(cells[:, 0] == k) & (cells[:, 1] == node)]
            if not len(held):
                continue
            one = held[held[:, 2] == held[0, 2]]
            g, h = one[:, 4].sum(), one[:, 5].sum()
            trees.value[k, first + node] = -settings.rate * (classes - 1) / classes * g / (h + settings.ridge)
            if level == settings.depth:
                continue
            best = (1e-9, -1, 0)
            for i in np.unique(held[:, 2]).astype(int):
                own = held[held[:, 2] == i]
                own = own[np.argsort(own[:, 3])]
                low = np.cumsum(own[:, 4:7], axis=0)[:-1]
                high = own[:, 4:7].sum(axis=0) - low
                gain = low[:, 0] ** 2 / (low[:, 1] + settings.ridge) + high[:, 0] ** 2 / (high[:, 1] + settings.ridge)
                gain = gain - g * g / (h + settings.ridge)
                gain[(low[:, 2] < settings.least_rows) | (high[:, 2] < settings.least_rows)] = -np.inf
                if len(gain) and gain.max() > best[0] + 1e-9:
                    best = (float(gain.max()), int(i), int(own[int(gain.argmax()), 3]))
            if best[1] >= 0:
                trees.input[k, first + node], trees.bin[k, first + node] = best[1:]
                split = True
    return split


def _as_tree(trees: _Trees, k: int, node: int, edges: Sequence[Sequence[float]]):
    at = int(trees.input[k, node])
    if at < 0:
        return float(trees.value[k, node])
    # bins up to b hold what is at or below edge b
    low, high = (_as_tree(trees, k, 2 * node + side, edges) for side in (1, 2))
    return (at, float(edges[at][int(trees.bin[k, node])]), low, high)
