"""What each of several filters removes, in every order they could be applied in.

Documents are reduced to the set of filters they fail. For each set and each order the step that removes it is a min-plus
product: a mask matrix (0 where the set fails a filter, else infinite) times the positions of the filters in the orders
(the inverse permutations), added and combined by minimum. The removal steps scatter the documents' counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepipe.llm.common import let, stored

#: More filters than that have too many orders to list.
MAX_FILTERS = 7
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def removal_steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(orders, steps): the orders of n filters, and for each set of failed filters (as bits) and order the step that
    removes it, from 0; n where nothing does."""
    orders = np.array(list(permutations(range(n))), np.int64)
    positions = np.argsort(orders, axis=1)
    masks = np.where(np.arange(1 << n)[:, None] >> np.arange(n) & 1, 0, n)
    steps = np.full((1 << n, len(orders)), n, np.int64)
    for f in range(n):
        np.minimum(steps, masks[:, f, None] + positions[None, :, f], out=steps)
    return orders, steps


def tabulate(counts: np.ndarray, orders: np.ndarray, steps: np.ndarray) -> dict[str, np.ndarray]:
    """The measures, shaped (part, order, step), from documents, good and toxic ones by (3, part, failed set)."""
    n, sets = orders.shape[1], np.arange(len(steps))
    parts = counts.shape[1]
    at = np.arange(n)
    here = (steps[:, :, None] == at).reshape(len(sets), -1).astype(np.int64)
    fails = (sets[:, None, None] >> orders[None]) & 1
    earlier = (fails * (steps[:, :, None] < at)).reshape(len(sets), -1)
    shape = (parts, *orders.shape)
    removed, good, toxic = ((c @ here).reshape(shape) for c in counts)
    by_filter = np.zeros((parts, n), np.int64)
    for f in range(n):
        by_filter[:, f] = removed[:, orders == f].sum(axis=1)
    return {
        "kept": counts[0].sum(axis=1)[:, None, None] - np.cumsum(removed, axis=2),
        "removed": removed,
        "redundant": (counts[0] @ earlier).reshape(shape),
        "unique_fails": counts[0][:, 1 << orders],
        "good_lost": good,
        "toxic_lost": toxic,
        "shapley": by_filter[:, orders],
    }


def word_checks(text: Column) -> dict[str, Column]:
    """Four failure conditions on a text: short, repetitive, shouting, marked up. Conditions are never null."""

    def on_words(words: Column) -> Column:
        n, distinct = F.size(words), F.size(F.array_distinct(words))
        return F.struct((n < 200).alias("short"), (100 * distinct < 50 * n).alias("repetitive"))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    by_words = let(words, on_words)
    return {
        "A": by_words["short"],
        "B": by_words["repetitive"],
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def audit_filters(
    docs: DataFrame,
    labels: DataFrame,
    checks: Mapping[str, Column] | None = None,
    copies: str = "E",
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "source",
) -> DataFrame:
    """One row per part, order of the filters and step, zeros included, with counts of the part's documents.

    ``checks`` names failure conditions over the column ``text`` (by default four); ``copies`` names one more: the text is
    that of a row with a smaller id, anywhere in the table, whatever other filters remove. Texts are compared by SHA-256.
    Counts: ``kept`` after the step, ``removed`` by it, ``redundant`` (fail its filter but went earlier), ``unique_fails``
    (fail no other), ``good_lost`` and ``toxic_lost`` (removed here and so labelled), ``shapley`` (what its filter removes,
    summed over all orders). Null text counts as empty, a null part as the empty one. A row with a null id is no copy, has
    no copies and no label. Rows that repeat id and text all count; none is a copy of the other. A document with several
    label rows has a label if one of them says so. Empty tables give no row. Other columns are not read.

    Texts are read once; what is left of each, some fifty bytes, is stored before it is joined.
    """
    text = F.col("text")
    checks = dict(checks or word_checks(text))
    filters = [*checks, copies]
    if len(filters) > MAX_FILTERS or len(set(filters)) < len(filters):
        raise ValueError(f"between 1 and {MAX_FILTERS} filters with different names, not {filters}")
    bits = [F.when(check, 1 << i).otherwise(0) for i, check in enumerate(checks.values())]
    given = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    facts = stored(
        given.select("id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits, F.lit(0)).alias("fails")),
        "filter-facts",
    )
    firsts = facts.where("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    marks = labels.select(
        F.col(f"`{id_col}`").alias("id"),
        *[F.coalesce(F.col(c) == 1, F.lit(False)).cast("int").alias(c) for c in ("quality", "toxic")],
    )
    marks = marks.where("id IS NOT NULL").groupBy("id").agg(F.max("quality").alias("good"), F.max("toxic").alias("toxic"))
    copied = F.when(F.col("id").isNotNull() & F.col("first").isNull(), 1 << len(checks)).otherwise(0)
    sets = (
        facts.join(marks, "id", "left")
        .join(firsts, ["id", "digest"], "left")
        .groupBy("part", (F.col("fails") + copied).alias("fails"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.coalesce("good", F.lit(0))).alias("good"),
            F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"),
        )
    )
    # at most 2 ** filters entries each
    parts = sets.groupBy("part").agg(F.collect_list(F.struct("fails", "n", "good", "toxic")).alias("sets"))
    return parts.mapInArrow(
        _rows_of(filters), "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES)
    )


def _rows_of(filters: list[str]):
    orders, steps = removal_steps(len(filters))
    names = np.array(["".join(filters[f] for f in order) for order in orders.tolist()])
    tables, measures = tabulate, MEASURES

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(orders) * len(filters)
        per_batch = max(1, 60_000 // n)
        for whole in batches:
            for at in range(0, whole.num_rows, per_batch):
                batch = whole.slice(at, per_batch)
                counts = np.zeros((3, batch.num_rows, len(steps)), np.int64)
                for k, held in enumerate(batch.column(1).to_pylist()):
                    for entry in held:
                        counts[:, k, entry["fails"]] += (entry["n"], entry["good"], entry["toxic"])
                found = tables(counts, orders, steps)
                columns = [
                    pa.array(np.repeat(np.array(batch.column(0).to_pylist(), object), n), pa.string()),
                    pa.array(np.tile(np.repeat(names, len(filters)), batch.num_rows), pa.string()),
                    pa.array(np.tile(np.arange(1, len(filters) + 1), len(orders) * batch.num_rows), pa.int32()),
                    *[pa.array(found[m].reshape(-1), pa.int64()) for m in measures],
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *measures])

    return rows
