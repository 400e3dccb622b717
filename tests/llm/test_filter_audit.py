"""Filter audit against filters that are really applied one after the other."""

from __future__ import annotations

from collections import defaultdict
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from lakepipe.llm import filter_audit

DOCS = "doc_id long, text string, source string, part string, id int, digest string, good int, first string"
LABELS = "doc_id long, quality int, toxic int, id int"


def failing(docs):
    """Filters each row fails, by their definitions."""
    firsts = {}
    for i, text, *_ in docs:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    for i, text, *_ in docs:
        text = text or ""
        words = [w for w in text.encode().split()]
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text):
            fails.add("C")
        if set(text) & set("#$%&*|"):
            fails.add("D")
        if i is not None and i > firsts[text]:
            fails.add("E")
        yield fails


def audited(docs, labels):
    good, toxic = ({i for i, *marks in labels if i is not None and marks[k] == 1} for k in (0, 1))
    parts = defaultdict(list)
    for (i, _, part, *_), fails in zip(docs, failing(docs)):
        parts[part or ""].append((i, fails))
    rows = {}
    for part, held in parts.items():
        shapley = defaultdict(int)
        for order in map("".join, permutations("ABCDE")):
            left = list(held)
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                failed = sum(f in x[1] for x in held)
                rows[part, order, step] = [
                    len(left), len(gone), failed - len(gone), sum(x[1] == {f} for x in held),
                    sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), f,
                ]
        for key, row in rows.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return {k: tuple(v) for k, v in rows.items()}


LONG = " ".join(f"w{i}" for i in range(250))
ROWS = [
    (1, "short", "a"), (2, "short", "b"), (2, "short", "b"), (3, "short", "a"), (None, "short", "a"), (4, None, None), (5, "", "c"),
    (6, LONG, "a"), (7, LONG, "a"), (8, LONG + "#", "a"), (9, "x " * 300, "b"), (10, LONG.upper(), "b"), (11, "x y " * 100, ""),
    (12, LONG + " " + LONG, "c"), (13, LONG.replace(" ", "\n\v"), "c"), (14, LONG.replace(" ", " "), "c"), (None, None, "d"),
    (15, "AB" + "c" * 98, "d"), (16, "ABC" + "c" * 98, "d"), (17, "\U0001f600" * 98 + "AB", "d"), (18, "q " * 200_000, "d"),
    (19, " ".join(f"w{i}" for i in range(199)), "d"), (20, " ".join(f"w{i}" for i in range(200)) + " ", "d"),
    (21, " ".join(f"w{i % 100}" for i in range(200)), "d"), (22, " ".join(f"w{i % 100}" for i in range(201)), "d"),
]
MARKS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (3, 1, 1), (6, 1, 0), (7, 1, 1), (8, None, 1), (99, 1, 1), (None, 1, 1), (18, 0, 1)]


def tables(spark):
    docs = spark.createDataFrame([(*r, "clash", 1, "x", 1, "y") for r in ROWS], DOCS)
    return docs, spark.createDataFrame([(*m, 1) for m in MARKS], LABELS)


def test_equals_filters_applied_in_order(spark):
    docs, labels = tables(spark)
    out = filter_audit.audit_filters(docs, labels)
    found = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in out.collect()}
    expected = audited(ROWS, MARKS)
    assert found == expected and len(found) == out.count() == 600 * 5


def test_empty_tables(spark):
    docs, labels = tables(spark)
    assert filter_audit.audit_filters(docs.limit(0), labels).collect() == []
    without = filter_audit.audit_filters(docs, labels.limit(0))
    assert without.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0
    assert without.count() == 3000


def test_own_checks(spark):
    docs, labels = tables(spark)
    out = filter_audit.audit_filters(docs, labels, {"L": F.length("text") > 100}, copies="K").where("part = 'a'")
    found = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in out.collect()}
    # of part a: 1 and null are short, 3 is a copy, 6, 7, 8 are long, 7 is a copy besides
    assert found == {
        ("LK", 1): (3, 3, 0, 2, 5), ("LK", 2): (2, 1, 1, 1, 3), ("KL", 1): (4, 2, 0, 1, 3), ("KL", 2): (2, 2, 1, 2, 5),
    }


def test_removal_steps_are_the_least_positions():
    orders, steps = filter_audit.removal_steps(4)
    for mask in range(16):
        for p, order in enumerate(orders.tolist()):
            assert steps[mask, p] == next((s for s, f in enumerate(order) if mask >> f & 1), 4)
    assert np.array_equal(np.sort(orders, axis=1), np.tile(np.arange(4), (24, 1)))
