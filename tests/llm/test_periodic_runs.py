"""Periodic runs against a search over all periods and places."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from text_fixtures import make  # noqa: F401

from lakepipe.llm import queries, square_runs


def runs_of(words, least=6):
    """Every run by definition: widest stretches of each period whose smallest period it is."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(least, 4 * q):
                piece = words[i : i + length]
                if not any(all(piece[x] == piece[x + p] for x in range(length - p)) for p in range(1, q)):
                    found.append((i, length, q))
            i = j + 1
    return sorted(found)


def collapsed(words, runs):
    gone = {x for a, n, q in runs for x in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def laid(texts):
    return np.array([w for t in texts for w in t], np.int64), np.cumsum([0, *map(len, texts)])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=4))
def test_equals_definition_on_few_words(texts):
    ids, bounds = laid(texts)
    expected = [(a + int(bounds[k]), n, q) for k, t in enumerate(texts) for a, n, q in runs_of(t)]
    assert square_runs.find_runs(ids, bounds, 6) == expected


def test_equals_definition_on_planted_periods():
    rng = random.Random(5)
    texts = []
    for _ in range(150):
        t = []
        for _ in range(rng.randint(1, 5)):
            unit = [rng.randint(0, rng.choice([1, 3, 500])) for _ in range(rng.randint(1, 40))]
            more = unit * rng.randint(1, 9)
            t += more[: len(more) - rng.randint(0, len(unit))] + [rng.randint(0, 500) for _ in range(rng.randint(0, 9))]
        texts.append(t)
    ids, bounds = laid(texts)
    expected = [(a + int(bounds[k]), n, q) for k, t in enumerate(texts) for a, n, q in runs_of(t)]
    assert len(expected) > 200
    assert square_runs.find_runs(ids, bounds, 6) == expected


def test_fingerprints_that_agree_by_chance_change_nothing(monkeypatch):
    monkeypatch.setattr(square_runs, "_mixed", lambda ids: (ids % 2).astype(np.uint64))
    rng = random.Random(8)
    texts = [[rng.randint(0, 3) for _ in range(rng.randint(0, 80))] + [rng.randint(0, 3)] * rng.randint(0, 9) for _ in range(60)]
    ids, bounds = laid(texts)
    expected = [(a + int(bounds[k]), n, q) for k, t in enumerate(texts) for a, n, q in runs_of(t)]
    assert square_runs.find_runs(ids, bounds, 6) == expected


@pytest.mark.parametrize("period", [1, 2, 3, 1000, 4097])
def test_long_runs(period):
    unit = list(range(period))
    text = [-1, *(unit * (40_000 // period + 5)), -2]
    length = len(text) - 2
    assert square_runs.find_runs(*laid([text]), 6) == [(1, length, period)]


def test_rows(spark, make):
    texts = [
        (1, "a b " * 4), (1, "a b " * 4), (2, None), (3, ""), (4, " \n\t "), (None, "x x x x x x"), (5, "x x x x x"),
        (6, "q r " * 9), (7, "a a a a a a b c c c c c c"), (8, "w " * 300_000), (9, "x" * 300_000), (10, "x\x00 " * 8),
    ]
    docs = make(texts).selectExpr("*", "1 AS n_runs", "2 AS start", "3 AS runs", "4 AS id", "5 AS c0", "lang AS collapsed")
    out = square_runs.collapse_runs(docs, carry=("source",)).collect()
    assert len(out) == len(texts)
    for (i, text), row in zip(sorted(texts, key=lambda x: x[0] or 0), sorted(out, key=lambda r: r.doc_id or 0)):
        words = [w.decode() for w in (text or "").encode().split()]
        if len(words) > 1000:
            expected = [(0, len(words), 1)]
        else:
            expected = runs_of(words)
        assert row.source == "s" and row.doc_id == i
        assert [tuple(r) for r in row.runs] == expected and row.n_runs == len(expected)
        assert row.collapsed == collapsed(words, expected)
        if expected:
            a, n, q = min(expected, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
            assert (row.start, row.length, row.period, row.exponent_milli) == (a, n, q, 1000 * n // q)
        else:
            assert (row.start, row.length, row.period, row.exponent_milli) == (None,) * 4
    assert square_runs.collapse_runs(docs.limit(0)).collect() == []


def test_small_batches(spark, make, monkeypatch):
    rng = random.Random(1)
    texts = {i: " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for i in range(200)}
    whole = {r.doc_id: r for r in square_runs.collapse_runs(make(texts)).collect()}
    monkeypatch.setattr(square_runs, "BATCH_WORDS", 25)
    assert {r.doc_id: r for r in square_runs.collapse_runs(make(texts)).collect()} == whole
    for i, t in texts.items():
        assert [tuple(r) for r in whole[i].runs] == runs_of(t.split())


def test_query(spark, sf_dir):
    out = {r.doc_id: r for r in queries.op11_periodic_runs(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(out) == len(docs)
    with_runs = 0
    for d in docs:
        words = [w.decode() for w in (d.text or "").encode().split()]
        n, h = len(words), zlib.crc32(str(d.doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        row = out[d.doc_id]
        if n > 3000:
            found = [tuple(x) for x in square_runs.find_runs(*laid([[hash(w) for w in words]]), 6)]
        else:
            found = runs_of(words)
        with_runs += bool(found)
        lines = "".join(f"{a},{m},{q}\n" for a, m, q in found)
        assert row.n_runs == len(found)
        assert row.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(collapsed(words, found).encode()).hexdigest()
    assert with_runs > 5
