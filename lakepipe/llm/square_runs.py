"""Periodic runs of words, found by catching squares in dyadic blocks as words are appended.

On level H (1, 2, 4, ...) every completed block of H words that starts at a multiple of H opens a catcher: it holds the
fingerprint of the 2H words from its start on and waits for the periods q with H < q <= 2H. Each appended word completes
one suffix of 2H words; its fingerprint is compared with that of the one catcher whose start lies q words back. If they
agree, the two spans form a square of half-length q. The comparison looks at earlier words only, so numpy does it for all
words of a batch of texts at once, a level at a time. Squares of one period that overlap by a period merge, are proved and
widened word by word, and what is long enough is a run. Squares inside a run of a smaller period say nothing new and are
dropped before they merge.

A run with at least four periods of q words holds a span of q + 2H words that starts at a multiple of H: none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import compress, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words whose squares are looked for at a time; a longer text is looked through on its own, whole.
BATCH_WORDS = 400_000
LEAST_EXPONENT = 4

Run = tuple[int, int, int]  # start, length, period

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _mixed(ids: np.ndarray) -> np.ndarray:
    """Numbers that look random, one for each id."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Suffixes:
    """Fingerprints of all spans of a given length: equal spans agree, different ones nearly always differ."""

    BASE = 0xD1342543DE82EF95
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, ids: np.ndarray):
        def powers(base: int) -> np.ndarray:
            line = np.full(len(ids), base, np.uint64)
            line[:1] = 1
            return np.cumprod(line, dtype=np.uint64)

        self._sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(_mixed(ids) * powers(self.BASE), dtype=np.uint64, out=self._sums[1:])
        self._back = powers(self.INVERSE)

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        return (self._sums[starts + length] - self._sums[starts]) * self._back[starts]


def _agreeing(ids: np.ndarray, at: int, period: int, limit: int, step: int) -> int:
    """How far ``ids[i] == ids[i + period]`` goes on from ``at``, forwards (step 1) or backwards (step -1)."""
    done, width = 0, 64
    while done < limit:
        width = min(width * 2, limit - done)
        low = at + done if step > 0 else at - done - width + 1
        same = ids[low : low + width] == ids[low + period : low + width + period]
        if not same.all():
            return done + int(np.argmin(same if step > 0 else same[::-1]))
        done += width
    return done


def _stretches(same: np.ndarray) -> np.ndarray:
    """(first, end) of the stretches of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    return edges.reshape(-1, 2)


def find_runs(ids: np.ndarray, bounds: np.ndarray, least: int) -> list[Run]:
    """Runs of at least four periods and ``least`` words in texts laid end to end, by place.

    Text k is ``ids[bounds[k]:bounds[k + 1]]``; equal numbers are equal words. Starts count from the first text's start.
    """
    ids = np.ascontiguousarray(ids, np.int64)
    sizes = np.diff(bounds)
    first, size = np.repeat(bounds[:-1], sizes), np.repeat(sizes, sizes)
    covered = np.zeros(len(ids), np.int64)  # end of the farthest run found so far over each word
    found: set[Run] = set()

    def keep(start: int, end: int, period: int) -> None:
        # what a run of a smaller period covers whole has that period itself
        if end - start >= LEAST_EXPONENT * period and covered[start] < end:
            found.add((start, end - start, period))
            covered[start:end] = np.maximum(covered[start:end], end)

    if len(ids) > 1:
        for a, b in _stretches((ids[1:] == ids[:-1]) & (first[1:] == first[:-1])):
            keep(int(a), int(b) + 1, 1)
    suffixes = Suffixes(ids)
    places = np.arange(len(ids))
    level = 0
    while True:
        block = 1 << level
        places = places[size[places] >= LEAST_EXPONENT * (block + 1)]
        if not len(places):
            break
        gone = places - first[places]
        new = places[(gone > block) & (gone + 2 * block <= size[places])]
        start = first[new] + (((new - first[new] - block - 1) >> level) << level)
        caught = suffixes.of(start, 2 * block) == suffixes.of(new, 2 * block)
        start, new = start[caught], new[caught]
        fresh = covered[start] < new + 2 * block
        start, new = start[fresh], new[fresh]
        if len(start):
            period = new - start
            order = np.lexsort((start, period))
            start, period = start[order], period[order]
            end = start + period + 2 * block
            apart = np.ones(len(start), bool)
            apart[1:] = (period[1:] != period[:-1]) | (start[1:] + period[1:] > end[:-1])
            heads = np.flatnonzero(apart)
            tails = np.append(heads[1:], len(start)) - 1
            for a, b, q in zip(start[heads].tolist(), end[tails].tolist(), period[heads].tolist()):
                low, high = int(first[a]), int(first[a] + size[a])
                # true all along, but for fingerprints that agree by chance
                for x, y in _stretches(ids[a : b - q] == ids[a + q : b]).tolist():
                    left = _agreeing(ids, a + x - 1, q, a + x - low, -1)
                    right = _agreeing(ids, a + y, q, high - q - a - y, 1)
                    keep(a + x - left, a + y + q + right, q)
        level += 1
    return sorted(r for r in found if r[1] >= least)


def collapse_runs(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, carry: tuple[str, ...] = ()
) -> DataFrame:
    """Periodic runs of each row's words, and its text without the repeats.

    Words are what stands between ASCII blanks, numbered from 0. A run is a stretch in which words ``period`` apart are
    equal, with the smallest such period, at least four periods and ``least`` words long, as wide as it can be. Returns
    the id, columns named in ``carry``, ``n_runs``, of the run with the most periods (ties: smallest start, then period)
    ``start``, ``length``, ``period`` and ``exponent_milli`` (null without a run), ``runs`` (by start, then period) and
    ``collapsed``: the words that no run holds behind its first period, joined by one blank.

    Null and empty text has no words: no run, collapsed text empty. Rows are judged one by one, so that repeated rows and
    null ids keep their place. A row takes time by length times its logarithm and memory by length, in one task.
    """
    names = ["id", *[f"c{i}" for i in range(len(carry))]]
    top = ["n_runs", "start", "length", "period", "exponent_milli"]
    batch_words = BATCH_WORDS

    def groups(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
        held, size = [], 0
        for text in texts:
            words = (text or b"").split()
            if held and size + len(words) > batch_words:
                yield held
                held, size = [], 0
            held.append(words)
            size += len(words)
        if held:
            yield held

    def per_text(texts: list[list[bytes]]) -> Iterator[list[Run]]:
        number: dict[bytes, int] = {}
        fresh = count()
        bounds = np.concatenate(([0], np.cumsum([len(words) for words in texts]))).astype(np.int64)
        ids = np.fromiter((n for words in texts for n in map(number.setdefault, words, fresh)), np.int64, bounds[-1])
        runs = find_runs(ids, bounds, least)
        at = np.searchsorted([r[0] for r in runs], bounds)
        for k in range(len(texts)):
            yield [(a - int(bounds[k]), n, q) for a, n, q in runs[at[k] : at[k + 1]]]

    def judged(words: list[bytes], runs: list[Run]) -> tuple:
        if not runs:
            return 0, None, None, None, None, [], b" ".join(words)
        keep = np.ones(len(words), bool)
        for a, n, q in runs:
            keep[a + q : a + n] = False
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))
        rows = [dict(zip(("start", "length", "period"), r)) for r in runs]
        return len(runs), *best, 1000 * best[1] // best[2], rows, b" ".join(compress(words, keep.tolist()))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
        kinds = [pa.int64()] * len(top) + [pa.list_(one), pa.binary()]
        for batch in batches:
            at = 0
            for texts in groups(batch.column(len(names)).cast(pa.binary()).to_pylist()):
                found = [judged(words, runs) for words, runs in zip(texts, per_text(texts))]
                columns = [pa.array(column, kind) for column, kind in zip(zip(*found), kinds)]
                columns[-1] = columns[-1].cast(pa.string())
                given = [column.slice(at, len(texts)) for column in batch.columns[:-1]]
                at += len(texts)
                yield pa.RecordBatch.from_arrays([*given, *columns], names=[*names, *top, "runs", "collapsed"])

    picked = [F.col(f"`{c}`").alias(n) for n, c in zip(names, [id_col, *carry])]
    given = docs.select(*picked, F.make_valid_utf8(F.col(f"`{text_col}`").cast("string")).alias("text"))
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    shape += "".join(f", {n} long" for n in top) + f", runs {RUNS}, collapsed string"
    return given.mapInArrow(find, shape).withColumnsRenamed(dict(zip(names, [id_col, *carry])))
