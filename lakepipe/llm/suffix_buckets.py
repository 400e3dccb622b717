"""Removal of long byte strings that occur elsewhere, by bucket-pointer refinement on sampled suffixes.

Only some suffixes are sorted: those that start at an anchor, the place of the least hash among the next ``reach`` grams.
Every string of ``length`` bytes has one anchor near its start, the same wherever the string occurs, with at least
``q = length - reach`` bytes of the string behind it.

* First buckets: anchors are grouped by the q-gram at the anchor. Single ones are settled and leave.
* Refinement: the strings that share an anchor lie in one stretch of text, named by the bucket identifiers at its start
  and at later offsets. In a bucket of several stretches, those whose name occurs again are covered whole; one stretch of
  each name stays open.
* The same rule again on what is open, with finer stretches (``BLOCK`` strings next to one another), whose bucket is
  what all their strings have in common; and a last time on single strings, where bucket and name are the same.

A bucket identifier is a hash of its q bytes, so it can be worked out at any offset where the text is; what is compared
is always several of them. Each round handles only what the one before has left open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepipe.llm.common import join_rows, keyed, stored

GRAM = 16
BLOCK = 8
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


class Hasher:
    """Hashes of any byte span of a text in constant time, from running sums of its bytes times powers."""

    def __init__(self) -> None:
        self.powers = self.inverse = np.ones(1, dtype=np.uint64)

    def load(self, body: bytes) -> None:
        size = len(body)
        if len(self.powers) <= size:
            count = max(2 * len(self.powers), size + 1)
            self.powers, self.inverse = (_running(base, count) for base in (_BASE, pow(_BASE, -1, 2**64)))
        self.sums = np.zeros(size + 1, dtype=np.uint64)
        values = np.frombuffer(body, dtype=np.uint8).astype(np.uint64)
        values += np.uint64(1)
        values *= self.powers[:size]
        np.cumsum(values, out=self.sums[1:])

    def spans(self, starts: np.ndarray, size: int) -> np.ndarray:
        """Bucket identifiers of the ``size`` bytes from each start."""
        return _mixed((self.sums[starts + size] - self.sums[starts]) * self.inverse[starts])

    def all_spans(self, size: int) -> np.ndarray:
        count = len(self.sums) - size
        return _mixed((self.sums[size:] - self.sums[:count]) * self.inverse[:count])


def _running(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _mixed(values: np.ndarray) -> np.ndarray:
    values ^= values >> _HALF
    values *= _MIX
    values ^= values >> _HALF
    return values


def anchors(hasher: Hasher, size: int, length: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last): the strings that start at first .. last have this anchor."""
    starts = size - length + 1
    grams = hasher.all_spans(GRAM)[: starts + reach - 1]
    least = (grams & ~np.uint64(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64)  # of equal ones the first
    width = 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    spot = (least[:starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    turns = np.flatnonzero(np.diff(spot)) + 1
    first = np.concatenate([[0], turns])
    last = np.concatenate([turns - 1, [starts - 1]])
    return spot[first], first, last


def names(hasher: Hasher, starts: np.ndarray, sizes: np.ndarray, q: int) -> np.ndarray:
    """Names of the spans (start, size): their size and the bucket identifiers at the start and every q bytes on."""
    name = hasher.spans(starts, q)
    last = sizes - q
    offset = 0
    while offset < last.max(initial=0):
        offset += q
        name = _mixed(name * np.uint64(_BASE) + hasher.spans(starts + np.minimum(offset, last), q))
    return _mixed(name * np.uint64(_BASE) + sizes.astype(np.uint64))


def _bytes(text) -> bytes:
    return text.as_buffer().to_pybytes() if text.is_valid else b""


BUCKET = "bucket long"
SPOT = "first int, last int, anchor int"
STRETCH = "struct<first:int,last:int,anchor:int>"


def _rows_of(rows: DataFrame, kind: str, made, schema: str, extra: str | None = None) -> DataFrame:
    """Arrays that ``made(hasher, body, extra value)`` gives for each text, as rows with the text's key.

    ``schema`` names the arrays; ``extra`` is a column of ``rows`` handed to ``made``, texts without it are passed over.
    Arrays called ``bucket`` alone come without keys.
    """
    fields = [f.split() for f in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32()}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            extras = batch.column(extra).to_pylist() if extra else [()] * len(batch)
            counted: list[pa.Array] = []
            for i, text in enumerate(batch.column("_text")):
                arrays = made(hasher, _bytes(text), extras[i])
                if arrays is None:
                    continue
                columns = [pa.array(a.view(np.int64) if a.dtype == np.uint64 else a).cast(types[t])
                           for a, (_, t) in zip(arrays, fields, strict=True)]
                if schema == BUCKET:
                    counted.append(columns[0])
                    continue
                at = pa.array(np.full(len(arrays[0]), i))
                columns += [batch.column("_id").take(at), batch.column("_h").take(at)]
                yield pa.RecordBatch.from_arrays(columns, [*(n for n, _ in fields), "_id", "_h"])
            if counted:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(counted)], ["bucket"])

    return rows.mapInArrow(find, schema if schema == BUCKET else f"{schema}, _id {kind}, _h long")


def _anchor_rows(rows: DataFrame, kind: str, length: int, reach: int, schema: str) -> DataFrame:
    """First round: (bucket, name, first, last, anchor) of every anchor of the texts of at least ``length`` bytes; with
    ``BUCKET`` the buckets alone."""
    q = length - reach

    def made(hasher: Hasher, body: bytes, _):
        if len(body) < length:
            return None
        hasher.load(body)
        anchor, first, last = anchors(hasher, len(body), length, reach)
        if schema == BUCKET:
            return (hasher.spans(anchor, q),)
        name = names(hasher, first, last - first + length, q)
        name = _mixed(name * np.uint64(_BASE) + (anchor - first).astype(np.uint64))
        return hasher.spans(anchor, q), name, first, last, anchor

    return _rows_of(rows, kind, made, schema)


def _block_rows(cand: DataFrame, kind: str, length: int, reach: int, schema: str) -> DataFrame:
    """Second round: the same of each block of ``BLOCK`` strings, counted back from the anchor.

    Blocks start at the same distance from the anchor wherever they occur. A block that sticks out of its text has a name
    of its own.
    """
    q = length - reach

    def made(hasher: Hasher, body: bytes, spans):
        if not spans:
            return None
        hasher.load(body)
        low, high, anchor = (np.array([s[c] for s in spans], dtype=np.int64) for c in ("first", "last", "anchor"))
        near, far = (anchor - high) // BLOCK, (anchor - low) // BLOCK
        count = far - near + 1
        own = np.repeat(np.arange(len(spans)), count)
        step = near[own] + np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
        stop = anchor[own] - step * BLOCK  # start of the block's last string
        start = stop - (BLOCK - 1)
        bucket = names(hasher, stop, np.full(len(stop), length - BLOCK + 1), q)
        if schema == BUCKET:
            return (bucket,)
        inside = (start >= 0) & (stop + length <= len(body))
        name = _mixed(bucket + np.uint64(_BASE) * (start + 1).astype(np.uint64) + hasher.sums[-1:])
        name[inside] = names(hasher, start[inside], np.full(inside.sum(), length + BLOCK - 1), q)
        return bucket, name, np.maximum(start, low[own]), np.minimum(stop, high[own]), anchor[own]

    return _rows_of(cand, kind, made, schema, "open")


def _string_rows(cand: DataFrame, kind: str, length: int, reach: int) -> DataFrame:
    """Last round: (one, two, first) of each single string."""
    q = length - reach

    def made(hasher: Hasher, body: bytes, spans):
        if not spans:
            return None
        hasher.load(body)
        place = np.unique(np.concatenate([np.arange(s["first"], s["last"] + 1) for s in spans]))
        return hasher.spans(place, q), hasher.spans(place + (length - q), q), place

    return _rows_of(cand, kind, made, "one long, two long, first int", "open")


def _refine(made: Callable[[str], DataFrame], label: str) -> tuple[DataFrame, DataFrame]:
    """(covered, open) of a round's rows: stretches whose name occurs again, and one of each name in a mixed bucket.

    ``made`` gives the rows with a schema's columns: the pass that counts buckets works out nothing else.
    Buckets and names are counted by aggregates with a map side and joined back, so that Spark's skew join can cut up a
    bucket which holds very many rows.
    """
    shared = made(BUCKET).groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    live = stored(made(f"{BUCKET}, name long, {SPOT}").join(shared, "bucket"), label)
    kinds = live.groupBy("bucket").agg(F.min("name").alias("lo"), F.max("name").alias("hi"))
    mixed = kinds.where("lo != hi").select("bucket")
    even = live.join(kinds.where("lo = hi").select("bucket"), "bucket")
    uneven = live.join(mixed, "bucket")
    here = F.struct("_id", "_h", "first", "last", "anchor")
    names_in = uneven.groupBy("bucket", "name").agg(F.count("*").alias("n"), F.min(here).alias("chosen"))
    stretch = F.struct("first", "last", "anchor").alias("stretch")
    covered = even.select("_id", "_h", stretch).unionByName(
        uneven.join(names_in.where("n > 1").select("bucket", "name"), ["bucket", "name"]).select("_id", "_h", stretch)
    )
    left = names_in.select(
        F.col("chosen._id").alias("_id"),
        F.col("chosen._h").alias("_h"),
        F.struct("chosen.first", "chosen.last", "chosen.anchor").alias("stretch"),
    )
    return covered, left


def _per_text(covered: DataFrame, left: DataFrame) -> DataFrame:
    """(_id, _h, full, open): the stretches of each text."""
    both = covered.select("_id", "_h", F.col("stretch").alias("f"), F.lit(None).cast(STRETCH).alias("o")).unionByName(
        left.select("_id", "_h", F.lit(None).cast(STRETCH).alias("f"), F.col("stretch").alias("o"))
    )
    return both.groupBy("_id", "_h").agg(F.collect_set("f").alias("full"), F.collect_set("o").alias("open"))




def removed_runs(full, places, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes under whole stretches (first, last) and single strings."""
    spans = sorted([(s["first"], s["last"] + length) for s in full] + [(p, p + length) for p in places])
    out: list[list[int]] = []
    for start, stop in spans:
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, reach: int = 200
) -> DataFrame:
    """(_id, _h, runs, kept) of the texts with a string of ``length`` bytes that starts anywhere else too.

    ``runs`` are the maximal removed runs (start, stop) in bytes, ``kept`` what is left, as bytes. Rows repeated with the
    same id and text are separate texts here: each is a repeat of the other. They come out once.
    """
    if not GRAM <= reach <= length // 2:
        raise ValueError("reach must be at least a gram and at most half of the length")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = keyed(docs, id_col, text_col)
    covered, left = _refine(lambda schema: _anchor_rows(rows, kind, length, reach, schema), "anchors")
    cand = stored(join_rows(rows, _per_text(covered, left)).dropDuplicates(["_id", "_h"]), "texts")

    undecided = cand.where(F.size("open") > 0)
    covered, left = _refine(lambda schema: _block_rows(undecided, kind, length, reach, schema), "blocks")
    finer = stored(_per_text(covered, left).withColumnsRenamed({"full": "blocks", "open": "still"}), "finer")

    still = join_rows(cand.select("_id", "_h", "_text"), finer.where(F.size("still") > 0).select("_id", "_h", "still"))
    strings = _string_rows(still.withColumnRenamed("still", "open"), kind, length, reach)
    twice = strings.groupBy("one", "two").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    places = strings.join(twice, ["one", "two"]).groupBy("_id", "_h").agg(F.collect_set("first").alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, left = [], []
            given = ("_text", "full", "blocks", "places")
            for text, full, blocks, spots in zip(*(batch.column(c) for c in given), strict=True):
                whole = [*(full.as_py() or ()), *(blocks.as_py() or ())]
                gone = removed_runs(whole, spots.as_py() or (), length)
                body, at, parts = _bytes(text), 0, []
                for start, stop in gone:
                    parts.append(body[at:start])
                    at = stop
                runs.append([{"start": a, "stop": b} for a, b in gone])
                left.append(b"".join([*parts, body[at:]]))
            spans = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            columns = [batch.column("_id"), batch.column("_h"), pa.array(runs, spans), pa.array(left, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_h", "runs", "kept"])

    done = join_rows(cand.select("_id", "_h", "_text", "full"), finer.select("_id", "_h", "blocks"), "left")
    done = join_rows(done, places, "left")
    schema = f"_id {kind}, _h long, runs array<struct<start:long,stop:long>>, kept binary"
    return done.mapInArrow(cut, schema).where(F.size("runs") > 0)


def remove_repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, reach: int = 200
) -> DataFrame:
    """One row per input row: id, n_bytes, n_removed, n_spans, kept_sha256.

    Null text is empty; a text of fewer than ``length`` bytes is never touched. Matches do not cross documents, overlaps
    within a document count, and all strings are judged on the input. A row given twice loses what both share: all its
    strings.
    """
    cut = repeated_bytes(docs, id_col, text_col, length, reach)
    gone = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    cut = cut.select("_id", "_h", gone.alias("gone"), F.size("runs").alias("spans"), F.sha2("kept", 256).alias("left"))
    body = F.encode(F.coalesce("_text", F.lit("")), "UTF-8")
    rows = keyed(docs, id_col, text_col).select(
        "_id", "_h", F.length(body).cast("long").alias("n_bytes"), F.sha2(body, 256).alias("whole")
    )
    return join_rows(rows, cut, "left").select(
        F.col("_id").alias(id_col),
        "n_bytes",
        F.coalesce("gone", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("left", "whole").alias("kept_sha256"),
    )
