"""Substring dedup over sliding runs of consecutive sentences and over windows of words.

Every run of ``span`` consecutive sentences is hashed and joined globally. Sentences that lie in a run which is not the
first of its kind are removed. A sentence of over ``longest`` words counts as several, cut every ``longest`` words.

Every window of ``window`` words is treated alike, so a repeated passage of that many words goes wherever it starts and
ends, with stops or without. Windows are hashed only around shingles that repeat: of the shingles of a window the one
with the least hash is sampled, which is the same one in each copy, so no repeated window is missed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepipe.llm.common import join_rows, keyed, stored

SENTENCE = re.compile(r"[^.!?\n]*[.!?\n]+\s*|[^.!?\n]+")
TOKEN = re.compile(r"\S+\s*")
PLAIN = re.compile(r"\S+")
KEPT = re.compile(rb"\0+")
#: Words of a sampled shingle.
SHINGLE = 16
#: Text whose hashes are held at once.
SLICE_BYTES = 2_000_000


def sentences(text: str | None, longest: int = 20) -> list[str]:
    """Pieces that make up the text when put together; each has at least one word, unless the text has none."""
    out: list[str] = []
    for part in SENTENCE.findall(text or ""):
        words = TOKEN.findall(part)
        lead = part[: len(part) - sum(map(len, words))]
        if not words:
            # only white space: it belongs to what stands before it
            out = [*out[:-1], out[-1] + part] if out else [part]
            continue
        words[0] = lead + words[0]
        out += ["".join(words[i : i + longest]) for i in range(0, len(words), longest)]
    return out


def sentence_words(text: str | None, longest: int = 20) -> list[str]:
    """The words of each of ``sentences``, one space between them."""
    out: list[str] = []
    for part in SENTENCE.findall(text or ""):
        words = part.split()
        if len(words) > longest:
            out += [" ".join(words[i : i + longest]) for i in range(0, len(words), longest)]
        elif words or not out:
            out.append(" ".join(words))
    return out


def run_hashes(units: list[str], span: int) -> list[bytes]:
    """128-bit hash of each run of ``span`` of ``sentence_words``."""
    if len(units) < span:
        return []
    marks = b"".join(map(xxhash.xxh3_128_digest, units))
    return [xxhash.xxh3_128_digest(marks[16 * i : 16 * (i + span)]) for i in range(len(units) - span + 1)]


def word_marks(texts: list[list[str]]) -> np.ndarray:
    """128-bit hashes of the words of some texts, one after the other, as two numbers each."""
    hashes = b"".join(map(xxhash.xxh3_128_digest, chain.from_iterable(texts)))
    return np.frombuffer(hashes, np.uint64).reshape(-1, 2)


def blocks(marks: np.ndarray, sizes: np.ndarray, window: int, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle's first word, first and last start of the windows it is sampled from), from each text's start to its end.

    ``sizes`` are the words of each text; windows never cross texts. The shingle of a window is the one whose first words
    hash least, the first of equals.
    """
    first = marks[:, 0]
    size = len(first) - shingle + 1
    starts = np.maximum(sizes - window + 1, 0)
    if not starts.sum():
        return (np.zeros(0, np.int64),) * 3
    order = np.zeros(size, dtype=np.uint64)
    for i in range(min(3, shingle)):
        order = order * np.uint64(0x9E3779B97F4A7C15) + first[i : i + size]
    order = (order ^ (order >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    # upper half: the hash, lower half: the place, so that the least value tells its place
    least = (order & np.uint64(0xFFFFFFFF00000000)) | np.arange(size, dtype=np.uint64)
    reach, wide = 1, window - shingle + 1
    while reach < wide:
        step = min(reach, wide - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    inside = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(starts) - starts), starts) + np.arange(int(starts.sum()))
    place = (least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    begin = np.flatnonzero(np.diff(place, prepend=-1))
    end = np.append(begin[1:], len(place)) - 1
    return place[begin], inside[begin], inside[end]


def _hashes(marks: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> list[bytes]:
    """128-bit hash of the words from each start to each stop."""
    body = memoryview(marks.tobytes())
    return [xxhash.xxh3_128_digest(body[a:b]) for a, b in zip((16 * starts).tolist(), (16 * stops).tolist(), strict=True)]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, in slices of about ``SLICE_BYTES`` of text: what is held in memory does not grow with the batch."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("_text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(sizes[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, "right")))
        yield batch.slice(at, stop - at)
        at = stop


def _binary(values: list[bytes], nulls: int = 0) -> pa.Array:
    """Hashes behind ``nulls`` nulls."""
    kept = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(values), [None, pa.py_buffer(b"".join(values))])
    return pa.concat_arrays([pa.nulls(nulls, pa.binary()), kept.cast(pa.binary())])


def _later(again: DataFrame, run: str, *more: str) -> DataFrame:
    """(_id, _h, place, columns ``more``) of runs that stand somewhere else before: by id (null before all), then by
    place."""
    here = F.struct("_id", "_h", "place")
    first = again.groupBy(run).agg(F.min(here).alias("first"))
    return again.join(first, run).where(~here.eqNullSafe(F.col("first"))).select("_id", "_h", "place", *more)


def _placed(batch: pa.RecordBatch, rows: np.ndarray, columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    """``columns`` with the ids of the documents in ``rows`` of the batch."""
    spots = pa.array(rows, pa.int32())
    ids = {n: batch.column(n).take(spots) for n in ("_id", "_h")}
    found = {n: c if isinstance(c, pa.Array) else pa.array(c, pa.int32()) for n, c in columns.items()}
    return pa.RecordBatch.from_pydict(ids | found)


def repeated_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    span: int = 3,
    longest: int = 20,
    window: int = 50,
) -> DataFrame:
    """(_id, _h, places, begins, ends): first sentences of the runs, and first words and ends of the passages, that stand
    somewhere else before.

    First is the least by id (null before all), then by place. The count and the first place of each run come from
    aggregates with a map side; the joins back are cut up by Spark where a run is very common.

    The windows that share a sampled shingle are one block of words. A block that stands before as a whole is a passage;
    where a shingle has several different blocks, the first of each is taken apart into its windows. The first place of
    a window always lies in the first of its blocks, so none is missed.
    """
    shingle = min(SHINGLE, window)

    def found_in(texts: list[str | None]) -> tuple[list[list[bytes]], np.ndarray, np.ndarray, tuple[np.ndarray, ...]]:
        """Hashes of the runs of sentences of each text; word hashes, words of each text, blocks."""
        runs = [run_hashes(sentence_words(t, longest), span) for t in texts]
        words = [(t or "").split() for t in texts]
        marks, sizes = word_marks(words), np.fromiter(map(len, words), np.int64, len(words))
        return runs, marks, sizes, blocks(marks, sizes, window, shingle)

    # half of a run's hash is enough to find those that may stand twice
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chain.from_iterable(map(_slices, batches)):
            runs, marks, _, (at, _, _) = found_in(part.column("_text").to_pylist())
            hashes = b"".join([*chain.from_iterable(runs), *_hashes(marks, at, at + shingle)])
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(hashes, np.int64)[::2])], ["half"])

    # sentences have no block; for words, place and stop are the first and the last start of the block's windows
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chain.from_iterable(map(_slices, batches)):
            runs, marks, sizes, (at, begin, end) = found_in(part.column("_text").to_pylist())
            counts = np.fromiter(map(len, runs), np.int64, len(runs))
            n = int(counts.sum())
            place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
            owner = np.searchsorted(np.cumsum(sizes), begin, "right")
            before = (np.cumsum(sizes) - sizes)[owner]
            found = [*chain.from_iterable(runs), *_hashes(marks, at, at + shingle)]
            columns = {
                "place": np.concatenate([place, begin - before]),
                "stop": pa.concat_arrays([pa.nulls(n, pa.int32()), pa.array(end - before, pa.int32())]),
                "half": pa.array(np.frombuffer(b"".join(found), np.int64)[::2]),
                "run": _binary(found),
                "block": _binary(_hashes(marks, begin, end + window), n),
            }
            yield _placed(part, np.concatenate([np.repeat(np.arange(len(runs)), counts), owner]), columns)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = keyed(docs, id_col, text_col)
    common = rows.mapInArrow(counted, "half long").groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    names = f"_id {kind}, _h long, place int, stop int, half long, run binary, block binary"
    again = stored(rows.mapInArrow(hashed, names).join(common, "half").drop("half"), "runs")

    near = again.where("block IS NOT NULL")
    ranged = near.groupBy("block").agg(
        F.min(F.struct("_id", "_h", "place", "stop")).alias("first"), F.first("run").alias("run")
    )
    ranged = stored(ranged, "blocks")
    mixed = ranged.groupBy("run").agg(F.count("*").alias("n")).where("n > 1").select("run")
    apart = ranged.join(mixed, "run").select("first.*").groupBy("_id", "_h")
    apart = apart.agg(F.collect_list(F.struct("place", "stop")).alias("ranges"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chain.from_iterable(map(_slices, batches)):
            words = [t.split() for t in part.column("_text").to_pylist()]
            marks, sizes = word_marks(words), np.fromiter(map(len, words), np.int64, len(words))
            ranges = part.column("ranges").to_pylist()
            first = [np.concatenate([np.arange(r["place"], r["stop"] + 1) for r in x]) for x in ranges]
            owner = np.repeat(np.arange(len(first)), list(map(len, first)))
            place = np.concatenate(first)
            start = place + (np.cumsum(sizes) - sizes)[owner]
            yield _placed(part, owner, {"place": place, "run": _binary(_hashes(marks, start, start + window))})

    # rows repeated with the same id and text give equal (_id, _h, place): one place
    parts = join_rows(rows, apart).mapInArrow(windows, f"_id {kind}, _h long, place int, run binary")
    parts = stored(parts, "windows")
    here = F.struct("_id", "_h", "place")
    known = ranged.select("block", F.struct("first._id", "first._h", "first.place").alias("first"))
    whole = near.join(known, "block").where(~here.eqNullSafe(F.col("first")))
    passages = whole.select("_id", "_h", "place", "stop").unionByName(
        _later(parts, "run").withColumn("stop", F.col("place"))
    )
    by_word = passages.select("_id", "_h", F.lit(None).cast("int").alias("sentence"), F.struct("place", "stop").alias("p"))
    by_sentence = _later(again.where("block IS NULL"), "run").select("_id", "_h", F.col("place").alias("sentence"))
    found = by_word.unionByName(by_sentence, allowMissingColumns=True).groupBy("_id", "_h")
    found = found.agg(F.collect_set("sentence").alias("places"), F.collect_set("p").alias("p"))
    return found.select("_id", "_h", "places", F.col("p.place").alias("begins"), (F.col("p.stop")).alias("ends"))


def cut_text(
    text: str, places: list[int], begins: list[int], ends: list[int], span: int, longest: int, window: int
) -> tuple[int, int, str]:
    """(sentences, sentences of which no word is left, what is left)."""
    if not places and not begins:
        return len(sentence_words(text, longest)), 0, text
    units = sentences(text, longest)
    runs = {i + k for i in places for k in range(span)}
    gone = bytearray(len(text))
    edges = np.cumsum([0, *map(len, units)]).tolist()
    for i in runs:
        gone[edges[i] : edges[i + 1]] = b"\1" * len(units[i])
    if begins:
        at = [*(m.start() for m in PLAIN.finditer(text)), len(text)]
        for i, last in zip(begins, ends, strict=True):
            gone[at[i] : at[last + window]] = b"\1" * (at[last + window] - at[i])
    left = "".join([text[m.start() : m.end()] for m in KEPT.finditer(gone)])
    removed = 0
    for i, unit in enumerate(units):
        here = gone[edges[i] : edges[i + 1]]
        removed += i in runs or (any(here) and all(g or c.isspace() for c, g in zip(unit, here, strict=True)))
    return len(units), removed, left


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    span: int = 3,
    longest: int = 20,
    window: int = 50,
) -> DataFrame:
    """One row per input row: id, n_sentences, n_removed, kept_text.

    Null text has no sentences and stays null; a text of fewer than ``span`` sentences and ``window`` words is left as it
    is. A sentence of which a window takes a part stays with its other words and does not count as removed. Runs and
    windows are judged on the input, within a document too. Rows repeated with the same id and text are one document.
    """
    found = repeated_runs(docs, id_col, text_col, span, longest, window)
    rows = join_rows(keyed(docs, id_col, text_col), found, "left")
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chain.from_iterable(map(_slices, batches)):
            sizes, removed, texts = [], [], []
            for text, *spots in zip(*(batch.column(n) for n in ("_text", "places", "begins", "ends")), strict=True):
                n, gone, left = cut_text(text.as_py() or "", *(s.as_py() or [] for s in spots), span, longest, window)
                sizes.append(n)
                removed.append(gone)
                texts.append(left if text.is_valid else None)
            columns = [batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()),
                       pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "n_sentences", "n_removed", "kept_text"])

    schema = f"_id {kind}, n_sentences long, n_removed long, kept_text string"
    return rows.mapInArrow(cut, schema).withColumnRenamed("_id", id_col)
