"""SentencePiece encoding and decoding by a relational lattice.

The text is cut into words at places no piece crosses, so the best segmentation of a text is that of its words. The
distinct words of the whole table are exploded into their substrings of bounded length and equi-joined to the piece
table; the edges that are left are grouped by bucket of words, and a Viterbi pass goes over all words of a bucket at once:
once for each word, however many documents hold it. Documents travel in compressed chunks, as the numbers of their words;
each chunk asks for the ids of its distinct words, and is put together where they arrive.
Words of over ``LATTICE_CHARS`` characters (text without spaces, rules of dashes) and words with U+0000 are not cut: the
same pass runs over them where the documents are put together, in time and memory that grow with their length only.
The score of a segmentation is the sum of its pieces' scores. A character without a piece becomes its bytes.
"""

from __future__ import annotations

import array
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vocabulary file, by its name among the installed ones.
MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Score of a character that is spelt in bytes: below any piece's.
SPELT = -1e10
#: Largest piece table that is sent to every executor.
MAX_PIECES = 1_000_000
#: Bytes of a chunk of documents, put together in one go; its distinct words, some 15 bytes for each 100 of text, are held in
#: memory then. Larger chunks ask for fewer words in all. A longer document is a chunk of its own.
CHUNK_BYTES = 16_000_000
#: Longest word whose edges become rows. It decides where a word is segmented, never how.
LATTICE_CHARS = 64

#: Bytes of text for each bucket of words: the edges of its words, some 15 for each, are held in memory.
TEXT_PER_LATTICE = 2_000_000
#: Between the words that a chunk asks of a bucket.
BETWEEN = "\0"
#: Numbers that are worth a call of the compressor.
LEAST_PACKED = 512
#: Rows of a gather that are worked on at once.
SLICE_ROWS = 200_000
#: Bits of a word's place among these, and of the number of a task's chunk.
PLACE_BITS, CHUNK_BITS = 22, 20

#: Letters, roughly: nothing of ASCII or of the general punctuation block but A-Z and a-z.
_WORDY = "A-Za-z\u00c0-\u1fff\u2070-\U0010ffff"
_JAVA_WORDY = r"A-Za-z\x{C0}-\x{1FFF}\x{2070}-\x{10FFFF}"


def _fine(wordy: str) -> str:
    return rf" *[{wordy}]+| *[^ \n{wordy}]+|\n| +"


#: Words with the spaces before them, however long. The first form also cuts between letters and the rest and around
#: line ends: allowed where no piece crosses such a place.
FINE = (_fine(_WORDY), _fine(_JAVA_WORDY))
COARSE = (r" *[^ ]+| +",) * 2


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[tuple[str, int, float], ...]  # (text with plain spaces, id, score)
    spelt: tuple[int, ...]  # id of each byte
    pattern: str  # of words, for Python
    java_pattern: str

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.pieces)


def load_vocabulary(path: str | None = None) -> Vocabulary:
    """The vocabulary of a model file; without a path the installed one of the name ``MODEL``."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, spelt = [], {}
    for i in range(model.get_piece_size()):
        text = model.id_to_piece(i)
        if model.is_byte(i):
            spelt[int(text[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces.append((text.replace(SPACE, " "), i, float(model.get_score(i))))
    if len(spelt) != 256:
        raise ValueError("the model has no piece for every byte")
    if len(pieces) > MAX_PIECES:
        raise ValueError(f"{len(pieces)} pieces; at most {MAX_PIECES} are sent to executors")
    wordy = re.compile(f"[{_WORDY}]")
    fine = True
    for text, _, _ in pieces:
        body = text.lstrip(" ")
        if " " in body:
            raise ValueError(f"piece {text!r} has a space behind another character")
        fine = fine and "\n" not in body and len({bool(wordy.match(c)) for c in body}) <= 1
    pattern, java = FINE if fine else COARSE
    return Vocabulary(tuple(pieces), tuple(spelt[b] for b in range(256)), pattern, java)


def piece_table(spark: SparkSession, vocabulary: Vocabulary) -> DataFrame:
    """(at, piece, id, score): the pieces with a 64-bit hash, no two of which are equal."""
    hashes = [signed_hash(text) for text, _, _ in vocabulary.pieces]
    if len(set(hashes)) < len({text for text, _, _ in vocabulary.pieces}):
        raise ValueError("two pieces have one hash")
    rows = [(h, *piece) for h, piece in zip(hashes, vocabulary.pieces, strict=True)]
    return spark.createDataFrame(rows, "at long, piece string, id int, score double")


def signed_hash(text: str) -> int:
    """Spark's ``xxhash64`` of a string."""
    value = xxhash.xxh64_intdigest(text.encode("utf-8"), seed=42)
    return value - (1 << 64) if value >= 1 << 63 else value


def _substrings(words: DataFrame, longest: int) -> DataFrame:
    """(of, key, start, stop, _piece): the substrings of each word of up to ``longest`` characters."""
    size = F.length("word")
    starts = words.select("of", "key", "word", F.explode(F.sequence(F.lit(0), size - 1)).alias("start"))
    reach = F.least(F.lit(longest), size - F.col("start"))
    spans = starts.select("of", "key", "word", "start", F.explode(F.sequence(F.lit(1), reach)).alias("n"))
    return spans.select(
        "of",
        "key",
        "start",
        (F.col("start") + F.col("n")).alias("stop"),
        F.col("word").substr(F.col("start") + 1, F.col("n")).alias("_piece"),
    )


def lattice_edges(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(of, key, start, stop, id): the pieces inside each of the distinct non-empty ``words`` (of, key, word).

    Every character has an edge; a negative id -c - 1 stands for the bytes of the code point c. Nothing is shuffled.
    """
    table = F.broadcast(piece_table(words.sparkSession, vocabulary))
    cut = _substrings(words, vocabulary.longest)
    # joined on a number, which is quicker; a substring of the same number that is no piece is told by its text
    met = cut.withColumn("_at", F.xxhash64("_piece")).join(table, F.col("_at") == F.col("at"), "left")
    met = met.withColumn("met", F.coalesce(F.col("_piece") == F.col("piece"), F.lit(False))).where("met OR stop = start + 1")
    number = F.when(F.col("met"), F.col("id")).otherwise(-F.ascii("_piece") - 1)
    return met.select("of", "key", "start", "stop", number.alias("id"))


def best_paths(
    count: int, word: np.ndarray, start: np.ndarray, stop: np.ndarray, ids: np.ndarray, scores: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the best segmentation of each of ``count`` words, one after the other, and where those of each begin.

    The edges are in any order; every place of a word is the stop of some. ``scores`` are by id, negative ids score
    ``SPELT``. Of equally good ways to reach a place the one with the longest last piece wins.
    """
    if not count:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    order = np.lexsort((start, word, stop))
    word, start, stop, ids = word[order], start[order], stop[order], ids[order]
    gain = np.where(ids < 0, SPELT, scores[np.maximum(ids, 0)])
    longest = int(stop[-1])
    best, came, taken = (np.zeros((longest + 1, count), kind) for kind in (np.float64, np.int64, np.int64))
    bounds = np.searchsorted(stop, np.arange(1, longest + 2))
    size = np.zeros(count, np.int64)
    for place, (low, high) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True), 1):
        w = word[low:high]
        score = best[start[low:high], w] + gain[low:high]
        first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
        most = np.maximum.reduceat(score, first)
        reached = np.flatnonzero(score == np.repeat(most, np.diff(np.append(first, len(w)))))
        # the first of each word: that of the least start
        reached = reached[np.concatenate(([True], w[reached][1:] != w[reached][:-1]))]
        w = w[reached]
        best[place, w], came[place, w], taken[place, w] = most, start[low + reached], ids[low + reached]
        size[w] = place
    steps, at, left = [], size, np.arange(count)
    while len(left):
        steps.append((left, taken[at, left]))
        at = came[at, left]
        left, at = left[at > 0], at[at > 0]
    spans = np.zeros(count, np.int64)
    for left, _ in steps:
        spans[left] += 1
    ends = np.cumsum(spans)
    found = np.empty(int(ends[-1]), np.int64)
    for back, (left, step) in enumerate(steps, 1):
        found[ends[left] - back] = step
    return found, np.concatenate(([0], ends))


def segment_long(word: str, table: dict[str, tuple[int, float]], longest: int) -> list[int]:
    """Ids of the best segmentation of one word, as ``segment`` gives them."""
    scores, starts, ids = array.array("d", [0.0]), array.array("q", [-1]), array.array("q", [0])
    for stop in range(1, len(word) + 1):
        best = None
        for start in range(max(0, stop - longest), stop):
            piece = table.get(word[start:stop])
            if piece is None:
                if stop - start > 1:
                    continue
                piece = -ord(word[start]) - 1, SPELT
            score = scores[start] + piece[1]
            if best is None or score > best[0]:
                best = score, start, piece[0]
        scores.append(best[0])
        starts.append(best[1])
        ids.append(best[2])
    path, at = [], len(word)
    while at:
        path.append(ids[at])
        at = starts[at]
    return path[::-1]


#: Spaces and what follows them, or spaces alone.
_SPACED = re.compile(r" *[^ ]+| +")


def _units(text: str) -> list[str]:
    """The text behind one more space, cut before spaces: what stands after a single space is given without it."""
    if "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ")
    return [u[1:] if u[1:2] != " " and len(u) > 1 else u for u in _SPACED.findall(f" {text}")]


def _words_of(unit: str, find: Callable[[str], list[str]]) -> list[str]:
    """The words of a unit."""
    return find(unit if unit[:1] == " " else f" {unit}")


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``values[starts[r]:ends[r]]`` for each r of ``rows``, one after the other; a slice of rows at once, to save room."""
    parts = [values[:0]]
    for at in range(0, len(rows), SLICE_ROWS):
        first, last = starts[rows[at : at + SLICE_ROWS]], ends[rows[at : at + SLICE_ROWS]]
        spans = last - first
        before = np.cumsum(spans) - spans
        parts.append(values[np.repeat(first - before, spans) + np.arange(int(spans.sum()))])
    return np.concatenate(parts)


def _totals(values: np.ndarray, rows: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum of ``values[rows]`` between each two of ``bounds``."""
    return np.diff(_sums(values[rows])[bounds])


def _sums(values: np.ndarray) -> np.ndarray:
    """Zero, and the running totals."""
    return np.concatenate(([0], np.cumsum(values, dtype=np.int64)))


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=6)


def _shrunk(values: np.ndarray) -> bytes:
    """32-bit numbers: all lowest bytes, then all second ones, and so on, so that it shows which bytes are rare.

    A few numbers are not compressed: Spark does so with what it shuffles, and a call would cost more than it saves.
    """
    planes = np.ascontiguousarray(values.astype("<i4", copy=False).view(np.uint8).reshape(-1, 4).T)
    packed = len(values) >= LEAST_PACKED
    head = (len(values) << 1 | packed).to_bytes(8, "little")
    return head + (_codec().compress(pa.py_buffer(planes), asbytes=True) if packed else planes.tobytes())


def _grown(data: bytes) -> np.ndarray:
    count, packed = divmod(int.from_bytes(data[:8], "little"), 2)
    planes = np.frombuffer(_codec().decompress(data[8:], 4 * count) if packed else data[8:], np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").ravel()


def _closed(table: pa.Table) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression=_codec())) as writer:
        writer.write_table(table.combine_chunks())
    return out.getvalue().to_pybytes()


def _closed_words(words: pa.Array) -> bytes:
    """Words without missing ones, compressed: their sizes and their bytes."""
    sizes = _shrunk(pc.binary_length(words).to_numpy(zero_copy_only=False))
    data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "")[0].as_buffer()
    return len(sizes).to_bytes(8, "little") + sizes + (_codec().compress(data, asbytes=True) if data.size else b"")


def _opened_words(block: bytes) -> pa.Array:
    cut = 8 + int.from_bytes(block[:8], "little")
    offsets = _sums(_grown(block[8:cut])).astype(np.int32)
    data = _codec().decompress(block[cut:], int(offsets[-1])) if offsets[-1] else pa.py_buffer(b"")
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), data)


def _opened(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all().combine_chunks()


def _only(column: pa.ChunkedArray) -> pa.Array:
    """A column as one array."""
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.chunks else pa.array([], column.type)


def _numbered(texts: pa.Array, find: Callable[[str], list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """The texts as numbers of their words: (rows in order, words of each, whether they cover it, numbers, words).

    Frequent words come first, and words of about one frequency by their bytes: both compress well.
    """
    texts = pc.fill_null(texts, "")
    filled = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
    # single spaces between units: cut by Arrow
    spaced = pc.match_substring_regex(texts, "^ |  | $").to_numpy(zero_copy_only=False)
    plain, spaced, empty = np.flatnonzero(filled & ~spaced), np.flatnonzero(spaced), np.flatnonzero(~filled)
    split = pc.split_pattern(texts.take(pa.array(plain)), " ")
    cut = [_units(text) for text in texts.take(pa.array(spaced)).to_pylist()]
    held = np.concatenate((pc.list_value_length(split).to_numpy(zero_copy_only=False), [len(c) for c in cut], np.zeros(len(empty))))
    bounds = _sums(held)
    units = split.flatten()
    if cut:
        units = pa.concat_arrays([units, pa.array(chain.from_iterable(cut), pa.string())])
    coded = units.dictionary_encode()
    forms, seen = coded.dictionary, coded.indices.to_numpy()
    del texts, split, cut, units, coded
    # letters behind one space are a word whatever the pattern
    letters = pc.match_substring_regex(forms, f"^[{_WORDY}]+$")
    others = [_words_of(unit, find) for unit in forms.filter(pc.invert(letters)).to_pylist()]
    is_word = letters.to_numpy(zero_copy_only=False)
    spans = np.ones(len(forms), np.int32)
    spans[~is_word] = [len(o) for o in others]
    flat = pa.concat_arrays(
        [pc.binary_join_element_wise(" ", forms.filter(letters), ""), pa.array(chain.from_iterable(others), pa.string())]
    )
    del others
    starts = np.empty(len(forms), np.int64)
    starts[is_word] = np.arange(int(is_word.sum()))
    starts[~is_word] = int(is_word.sum()) + _sums(spans[~is_word])[:-1]
    sizes = _sums(pc.binary_length(flat).to_numpy(zero_copy_only=False))
    space = pc.invert(pc.starts_with(forms, " ")).to_numpy(zero_copy_only=False)
    missed = sizes[starts + spans] - sizes[starts] != pc.binary_length(forms).to_numpy(zero_copy_only=False) + space
    whole = _totals(missed, seen, bounds) == 0 if missed.any() else np.ones(len(held), bool)
    counts = _totals(spans, seen, bounds)
    coded = flat.dictionary_encode()
    words, numbers = coded.dictionary, coded.indices.to_numpy()
    del forms, flat, coded
    # how often each word comes up: its units do, as often as they do
    times = np.repeat(np.bincount(seen, minlength=len(spans))[np.argsort(starts)], spans[np.argsort(starts)])
    often = np.log2(np.bincount(numbers, times, len(words))).astype(np.int64)
    by_bytes = pc.sort_indices(words).to_numpy().astype(np.int64)
    order = by_bytes[np.argsort(-often[by_bytes], kind="stable")]
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    numbers = _ranges(rank[numbers], starts, starts + spans, seen)
    return np.concatenate((plain, spaced, empty)), counts, whole, numbers, words.take(pa.array(order))


def _packed(rows: DataFrame, chunk_bytes: int, pattern: str) -> DataFrame:
    """(chunk, words, docs, numbers): rows of about ``chunk_bytes`` of text together, as compressed data."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, find = TaskContext.get().partitionId(), re.compile(pattern).findall
        held: list[pa.RecordBatch] = []
        size = number = 0

        def chunk() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            order, counts, whole, numbers, words = _numbered(_only(table.column("_text")).cast(pa.string()), find)
            owner = _only(table.column("_id")).take(pa.array(order))
            docs = pa.table({"_id": owner, "n": pa.array(counts), "whole": pa.array(whole)})
            columns = [
                pa.array([task << CHUNK_BITS | number], pa.int64()),
                *(pa.array([x], pa.binary()) for x in (_closed_words(words), _closed(docs), _shrunk(numbers))),
            ]
            pa.default_memory_pool().release_unused()
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "words", "docs", "numbers"])

        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                before = int(sizes[at - 1]) if at else 0
                # rows that still fit, and one at least
                stop = int(np.searchsorted(sizes, before + chunk_bytes - size, "right"))
                stop = max(stop, at + 1 if not size else at)
                if stop > at:
                    held.append(batch.slice(at, stop - at))
                    size += int(sizes[stop - 1]) - before
                    at = stop
                if at < batch.num_rows:
                    yield chunk()
                    held, size, number = [], 0, number + 1
        if held:
            yield chunk()

    return rows.mapInArrow(pack, "chunk long, words binary, docs binary, numbers binary")


def _asked(words: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of the words that are for the lattice, by bucket, and their buckets, by a hash of the word."""
    short = pc.and_(pc.less_equal(pc.utf8_length(words), LATTICE_CHARS), pc.invert(pc.match_substring(words, BETWEEN)))
    asked = np.flatnonzero(short.to_numpy(zero_copy_only=False))
    if not len(asked):
        return asked, asked
    words = words.take(pa.array(asked))
    sizes = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = _sums(sizes)
    data = np.frombuffer(words.buffers()[2], np.uint8)[: starts[-1]].astype(np.uint64)
    factors = np.multiply.accumulate(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
    data = (data + np.uint64(1)) * factors[np.arange(starts[-1]) - np.repeat(starts[:-1], sizes)]
    hashes = np.add.reduceat(data, starts[:-1])
    hashes = (hashes ^ hashes >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    bucket = ((hashes ^ hashes >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return asked[order], bucket[order]


def encode(
    docs: DataFrame,
    vocabulary: Vocabulary | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """One row per input row: id, ids, n_pieces, round_trip (the ids decode to the very text).

    A space is put before the text, as the model does. Null and empty text have no pieces. A literal U+2581 is spelt in
    bytes, so that it comes back. Repeated rows and rows with null ids are encoded each for itself.
    """
    vocabulary = vocabulary or load_vocabulary()
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.make_valid_utf8(F.col(f"`{text_col}`").cast("string")).alias("_text"))
    size = docs.select(F.octet_length(F.col(f"`{text_col}`").cast("string")).alias("n")).agg(F.sum("n")).first()[0] or 0
    tasks = max(1, 2 * math.ceil(size / chunk_bytes))
    dealt = _packed(rows, chunk_bytes, vocabulary.pattern).repartition(tasks, "chunk")
    spelt, texts, scored, longest = vocabulary.spelt, piece_bytes(vocabulary), vocabulary.pieces, vocabulary.longest
    buckets = max(1, math.ceil(size / TEXT_PER_LATTICE))
    scores = np.zeros(len(texts))
    for _, i, score in scored:
        scores[i] = score

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("words")):
                words = _opened_words(data.as_py())
                asked, bucket = _asked(words, buckets)
                of, first = np.unique(bucket, return_index=True)
                bounds = pa.array(np.append(first, len(asked)), pa.int32())
                lists = pa.ListArray.from_arrays(bounds, words.take(pa.array(asked)))
                columns = [pa.array(of, pa.int32()), pa.array(np.full(len(of), chunk)), pc.binary_join(lists, BETWEEN)]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "chunk", "words"])

    # one shuffle for both: the words asked for, and the distinct ones, known by the least chunk and place that asks
    asked = dealt.mapInArrow(ask, "bucket int, chunk long, words string").repartition(buckets, "bucket")
    each = asked.select(F.col("bucket").alias("of"), "chunk", F.posexplode(F.split("words", BETWEEN)).alias("place", "word"))
    key = F.shiftleft("chunk", PLACE_BITS) + F.col("place")
    edges = lattice_edges(each.groupBy("of", "word").agg(F.min(key).alias("key")), vocabulary)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("chunk")
        chunks, lists = left.column("chunk").to_numpy(), pc.split_pattern(_only(left.column("words")), BETWEEN)
        spans = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        bounds = _sums(spans)
        coded = lists.flatten().dictionary_encode()
        entries = coded.indices.to_numpy().astype(np.int64)
        # words are numbered as they come up: the keys rise
        first = np.unique(entries, return_index=True)[1]
        owner = np.searchsorted(bounds, first, "right") - 1
        keys = (chunks[owner] << PLACE_BITS) + first - bounds[owner]
        word = np.searchsorted(keys, right.column("key").to_numpy())
        start, stop, ids = (right.column(name).to_numpy().astype(np.int64) for name in ("start", "stop", "id"))
        ids, places = best_paths(len(keys), word, start, stop, ids, scores)
        paths, sizes = _ranges(ids, places[:-1], places[1:], entries), np.diff(places)[entries]
        ends = _sums(sizes)
        found = [
            _shrunk(np.concatenate(([high - low], sizes[low:high], paths[ends[low] : ends[high]])))
            for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)
        ]
        return pa.table({"chunk": pa.array(chunks), "bucket": left.column("bucket"), "found": pa.array(found, pa.binary())})

    answers = asked.groupBy("bucket").cogroup(edges.groupBy("of")).applyInArrow(
        answer, "chunk long, bucket int, found binary"
    )

    def put_together(left: pa.Table, right: pa.Table) -> pa.Table:
        words = _opened_words(left.column("words")[0].as_py())
        docs = _opened(left.column("docs")[0].as_py())
        numbers = _grown(left.column("numbers")[0].as_py())
        order, _ = _asked(words, buckets)
        found = [_grown(x.as_py()) for x in right.sort_by("bucket").column("found")]
        if sum(int(x[0]) for x in found) != len(order):  # a chunk that was dealt anew in between
            order, found = order[:0], []
        none = np.zeros(0, np.int64)
        ids = np.concatenate([none, *(x[1 + int(x[0]) :] for x in found)])
        spans = np.full(len(words), -1, np.int64)
        spans[order] = np.concatenate([none, *(x[1 : 1 + int(x[0])] for x in found)])
        starts = np.zeros(len(words), np.int64)
        starts[order] = _sums(spans[order])[:-1]
        # words that the lattice did not see
        left_over = np.flatnonzero(spans < 0)
        if len(left_over):
            lattice = {text: (i, score) for text, i, score in scored}
            later = [segment_long(w, lattice, longest) for w in words.take(pa.array(left_over)).to_pylist()]
            spans[left_over] = [len(x) for x in later]
            starts[left_over] = len(ids) + _sums(spans[left_over])[:-1]
            ids = np.concatenate((ids, np.fromiter(chain.from_iterable(later), np.int64)))
        ids, bounds = _ranges(ids, starts, starts + spans, np.arange(len(words))), _sums(spans)
        # characters without a piece become their bytes
        lengths = np.ones(len(ids), np.int64)
        for at in np.flatnonzero(ids < 0):
            lengths[at] = len(chr(-ids[at] - 1).encode("utf-8"))
        ends = _sums(lengths)
        spelled = np.repeat(ids, lengths).astype(np.int32)
        for at in np.flatnonzero(ids < 0):
            spelled[ends[at] : ends[at + 1]] = [spelt[b] for b in chr(-ids[at] - 1).encode("utf-8")]
        bounds = ends[bounds]
        # the ids of a word give back that word: then those of a text give back the text
        pieces_of = [texts[x] for x in spelled.tolist()]
        given = _sums(np.fromiter(map(len, pieces_of), np.int64, len(pieces_of)))[bounds]
        wanted = _sums(pc.binary_length(words).to_numpy(zero_copy_only=False))
        same = docs.column("whole").to_numpy()
        counts = _sums(docs.column("n").to_numpy())
        if (given != wanted).any() or b"".join(pieces_of) != "".join(words.to_pylist()).encode("utf-8"):
            true = np.array(
                [b"".join(pieces_of[a:b]) == w.encode("utf-8") for w, a, b in zip(words.to_pylist(), bounds[:-1], bounds[1:])], bool
            )
            same = same & (_totals(~true, numbers, counts) == 0)
        del pieces_of, words, right, left, found, ids, lengths, ends, starts, spans, given, wanted
        offsets = _sums(_totals(np.diff(bounds), numbers, counts))
        values = _ranges(spelled, bounds[:-1], bounds[1:], numbers)
        pa.default_memory_pool().release_unused()
        encoded = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
        return pa.table({"_id": docs.column("_id"), "ids": encoded, "round_trip": pa.array(same, pa.bool_())})

    schema = f"_id {kind}, ids array<int>, round_trip boolean"
    encoded = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(put_together, schema)
    return encoded.select(
        F.col("_id").alias(id_col), "ids", F.size("ids").cast("long").alias("n_pieces"), "round_trip"
    )


def piece_bytes(vocabulary: Vocabulary) -> list[bytes]:
    """What each id stands for; ids without a text (control pieces) stand for nothing."""
    texts = [b""] * (1 + max(*(i for _, i, _ in vocabulary.pieces), *vocabulary.spelt))
    for text, i, _ in vocabulary.pieces:
        texts[i] = text.encode("utf-8")
    for byte, i in enumerate(vocabulary.spelt):
        texts[i] = bytes([byte])
    return texts


def decode_ids(ids: list[int], texts: list[bytes]) -> str:
    """The text of ids, without the space that stands before every text; broken bytes become U+FFFD."""
    return b"".join([texts[i] for i in ids])[1:].decode("utf-8", errors="replace")


def decode(rows: DataFrame, vocabulary: Vocabulary | None = None, ids_col: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the column ``out``: the text of ``ids_col``. Null ids give null, ids out of range nothing."""
    vocabulary = vocabulary or load_vocabulary()
    texts = piece_bytes(vocabulary)
    names = [f.name for f in rows.schema.fields if f.name != out]
    kinds = [f"`_c{i}` {rows.schema[n].dataType.simpleString()}" for i, n in enumerate(names)]

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                None if ids is None else decode_ids([i for i in ids if i is not None and 0 <= i < len(texts)], texts)
                for ids in batch.column("_ids").to_pylist()
            ]
            columns = [batch.column(f"_c{i}") for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(found, pa.string())], [*(f"_c{i}" for i in range(len(names))), "_out"]
            )

    plain = rows.select(*[F.col(f"`{n}`").alias(f"_c{i}") for i, n in enumerate(names)], F.col(ids_col).alias("_ids"))
    spelled = plain.mapInArrow(spell, ", ".join([*kinds, "_out string"]))
    return spelled.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)], F.col("_out").alias(out))
