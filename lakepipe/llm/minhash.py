"""Near-dedup with b-bit MinHash.

A document is its set of distinct word shingles. For each of ``bands * rows`` hash functions the smallest value over the
set is taken; bands of whole minima make candidates. For the estimate a second signature takes the minima of one hash in
each of ``BINS`` bins and keeps their low bits, packed into longs. Counting equal fields of two such signatures by bit
counts, corrected for chance agreement, estimates the similarity and drops poor candidates; every link is then confirmed
on the full shingle sets.

Documents with equal sets are one class and enter once. At first every class tries the most alike of the centres of its
buckets, a few links per class, which settles nearly everything. Then the classes that share a bucket but are still in
different components are compared pair by pair. A link is lost only if no band meets, or if the estimate is
more than ``SLACK`` too low: for a pair right at the threshold a chance of about 1e-4, far less above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepipe.llm.common import join_rows, keyed, stored, without_rows
from lakepipe.llm.components import connected_components

#: Bits kept of each bin's minimum.
BITS = 4
BINS = 512
#: A candidate goes on if its estimate is not further than this below the threshold: over four standard errors for the
#: largest sets, more for sets that leave bins empty.
SLACK = 0.07
#: Largest set whose hashes go with a class into the last comparison, in 32 bits each.
GRAMS = 1024
#: Centres of a bucket; each class tries as many others at first.
CENTRES = 3
_SEED = 20_011
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``size`` words; a shorter text is one run, no words give none."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(size, len(words))
    runs = hashes[: len(words) - size + 1].copy()
    for i in range(1, size):
        runs ^= runs >> np.uint64(29)
        runs = runs * _ODD + hashes[i : len(words) - size + 1 + i]
    runs ^= runs >> np.uint64(32)
    # a run's length is part of it
    return np.unique(runs * _ODD + np.uint64(size))


def hash_family(count: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.Generator(np.random.PCG64(_SEED))
    factors = draw.integers(0, 2**63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, draw.integers(0, 2**63, count, dtype=np.uint64)


def minima(shingles: np.ndarray, family: tuple[np.ndarray, np.ndarray], block: int = 2048) -> np.ndarray:
    """Smallest upper half of each hash function over the set, in blocks: memory does not grow with the text."""
    factors, offsets = family
    low = np.full(len(factors), 2**32 - 1, dtype=np.uint64)
    for at in range(0, len(shingles), block):
        part = shingles[at : at + block, None] * factors[None, :]
        part += offsets
        part >>= np.uint64(32)
        np.minimum(low, part.min(axis=0), out=low)
    return low


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Low bits of the least hash in each bin as bit planes, a bit per bin; the last plane marks filled bins."""
    mixed = shingles * _ODD
    mixed ^= mixed >> np.uint64(32)
    mixed = np.sort(mixed * _ODD)
    bins = (mixed >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.concatenate([[True], bins[1:] != bins[:-1]])
    planes = np.zeros((BITS + 1, BINS), dtype=np.uint8)
    planes[BITS, bins[first]] = 1
    for bit in range(BITS):
        planes[bit, bins[first]] = (mixed[first] >> np.uint64(bit)) & np.uint64(1)
    return np.packbits(planes, axis=1).reshape(-1).view(np.uint64)


def band_keys(low: np.ndarray, rows: int) -> np.ndarray:
    bands = low.reshape(-1, rows)
    keys = np.arange(len(bands), dtype=np.uint64) + np.uint64(1)
    for i in range(rows):
        keys = (keys ^ (keys >> np.uint64(31))) * _ODD + bands[:, i]
    return keys ^ (keys >> np.uint64(32))


def signatures(
    docs: DataFrame, size: int, bands: int, rows: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(_id, _h, n_shingles, digest, keys, packed) for every row; ``digest`` stands for the set, null if it is empty."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = hash_family(bands * rows)
        for batch in batches:
            counts, digests, keys, packed = [], [], [], []
            for text in batch.column("_text"):
                found = shingle_set(text.as_py(), size)
                counts.append(len(found))
                if len(found):
                    low = minima(found, family)
                    digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    keys.append(band_keys(low, rows).view(np.int64))
                    packed.append(sketch(found).view(np.int64))
                else:
                    digests.append(None)
                    keys.append(None)
                    packed.append(None)
            longs = pa.list_(pa.int64())
            columns = [batch.column("_id"), batch.column("_h"), pa.array(counts, pa.int64()),
                       pa.array(digests, pa.binary()), pa.array(keys, longs), pa.array(packed, longs)]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "_h", "n_shingles", "digest", "keys", "packed"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"_id {kind}, _h long, n_shingles long, digest binary, keys array<long>, packed array<long>"
    return keyed(docs, id_col, text_col).mapInArrow(sign, schema)


def estimate(left: Column, right: Column) -> Column:
    """Similarity from two packed signatures.

    Exclusive or shows the bins that differ; bit counts give these and the bins filled on either and on both sides. Of
    filled bins with different minima one in ``2 ** BITS`` looks equal and is taken off.
    """
    step = BINS // 64

    def total(part) -> Column:
        return sum((F.bit_count(part(i)) for i in range(1, step)), F.bit_count(part(0)))

    def unlike(i: int) -> Column:
        found = left[BITS * step + i].bitwiseXOR(right[BITS * step + i])
        for plane in range(BITS):
            found = found.bitwiseOR(left[plane * step + i].bitwiseXOR(right[plane * step + i]))
        return found

    either = total(lambda i: left[BITS * step + i].bitwiseOR(right[BITS * step + i]))
    both = total(lambda i: left[BITS * step + i].bitwiseAND(right[BITS * step + i]))
    equal = either - total(unlike)
    return (equal - (both - equal) / F.lit(2.0**BITS - 1)) / either


def class_texts(
    classes: DataFrame, docs: DataFrame, size: int, id_col: str, text_col: str
) -> DataFrame:
    """(node, _text, grams) of the given classes, the text of one document of each.

    ``grams`` are the distinct upper halves of the set's hashes, null for a set of over ``GRAMS``.
    """
    chosen = classes.select("node", "_id", "_h")
    texts = join_rows(keyed(docs, id_col, text_col), chosen).select("node", "_text").dropDuplicates(["node"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingle_set(text.as_py(), size) for text in batch.column("_text"))
            grams = [np.unique(s >> np.uint64(32)).astype(np.uint32).view(np.int32) if len(s) <= GRAMS else None for s in sets]
            columns = [batch.column("node"), batch.column("_text"), pa.array(grams, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["node", "_text", "grams"])

    return stored(texts.mapInArrow(add, "node binary, _text string, grams array<int>"), "texts")


def confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    both = (
        pairs.select("a", "b")
        .join(texts.select(F.col("node").alias("a"), F.col("_text").alias("text_a")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("_text").alias("text_b")), "b")
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for left, right in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
                one, two = shingle_set(left.as_py(), size), shingle_set(right.as_py(), size)
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * common >= percent * (len(one) + len(two) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(check, "a binary, b binary")


def _alike(percent: int) -> Column:
    """Whether sizes allow the threshold and the estimate comes near it."""
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    near = estimate(F.col("packed_a"), F.col("packed_b")) >= percent / 100 - SLACK
    return (100 * small >= percent * large) & near


def _enough(percent: int) -> Column:
    """Whether the halves of hashes that two sets share allow the threshold; true where a set is too large to tell.

    Halves that fell together in a set count as shared, so that no link is lost.
    """
    shared = F.size(F.array_intersect("grams_a", "grams_b")) + F.col("n_a") - F.size("grams_a")
    told = F.col("grams_a").isNotNull() & F.col("grams_b").isNotNull()
    # as for 100 * shared >= percent * union, with the shared ones worked out once
    return ~told | ((100 + percent) * shared >= percent * (F.col("n_a") + F.col("n_b")))


def _sides(nodes: DataFrame, side: str, *more: str) -> DataFrame:
    return nodes.select(
        F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("packed", "n", *more))
    )


def _untried(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    """The pairs that are not in ``tried``, whose pairs have the lesser side first."""
    known = tried.select(F.col("a").alias("x"), F.col("b").alias("y"))
    return pairs.join(known, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti")


def _shared_entries(classes: DataFrame) -> DataFrame:
    """(key, band, node) of the buckets that hold several classes: all later steps need no others."""
    entries = classes.select(F.posexplode("keys").alias("band", "key"), "node")
    several = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return stored(entries.join(several, "key"), "buckets")


def _best_centres(shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each class b and each of ``CENTRES`` orders the most alike of the centres a of its buckets.

    The centres of a bucket are its first classes in the order of as many hashes. They come from an aggregate with a map
    side and are joined back, so that Spark's skew join can cut up a bucket of very many classes.
    """
    entries = shared.select("key", F.col("node").alias("b"))
    first = [F.min(F.struct(F.xxhash64(F.lit(turn), "b").alias("by"), F.col("b").alias("a"))) for turn in range(CENTRES)]
    centres = entries.groupBy("key").agg(F.array(*first).alias("first"))
    centres = centres.select("key", F.posexplode("first").alias("turn", "first")).select("key", "turn", "first.a")
    pairs = entries.join(centres, "key").where("a != b").select("turn", "a", "b").distinct()
    scored = (
        pairs.join(_sides(classes, "a"), "a")
        .join(_sides(classes, "b"), "b")
        .where(_alike(percent))
        .withColumn("score", estimate(F.col("packed_a"), F.col("packed_b")))
    )
    best = scored.groupBy("b", "turn").agg(F.max_by("a", F.struct("score", "a")).alias("a"))
    # a pair may be the best of several orders and of both its classes
    return best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _apart(shared: DataFrame, placed: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of classes that share a bucket, are in different components, look alike and were not tried.

    A class may look like very many of a large group and be linked with none: pairs of which the sets' hashes tell that are
    left out where they are met, so that the pairs do not grow with the square of the group. A pair comes from the first
    band that both share only.
    """
    entries = shared.join(placed.select("node", "root"), "node")
    mixed = entries.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    spots = entries.join(mixed.select("key"), "key").select("key", "band", "node")
    sides = placed.withColumn("short", F.transform("keys", lambda k: k.bitwiseAND(F.lit(2**31 - 1)).cast("int")))
    side = spots.join(sides.select("node", "root", "packed", "n", "short", "grams"), "node")
    # both sides have the same columns, so that they share one shuffle
    names = ["node", "key", "band", "root", "packed", "n", "short", "grams"]
    left, right = (side.select(*[F.col(c).alias(f"{c}_{x}") for c in names]) for x in "ab")
    left, right = left.withColumnRenamed("node_a", "a"), right.withColumnRenamed("node_b", "b")
    earlier = [F.slice(f"short_{x}", 1, F.col("band_a")) for x in "ab"]
    first = ~F.exists(F.zip_with(*earlier, lambda x, y: x == y), lambda same: same)
    on = (F.col("key_a") == F.col("key_b")) & (F.col("root_a") < F.col("root_b"))
    on = on & _alike(percent) & first & _enough(percent)
    return _untried(left.join(right, on).select("a", "b").distinct(), tried)


def near_groups(
    docs: DataFrame,
    size: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: id, _h, n_shingles, component_id (smallest id reachable over links, itself included), kept.

    With 32 bands of 4 no band of a pair at 0.80 meets with a chance of 5e-8, at 0.85 of 6e-11; see the module on the estimate. Null or blank text has an empty
    set, is linked with nothing and is its own component. Rows with equal sets, repeated rows among them, are in one
    component. A null id never leads a component with other ids.
    """
    signed = stored(signatures(docs, size, bands, rows, id_col, text_col), "signed")
    filled = signed.where("digest IS NOT NULL")
    # one class per distinct set, represented by its least row; what is made of the set is the same for all its rows
    classes = stored(
        filled.groupBy(F.col("digest").alias("node"))
        .agg(F.min(F.struct("_id", "_h")).alias("least"), F.min("_id").alias("least_id"),
             F.first("n_shingles").alias("n"), F.first("keys").alias("keys"), F.first("packed").alias("packed"))
        .select("node", "least._id", "least._h", "n", "keys", "packed", "least_id"),
        "classes",
    )
    shared = _shared_entries(classes)
    near = stored(classes.join(shared.select("node").distinct(), "node", "left_semi"), "near")
    texts = class_texts(near, docs, size, id_col, text_col)
    tried = stored(_best_centres(shared, near, percent), "pairs")
    roots = stored(connected_components(confirm(tried, texts, size, percent)), "roots")
    # once for each class, as several joins read it
    placed = near.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(texts.drop("_text"), "node")
    found = stored(_apart(shared, stored(placed, "placed"), tried, percent), "pairs")
    if not found.isEmpty():
        links = confirm(found, texts, size, percent).unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = stored(connected_components(links), "roots")

    members = roots.join(classes.select("node", "least_id"), "node")
    leaders = members.groupBy("root").agg(F.min("least_id").alias("leader"))
    linked = roots.join(leaders, "root")
    answer = classes.select("node", "least_id").join(linked, "node", "left").select(
        F.col("node").alias("digest"),
        F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("leader")).alias("component_id"),
        F.hex(F.coalesce("root", "node")).alias("root"),
    )
    kept = F.col("_id").eqNullSafe(F.col("component_id"))
    return (
        signed.select("_id", "_h", "n_shingles", "digest")
        .join(answer, "digest", "left")
        .withColumn("component_id", F.when(F.col("digest").isNull(), F.col("_id")).otherwise(F.col("component_id")))
        .select(F.col("_id").alias(id_col), "_h", "n_shingles", "component_id", kept.alias("kept"), "root")
    )


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """One document of each component, that of the smallest id; columns as given.

    Documents without words stay. A row repeated with the same id and text stays repeated.
    """
    found = near_groups(docs, size, percent, id_col=id_col, text_col=text_col).where("root IS NOT NULL")
    found = stored(found.select(F.col(id_col).alias("_id"), "_h", "root"), "grouped")
    name = F.struct(F.col("_id").isNull().alias("none"), F.col("_id"), F.col("_h"))
    first = found.groupBy("root").agg(F.min(name).alias("first"))
    gone = found.join(first, "root").where(name != F.col("first")).select("_id", "_h").distinct()
    return without_rows(docs, gone, id_col, text_col)
