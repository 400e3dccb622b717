"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every window of ``window`` words keeps the smallest hash of the short word runs (k-grams) in it as its fingerprint. Equal
windows have equal fingerprints, so every shared span of a window's length or more is found. Fingerprints of documents
and of benchmark items are joined; windows of the documents that hit are then compared word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepipe.llm.common import count_words, join_rows, keyed, let, positions, without_rows, words_of

#: Benchmark windows that may be sent to every executor; beyond it the joins shuffle instead.
BROADCAST_ROWS = 200_000


def window_prints(words: Column, window: int, gram: int) -> Column:
    """Fingerprint of each full window, in order: the least hash of the k-grams in it."""
    count = F.size(words)
    hashes = F.transform(positions(count - (gram - 1)), lambda i: F.xxhash64(F.slice(words, i, gram)))
    return let(
        hashes,
        lambda h: F.transform(
            positions(count - (window - 1)), lambda i: F.array_min(F.slice(h, i, window - gram + 1))
        ),
    )


def run_prints(words: Column, size: int) -> Column:
    """Hash of each run of ``size`` words: the fingerprint of an item too short for a window."""
    return F.transform(positions(F.size(words) - (size - 1)), lambda i: F.xxhash64(F.slice(words, i, size)))


def _prints(words: Column, window: int, gram: int, short: list[int]) -> Column:
    """Distinct fingerprints of a text. Neighbouring windows mostly share theirs, so few are left."""
    return let(
        words,
        lambda ws: F.array_distinct(
            F.concat(window_prints(ws, window, gram), *[run_prints(ws, size) for size in short])
        ),
    )


def _found_windows(words: Column, found: Column, window: int, gram: int, short: list[int]) -> Column:
    """(len, start from 1, body) of the windows whose fingerprint is among ``found``."""

    def among(prints: Column, size: int) -> Column:
        spots = F.filter(
            F.transform(prints, lambda p, i: F.when(F.array_contains(found, p), i + 1)), lambda i: i.isNotNull()
        )
        return F.transform(
            spots,
            lambda i: F.struct(
                F.lit(size).alias("len"), i.alias("start"), F.concat_ws(" ", F.slice(words, i, size)).alias("body")
            ),
        )

    return F.concat(
        among(window_prints(words, window, gram), window), *[among(run_prints(words, size), size) for size in short]
    )


def _benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    """(item_id, len, print, body): a full item has all its windows, a shorter one is one window."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words"))
    size = F.least(F.size("words"), F.lit(window))
    prints = F.when(F.size("words") >= window, window_prints(F.col("words"), window, gram)).when(
        F.size("words") > 0, F.array(F.xxhash64("words"))
    )
    return (
        items.select("item_id", "words", size.alias("len"), F.posexplode(prints).alias("at", "print"))
        .select("item_id", "len", "print", F.concat_ws(" ", F.slice("words", F.col("at") + 1, F.col("len"))).alias("body"))
        .distinct()
    )


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    gram: int = 5,
    one_in: int = 20,
) -> DataFrame:
    """One row per input row: id, n_words, n_hit, n_items, items (sorted ids), contaminated.

    A word is hit if it lies in an occurrence of a window of an item. Contaminated: at least one word in ``one_in`` is
    hit. Null or empty text has no words and is clean; an item without words has no window. Rows repeated with the same
    id and text get the same answer each.
    """
    hits = find_hits(docs, benchmark, id_col, text_col, item_col, item_text_col, window, gram)
    rows = keyed(docs, id_col, text_col).select("_id", "_h", count_words(F.col("_text")).alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return join_rows(rows, hit_words(hits), "left").select(
        F.col("_id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (one_in * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def find_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    gram: int = 5,
) -> DataFrame:
    """(_id, _h, len, start, item_id): every occurrence of an item's window in a document, words from 1."""
    marks = _benchmark_windows(benchmark, item_col, item_text_col, window, gram)
    lengths = [r["len"] for r in marks.where(F.col("len") < window).select("len").distinct().collect()]
    short = sorted(lengths)  # at most window - 1 values
    small = marks.count() <= BROADCAST_ROWS
    sent = (lambda df: F.broadcast(df)) if small else (lambda df: df)

    rows = keyed(docs, id_col, text_col)
    prints = rows.select(
        "_id", "_h", F.explode(_prints(words_of(F.col("_text")), window, gram, short)).alias("print")
    )
    found = (
        prints.join(sent(marks.select("print").distinct()), "print", "left_semi")
        .groupBy("_id", "_h")
        .agg(F.collect_set("print").alias("found"))
    )
    # the documents that hit, once each: their windows with a known fingerprint, compared as text
    joined = join_rows(rows, found).dropDuplicates(["_id", "_h"])
    hit = let(
        words_of(F.col("_text")), lambda words: _found_windows(words, F.col("found"), window, gram, short)
    )
    spans = joined.select("_id", "_h", F.explode(hit).alias("w")).select("_id", "_h", "w.len", "w.start", "w.body")
    return spans.join(sent(marks.select("len", "body", "item_id")), ["len", "body"]).select(
        "_id", "_h", "len", "start", "item_id"
    )


def hit_words(hits: DataFrame) -> DataFrame:
    """(_id, _h, n_hit, items): words under the union of the hits, and the sorted ids of their items as text."""
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("stop"))))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach"))

    def add(state: Column, span: Column) -> Column:
        fresh = F.greatest(span["stop"] - F.greatest(span["start"], state["reach"]), F.lit(0))
        reach = F.greatest(span["stop"], state["reach"])
        return F.struct((state["n"] + fresh).cast("long").alias("n"), reach.alias("reach"))

    return (
        hits.groupBy("_id", "_h")
        .agg(spans.alias("spans"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
        .select("_id", "_h", F.aggregate("spans", start, add, lambda s: s["n"]).alias("n_hit"), "items")
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", one_in: int = 20
) -> DataFrame:
    """The documents without the contaminated ones; columns as given."""
    hits = hit_words(find_hits(docs, benchmark, id_col, text_col))
    sizes = keyed(docs, id_col, text_col).select("_id", "_h", count_words(F.col("_text")).alias("n_words"))
    bad = join_rows(sizes, hits).where(one_in * F.col("n_hit") >= F.col("n_words")).select("_id", "_h").distinct()
    return without_rows(docs, bad, id_col, text_col)
