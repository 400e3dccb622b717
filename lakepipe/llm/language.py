"""Language identification, words first.

A word known to the model is scored by its frequency in each language. An unseen word falls back to character n-grams:
at each place the longest known one counts, each step down costs a fixed factor. Counts cover every training document.
Which entries the model keeps is bounded by ``Settings``; an entry kept for one language has its true count in all, and
frequencies are taken from all entries, kept or not.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakepipe.llm.common import positions
from lakepipe.session import cut_lineage

#: Runs of letters of any script, with the marks that belong to them.
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Characters of a word whose n-grams are cut in one go.
BLOCK = 256
UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    words: int = 25_000  # known words per language at most: the most frequent ones
    grams: int = 10_000  # n-grams per language and length at most
    longest: int = 4  # characters of the longest n-gram
    smooth: float = 0.5  # added to each count
    step: float = 0.4  # factor for each step to a shorter n-gram
    flush: int = 400_000  # counts a task holds before it hands them on


@dataclass(frozen=True)
class Model:
    """Log frequencies, one column per language; the last row of each table is that of an unseen entry."""

    languages: tuple[str, ...]
    words: dict[str, int]
    word_logs: np.ndarray
    grams: dict[str, int]
    gram_logs: np.ndarray
    settings: Settings


def find_words(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def word_counts(docs: DataFrame, text_col: str, lang_col: str, flush: int) -> DataFrame:
    """(lang, word, n) over all rows with a language; each task adds up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            langs, words, counts = [], [], []
            for lang, found in held.items():
                langs += [lang] * len(found)
                words += found.keys()
                counts += found.values()
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts, pa.int64())],
                ["lang", "word", "n"],
            )

        for batch in batches:
            for text, lang in zip(batch.column("_text"), batch.column("_lang"), strict=True):
                held.setdefault(lang.as_py(), Counter()).update(find_words(text.as_py()))
            if sum(map(len, held.values())) > flush:
                yield out()
        if held:
            yield out()

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).cast("string").alias("_text"), F.col(lang_col).cast("string").alias("_lang")
    )
    return rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame, group: list[str], limit: int) -> DataFrame:
    """Rows of the largest counts, at most ``limit`` per group.

    The cut is a count, found from how many rows have each count: that table has few rows, whatever the input.
    """
    steps = counts.groupBy(*group, "n").agg(F.count("*").alias("rows"))
    above = F.sum("rows").over(Window.partitionBy(*group).orderBy(F.desc("n")))
    cut = steps.withColumn("above", above).where(F.col("above") <= limit).groupBy(*group).agg(F.min("n").alias("least"))
    return counts.join(F.broadcast(cut), group).where("n >= least").drop("least")


def gram_rows(counts: DataFrame, longest: int) -> DataFrame:
    """(lang, n, gram): the n-grams of each (lang, word, n), up to ``longest`` characters, the word between two ``_``.

    A word shorter than a size gives itself for it. A long word is cut into blocks first, which overlap so that every
    n-gram lies whole in the block it starts in: no row holds more than those of ``BLOCK`` places.
    """
    padded = F.concat(F.lit("_"), F.col("word"), F.lit("_"))
    long = F.length(padded) > BLOCK
    places = F.sequence(F.lit(0), F.floor((F.length(padded) - 1) / BLOCK).cast("int"))
    blocks = F.transform(places, lambda k: padded.substr(k * BLOCK + 1, F.lit(BLOCK + longest - 1)))
    cut = counts.select("lang", "n", long.alias("long"), F.explode(F.when(long, blocks).otherwise(F.array(padded))).alias("part"))
    size_of = F.length("part")

    def of_size(size: int) -> Column:
        inside = size_of - (size - 1)
        count = F.when(F.col("long"), F.least(F.lit(BLOCK), inside)).otherwise(F.greatest(inside, F.lit(1)))
        return F.transform(positions(count), lambda i: F.col("part").substr(i, F.lit(size)))

    runs = F.flatten(F.array(*[of_size(size) for size in range(1, longest + 1)]))
    return cut.select("lang", "n", F.explode(runs).alias("gram"))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", settings: Settings = Settings()) -> Model:
    """Fit on every row of ``docs`` with a text and a language.

    Only the kept entries reach the driver: languages times ``words + longest * grams`` at most, each with its count in
    every language.
    """
    counts = cut_lineage(word_counts(docs, text_col, lang_col, settings.flush))
    totals = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    languages = tuple(sorted(totals))
    known = _most_frequent(counts, ["lang"], settings.words)

    grams = (
        gram_rows(counts, settings.longest)
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("size", F.length("gram"))
    )
    grams = cut_lineage(grams)
    kept = _most_frequent(grams, ["lang", "size"], settings.grams)
    words = _table(known, counts.withColumn("size", F.lit(0)), "word", languages, settings)
    found = _table(kept, grams, "gram", languages, settings)
    return Model(languages, *words, *found, settings)


def _table(
    kept: DataFrame, counts: DataFrame, entry: str, languages: tuple[str, ...], settings: Settings
) -> tuple[dict[str, int], np.ndarray]:
    """Index and log frequencies of the entries ``kept`` for any language.

    ``counts`` are all (entry, size, lang, n); a count is set against those of the same size, all entries included.
    """
    column = {lang: i for i, lang in enumerate(languages)}
    totals: dict[int, np.ndarray] = {}
    for r in counts.groupBy("size", "lang").agg(F.sum("n").alias("total")).collect():
        totals.setdefault(r["size"], np.zeros(len(languages)))[column[r["lang"]]] = r["total"]
    distinct = counts.select("size", entry).distinct().groupBy("size").agg(F.count("*").alias("entries"))
    for r in distinct.collect():
        totals[r["size"]] += settings.smooth * (r["entries"] + 1)

    found = counts.join(kept.select(entry).distinct(), entry).select(entry, "size", "lang", "n")
    rows = list(zip(*(c.to_pylist() for c in found.toArrow().columns), strict=True))
    index: dict[str, int] = {}
    for text, *_ in sorted(rows):
        index.setdefault(text, len(index))
    seen = np.full((len(index), len(languages)), settings.smooth)
    logs = np.zeros((len(index) + 1, len(languages)))
    for text, size, lang, n in rows:
        seen[index[text], column[lang]] += n
        logs[index[text]] = -np.log(totals[size])
    logs[:-1] += np.log(seen)
    return index, logs


def unseen_word(word: str, grams: dict[str, int], longest: int) -> tuple[list[int], int]:
    """Rows of the longest known n-grams along the word, and the steps down to them."""
    padded = f"_{word}_"
    rows, steps = [], 0
    for at in range(len(padded) - 1):
        size = min(longest, len(padded) - at)
        row = grams.get(padded[at : at + size])
        while row is None and size > 1:
            size -= 1
            row = grams.get(padded[at : at + size])
        if row is not None:
            rows.append(row)
            steps += longest - size
    return rows, steps


def predict_text(text: str | None, model: Model) -> tuple[str, float]:
    """(language, its share of the likelihood). Without a letter or a model: unknown, 0.

    An unseen word counts the mean over its places; one without a known character counts nothing.
    """
    found = Counter(find_words(text))
    if not found or not model.languages:
        return UNKNOWN, 0.0
    rows, counts, parts, weights = [], [], [], []
    penalty = 0.0
    words, grams, longest = model.words, model.grams, model.settings.longest
    for word, n in found.items():
        row = words.get(word)
        if row is not None:
            rows.append(row)
            counts.append(n)
            continue
        places, steps = unseen_word(word, grams, longest)
        if places:
            share = n / len(places)
            parts += places
            weights += [share] * len(places)
            penalty += share * steps
    total = np.full(len(model.languages), penalty * math.log(model.settings.step))
    if rows:
        total += np.asarray(counts, dtype=float) @ model.word_logs[rows]
    if parts:
        total += np.asarray(weights) @ model.gram_logs[parts]
    best = int(np.argmax(total))
    share = 1.0 / np.exp(total - total[best]).sum()
    return model.languages[best], float(min(1.0, share))


def identify(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()
) -> DataFrame:
    """(id, columns ``carry``, lang_pred, score) of every row, told from its text alone.

    Of equally likely languages the first by name wins. Null text and text without a letter: ``und`` with score 0. A text
    whose letters the model has never seen is given nearly the same share for each language.
    """
    names = [id_col, *carry]
    rows = docs.select(
        F.col(text_col).cast("string").alias("_text"), *[F.col(n).alias(f"_c{i}") for i, n in enumerate(names)]
    )
    kept = [(f"_c{i}", docs.schema[n].dataType.simpleString()) for i, n in enumerate(names)]
    return _apply(rows, model, kept).withColumnsRenamed({f"_c{i}": n for i, n in enumerate(names)})


def _apply(rows: DataFrame, model: Model, kept: list[tuple[str, str]]) -> DataFrame:
    """Predictions for ``_text``; the columns ``kept`` travel along."""
    names = [n for n, _ in kept]
    parts = (model.languages, model.words, model.word_logs, model.grams, model.gram_logs)
    shared = rows.sparkSession.sparkContext.broadcast(parts)  # plain values: workers need not know the class
    settings = model.settings

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value, settings)
        for batch in batches:
            out = [predict_text(t.as_py(), known) for t in batch.column("_text")]
            columns = [batch.column(n) for n in names]
            columns += [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "lang_pred", "score"])

    schema = ", ".join(f"`{n}` {k}" for n, k in [*kept, ("lang_pred", "string"), ("score", "double")])
    return rows.mapInArrow(predict, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that no model may learn from: crc32 of the id as text leaves 2 when divided by 4. False for null."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def keep_known(
    docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5
) -> DataFrame:
    """Rows whose language is told with a share of at least ``least``; columns as given."""
    names = docs.columns
    kinds = [(f.name, f.dataType.simpleString()) for f in docs.schema.fields]
    rows = docs.withColumn("_text", F.col(text_col).cast("string"))
    clash = {n: f"_c{i}" for i, n in enumerate(names)}
    rows = rows.select("_text", *[F.col(f"`{n}`").alias(c) for n, c in clash.items()])
    found = _apply(rows, model, [(clash[n], k) for n, k in kinds])
    found = found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select(*[F.col(c).alias(n) for n, c in clash.items()])
