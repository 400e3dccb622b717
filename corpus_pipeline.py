"""From raw documents to token ids, in stages that each keep what the next one works on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakepipe.llm import decontaminate, exact_dedup, language, minhash, pieces
from lakepipe.llm.common import read, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; text without letters and undecided text go."""
    return language.keep_known(docs, language.train(docs.where(~language.held_out())))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words with a similarity of 0.8 or more."""
    return minhash.drop_near_copies(docs)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than one in twenty stand in benchmark windows."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document that is left."""
    return pieces.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("exact", drop_exact_copies),
    ("near", drop_near_copies),
    ("decontaminate", drop_benchmark_copies),
    ("pieces", encode_pieces),
]

#: Language ID is learned from the corpus: SQL cannot express it. The stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    *first, (_, last) = STAGES
    for name, stage in first:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return last(spark, docs, sf_dir)
