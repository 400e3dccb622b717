"""Named queries of the text operators: each applies one to its whole table with production settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepipe.llm import (
    decontaminate,
    exact_dedup,
    filter_audit,
    language,
    licenses,
    minhash,
    oracle,
    pieces,
    sentence_spans,
    site_quality,
    square_runs,
    suffix_buckets,
    token_counts,
    url_filter,
)
from lakepipe.llm.common import let, read

Run = Callable[[SparkSession, str], DataFrame]


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(read(spark, sf_dir, "documents"), size=3, percent=85).drop("_h", "root")


def op3_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.withColumn("items_sha256", F.sha2(F.concat_ws(",", "items"), 256)).drop("items")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.train(docs.where(~language.held_out()))
    unseen = docs.select("doc_id", language.held_out().alias("held_out"), "text")
    return language.identify(unseen, model, carry=["held_out"])


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = sentence_spans.remove_repeats(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_sentences", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_buckets.remove_repeated_bytes(read(spark, sf_dir, "documents"))


def _loop_some(doc_id: Column, text: Column) -> Column:
    """The text; for one in ten documents, by the id's checksum, a stretch of words repeats from some place to the end."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def looped(words: Column) -> Column:
        n = F.size(words)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        tail = F.transform(F.sequence(F.lit(0), n - a - 1), lambda i: F.get(words, a + i % p))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, 1, a), tail), " ")).otherwise(text)

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(h % 10 == 0, let(words, looped)).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    looped = docs.select("doc_id", _loop_some(F.col("doc_id"), F.col("text")).alias("text"))
    found = square_runs.collapse_runs(looped)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        *[c for c in found.columns if c not in ("runs", "collapsed")],
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


#: name -> (run, SQL twin or None)
QUERIES: dict[str, tuple[Run, str | None]] = {
    "op1_license_scan": (op1_license_scan, None),
    "op2_minhash_near_dedup": (op2_minhash_near_dedup, oracle.NEAR_DEDUP),
    "op3_site_quality": (op3_site_quality, None),
    "op4_decontaminate": (op4_decontaminate, oracle.DECONTAMINATE),
    "op5_sentencepiece": (op5_sentencepiece, None),
    "op6_url_filter": (op6_url_filter, oracle.URL_FILTER),
    "op7_language_id": (op7_language_id, None),
    "op8_sentence_spans": (op8_sentence_spans, None),
    "op9_exact_dedup": (op9_exact_dedup, oracle.EXACT_DEDUP),
    "op10_suffix_dedup": (op10_suffix_dedup, None),
    "op11_periodic_runs": (op11_periodic_runs, None),
    "op12_token_counts": (op12_token_counts, None),
    "op13_filter_audit": (op13_filter_audit, oracle.FILTER_AUDIT),
}
