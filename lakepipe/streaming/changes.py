"""Apply a change stream to a target.

Every micro-batch appends its changes as a folder of the target's change log; state
is a reduction over that log when it is read. A micro-batch costs what its own rows
cost, never a rewrite of the target; a replayed batch replaces its own folder; late
changes need no special case because order comes from the sequence alone.
``fold_changes`` is a batch job that stores what the log adds up to. A stored history
(``start_scd2_stored``, or ``refresh_scd2`` beside a log) grows by the entries that new
changes add or alter, so that readers need not derive it each time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakepipe.operators.changes import apply_changes_scd2, reduce_changes, splice_changes
from lakepipe.sources.files import create_file, list_folders, path_exists, read_small_text
from lakepipe.streaming.sinks import BATCH, drain, each_batch, last_batch, read_batches, write_batch

BUCKET = "__bucket"
BUCKETS = 256


def start_scd1(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    keys: str | Sequence[str],
    sequence_by: str | Sequence[str],
    apply_as_deletes: str | Column | None = None,
    tie_breaker: str | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Log the last change per key of each batch, deletes included as tombstones."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        latest = reduce_changes(batch, keys, sequence_by, apply_as_deletes, tie_breaker)
        write_batch(latest, f"{target}/changes", batch_id)

    return each_batch(stream, handle, checkpoint, every=every, target=target)


def _folded_upto(spark: SparkSession, target: str) -> int | None:
    base = f"{target}/base"
    if not path_exists(spark, base):
        return None
    done = [
        int(name.split("=")[1])
        for name in list_folders(spark, base)
        if path_exists(spark, f"{base}/{name}/_SUCCESS")
    ]
    return max(done, default=None)


def _reduced_log(
    spark: SparkSession,
    target: str,
    keys: str | Sequence[str],
    sequence_by: str | Sequence[str],
    upto: int | None = None,
) -> DataFrame:
    log = read_batches(spark, f"{target}/changes")
    if upto is not None:
        log = log.filter(F.col(BATCH) <= upto)
    folded = _folded_upto(spark, target)
    if folded is not None:
        newer = log.filter(F.col(BATCH) > folded).drop(BATCH)
        log = spark.read.parquet(f"{target}/base/upto={folded}").unionByName(newer, allowMissingColumns=True)
    else:
        log = log.drop(BATCH)
    return reduce_changes(log, keys, sequence_by)


def read_scd1(
    spark: SparkSession,
    target: str,
    keys: str | Sequence[str],
    sequence_by: str | Sequence[str],
    except_columns: Sequence[str] = (),
) -> DataFrame:
    """Current state of a target fed by ``start_scd1``."""
    return (
        _reduced_log(spark, target, keys, sequence_by)
        .filter(~F.col("__deleted"))
        .drop("__deleted", "__tie", *except_columns)
    )


def fold_changes(
    spark: SparkSession, target: str, keys: str | Sequence[str], sequence_by: str | Sequence[str]
) -> int:
    """Fold all logged batches into one base table (tombstones kept); returns the last batch folded."""
    upto = last_batch(spark, f"{target}/changes")
    reduced = _reduced_log(spark, target, keys, sequence_by, upto)
    reduced.write.mode("overwrite").parquet(f"{target}/base/upto={upto}")
    return upto


def apply_folders(
    spark: SparkSession,
    raw: Mapping[str, str],
    clean: Callable[[DataFrame], DataFrame],
    target: str,
    state: str,
    keys: str | Sequence[str],
    sequence_by: str | Sequence[str],
    apply_as_deletes: str | Column | None = None,
) -> dict[str, str]:
    """The same clean-and-apply flow for every ``{name: raw table}``, run side by side."""
    queries = [
        start_scd1(
            clean(spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)),
            f"{target}/{name}",
            f"{state}/{name}",
            keys,
            sequence_by,
            apply_as_deletes,
        )
        for name, path in raw.items()
    ]
    drain(queries)
    return {name: f"{target}/{name}" for name in raw}


def _bucket_count(spark: SparkSession, target: str, wanted: int | None) -> int:
    kept = f"{target}/_buckets"
    create_file(spark, kept, str(wanted or BUCKETS))
    found = int(read_small_text(spark, kept))
    if wanted not in (None, found):
        raise ValueError(f"{target} has {found} buckets, not {wanted}")
    return found


def start_scd2(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    keys: str | Sequence[str],
    buckets: int | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Log every change of the stream, foldered by a hash bucket of the key.

    The number of buckets is kept with the target (``BUCKETS`` at first, unless given); another one is refused later.
    """
    names = [keys] if isinstance(keys, str) else list(keys)
    buckets = _bucket_count(stream.sparkSession, target, buckets)

    def handle(batch: DataFrame, batch_id: int) -> None:
        placed = _place(batch, names, buckets)
        # rows of a bucket go together, adaptive execution merges small ones and splits a hot one
        write_batch(placed.hint("rebalance", BUCKET), f"{target}/changes", batch_id, [BUCKET])

    return each_batch(stream, handle, checkpoint, every=every, target=target)


def read_scd2(
    spark: SparkSession,
    target: str,
    keys: str | Sequence[str],
    sequence_by: str | Sequence[str],
    **options,
) -> DataFrame:
    """History derived from the whole log; late changes split the version they fall into."""
    feed = read_batches(spark, f"{target}/changes").drop(BATCH, BUCKET)
    return apply_changes_scd2(feed, keys, sequence_by, **options)


def _place(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _described(spark: SparkSession, target: str, wanted: Mapping[str, object] | None = None) -> dict:
    """Keys, sequence and hidden columns of the stored versions, kept with the target; others are refused later."""
    kept = f"{target}/_versions"
    if wanted is not None:
        create_file(spark, kept, json.dumps(wanted))
    found = read_small_text(spark, kept)
    if found is None:
        raise FileNotFoundError(f"no stored versions below {target}")
    found = json.loads(found)
    if wanted is not None and found != wanted:
        raise ValueError(f"{target} was begun with {found}, not {wanted}")
    return found


def _entries(
    spark: SparkSession, target: str, below: int | None = None, buckets: Sequence[int] | None = None
) -> DataFrame | None:
    """Newest form of every stored entry, from the folded table and the batches after it (only those before ``below``)."""
    layout = _described(spark, target)
    base, log = f"{target}/versions_base", f"{target}/versions"
    done = [int(n.split("=")[1]) for n in list_folders(spark, base)] if path_exists(spark, base) else []
    folded = max((n for n in done if path_exists(spark, f"{base}/upto={n}/_SUCCESS")), default=None)
    parts = []
    if folded is not None and (below is None or folded < below):
        parts.append(spark.read.parquet(f"{base}/upto={folded}").withColumn(BATCH, F.lit(folded).cast("long")))
    numbers = [int(n.split("=")[1]) for n in list_folders(spark, log)] if path_exists(spark, log) else []
    newer = [
        f"{log}/{BATCH}={n}"
        for n in sorted(numbers)
        if (not parts or n > folded) and (below is None or n < below) and path_exists(spark, f"{log}/{BATCH}={n}/_SUCCESS")
    ]
    # a batch that altered nothing has no file, and no schema
    newer = [p for p in newer if list_folders(spark, p)]
    if newer:
        read = spark.read.option("mergeSchema", True).option("basePath", log).parquet(*newer)
        parts.append(read.withColumn(BATCH, F.col(BATCH).cast("long")))
    if not parts:
        return None
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if buckets is not None:
        found = found.filter(F.col(BUCKET).isin(list(buckets)))
    at = [*layout["keys"], *layout["sequence"], BUCKET]
    rest = [c for c in found.columns if c not in {*at, BATCH}]
    newest = found.groupBy(*at).agg(F.max_by(F.struct(*rest), F.col(BATCH)).alias("__row"))
    return newest.select(*at, "__row.*")


def _splice_batch(spark: SparkSession, target: str, new: DataFrame, number: int, **options) -> None:
    layout, buckets = _described(spark, target), _bucket_count(spark, target, None)
    # read for its buckets, for its earliest changes, and to be merged
    new = _place(new, layout["keys"], buckets).persist()
    # at most one row per bucket
    touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())
    known = _entries(spark, target, number, touched)
    altered = splice_changes(known, new, layout["keys"], layout["sequence"], **options)
    write_batch(altered.hint("rebalance", BUCKET), f"{target}/versions", number, [BUCKET])
    new.unpersist()


def start_scd2_stored(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    keys: str | Sequence[str],
    sequence_by: str | Sequence[str],
    apply_as_deletes: str | None = None,
    except_columns: Sequence[str] = (),
    tie_breaker: str | None = None,
    buckets: int | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Keep the versions stored: each micro-batch writes the entries it adds or whose end it moves, and no others.

    Only the buckets (by hash of the key) that hold keys of the batch are read. A late change splits the version it falls
    into; a batch that comes twice replaces its own folder. Readers see whole batches only. ``fold_versions`` merges the
    batches from time to time.
    """
    spark = stream.sparkSession
    names = [[x] if isinstance(x, str) else list(x) for x in (keys, sequence_by)]
    _bucket_count(spark, target, buckets)
    _described(spark, target, {"keys": names[0], "sequence": names[1], "hidden": list(except_columns)})

    def handle(batch: DataFrame, number: int) -> None:
        options = {"apply_as_deletes": apply_as_deletes, "tie_breaker": tie_breaker}
        _splice_batch(batch.sparkSession, target, batch, number, **options)

    return each_batch(stream, handle, checkpoint, every=every, target=target)


def refresh_scd2(
    spark: SparkSession,
    target: str,
    keys: str | Sequence[str],
    sequence_by: str | Sequence[str],
    apply_as_deletes: str | None = None,
    except_columns: Sequence[str] = (),
    tie_breaker: str | None = None,
) -> int:
    """Bring versions stored beside a log of ``start_scd2`` up to its newest batch; returns the last batch seen.

    The changes logged since the last refresh are spliced in as one batch: only entries they add or whose end they move
    are written. A refresh that was cut short is simply run again.
    """
    names = [[x] if isinstance(x, str) else list(x) for x in (keys, sequence_by)]
    _described(spark, target, {"keys": names[0], "sequence": names[1], "hidden": list(except_columns)})
    versions = f"{target}/versions"
    upto = last_batch(spark, f"{target}/changes")
    done = last_batch(spark, versions) if path_exists(spark, versions) else -1
    if done < upto:
        log = read_batches(spark, f"{target}/changes")
        new = log.filter((F.col(BATCH) > done) & (F.col(BATCH) <= upto)).drop(BATCH, BUCKET)
        _splice_batch(spark, target, new, upto, apply_as_deletes=apply_as_deletes, tie_breaker=tie_breaker)
    return upto


def fold_versions(spark: SparkSession, target: str) -> int:
    """Merge all stored entries into one table, by bucket; returns the last batch folded."""
    upto = last_batch(spark, f"{target}/versions")
    entries = _entries(spark, target, upto + 1)
    if entries is not None:
        (
            entries.hint("rebalance", BUCKET)
            .write.mode("overwrite")
            .partitionBy(BUCKET)
            .parquet(f"{target}/versions_base/upto={upto}")
        )
    return upto


def read_versions(
    spark: SparkSession, target: str, start_column: str = "start_at", end_column: str = "end_at"
) -> DataFrame:
    """The stored versions, as of the newest complete batch."""
    layout = _described(spark, target)
    entries = _entries(spark, target)
    if entries is None:
        raise FileNotFoundError(f"no stored versions below {target}")
    shown = entries.filter(~F.col("__deleted")).withColumnsRenamed({"__end": end_column})
    shown = shown.withColumn(start_column, F.col(layout["sequence"][0]))
    return shown.drop("__tie", "__deleted", BUCKET, *layout["hidden"])
