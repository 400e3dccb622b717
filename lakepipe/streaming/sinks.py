"""Running streams: triggers, append sinks, and per-batch folders that may be replayed."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from lakepipe.sources.files import create_file, list_files, list_folders, path_exists, read_small_text

BATCH = "batch_id"
#: Writers of a target number their batches from multiples of this.
STRIDE = 10**12
WRITERS = "_writers"


def with_trigger(writer: DataStreamWriter, every: str | None = None) -> DataStreamWriter:
    """``None``: work off what is there, then stop. Otherwise an interval like ``6 hours``."""
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def append_stream(
    stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", every: str | None = None
) -> StreamingQuery:
    """Append to files exactly once (file sink log plus checkpoint)."""
    writer = stream.writeStream.format(fmt).option("checkpointLocation", checkpoint).option("path", path)
    return with_trigger(writer.outputMode("append"), every).start()


def append_stream_to_table(
    stream: DataFrame, table: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode("append")
    return with_trigger(writer, every).toTable(table)


def writer_number(spark: SparkSession, target: str, checkpoint: str) -> int:
    """Which writer of the target this checkpoint is, counted from 0 in the order of their first start.

    A new checkpoint is a new writer. A checkpoint that has written elsewhere is refused, and so is one that a later
    writer has taken over from: a target has one writer at a time.
    """
    mark, folder = f"{checkpoint}/writer", f"{target}/{WRITERS}"
    name = read_small_text(spark, mark)
    known = []
    if path_exists(spark, folder):
        known = [read_small_text(spark, f) for f in sorted(list_files(spark, folder))]
    if name is not None:
        if name not in known:
            raise ValueError(f"checkpoint {checkpoint} belongs to another target than {target}")
        if name != known[-1]:
            raise ValueError(f"a later checkpoint writes to {target}; {checkpoint} cannot go on")
        return known.index(name)
    name = uuid.uuid4().hex
    number = len(known)
    if not create_file(spark, f"{folder}/{number:06d}", name):
        raise ValueError(f"another writer has just started on {target}")
    create_file(spark, mark, name)
    return number


def each_batch(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    every: str | None = None,
    target: str | None = None,
) -> StreamingQuery:
    """Hand each batch and its number to ``handle``.

    With a ``target`` the numbers of its writers do not meet: a new checkpoint goes on behind all batches of the former.
    """
    first = 0 if target is None else STRIDE * writer_number(stream.sparkSession, target, checkpoint)
    writer = (
        stream.writeStream.foreachBatch(lambda batch, number: handle(batch, first + number))
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
    )
    return with_trigger(writer, every).start()


def write_batch(df: DataFrame, path: str, batch_id: int, partition_by: Sequence[str] = ()) -> None:
    """Write one micro-batch to its own folder; a replayed batch replaces itself."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(f"{path}/{BATCH}={batch_id}")


def last_batch(spark: SparkSession, path: str) -> int:
    """Number of the newest batch whose write was completed; batches are written one after another."""
    numbers = sorted((int(n.split("=")[1]) for n in list_folders(spark, path)), reverse=True)
    for number in numbers:
        if path_exists(spark, f"{path}/{BATCH}={number}/_SUCCESS"):
            return number
    raise FileNotFoundError(f"no completed batch below {path}")


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All completed batches, with their ``batch_id``; a batch being written is left out.

    The schemas of all batches are merged: a column that came later is null before.
    """
    log = spark.read.option("mergeSchema", True).option("basePath", path).parquet(f"{path}/{BATCH}=*")
    return log.filter(F.col(BATCH) <= last_batch(spark, path))


def drain(queries: StreamingQuery | Iterable[StreamingQuery]) -> None:
    """Wait for the queries to finish; an error in one of them is raised."""
    for query in [queries] if isinstance(queries, StreamingQuery) else list(queries):
        query.awaitTermination()
