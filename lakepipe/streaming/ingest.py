"""Landing folders to raw tables, as streams."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakepipe.sources.files import FIELDS, infer_schema, list_folders, read_bound, remembered_schema, stream_files
from lakepipe.streaming.sinks import append_stream, drain, each_batch, write_batch


# Fixed value: the columns of Spark's file source.
FILE = "path string, modificationTime timestamp, length long, content binary"


#: Files of a batch, where nothing else is asked for.
FILES_PER_BATCH = 10_000


def stamped(df: DataFrame, column: str = "processing_time") -> DataFrame:
    """With the time at which a row arrived: that of its batch."""
    return df.withColumn(column, F.current_timestamp())


def ingest_folder(
    spark: SparkSession,
    folder: str,
    fmt: str,
    target: str,
    state: str,
    every: str | None = None,
    stamp: str | None = None,
    **options,
) -> StreamingQuery:
    """Start reading a folder into a table; schema and progress live below ``state``.

    What does not fit the schema is kept in ``_rescued_data``, field by field. CSV, Parquet and multi-line JSON are read
    by the names in each file, and each batch is a folder of the table. ``stamp`` names a column for the arrival time.
    """
    options.setdefault("rescue", FIELDS)
    if fmt != "json" or options.get("multi_line"):
        return _ingest_by_name(spark, folder, fmt, target, state, every, stamp, **options)
    stream = stream_files(spark, folder, fmt, schema_location=f"{state}/schema", **options)
    return append_stream(stamped(stream, stamp) if stamp else stream, target, f"{state}/checkpoint", every=every)


def _ingest_by_name(
    spark: SparkSession,
    folder: str,
    fmt: str,
    target: str,
    state: str,
    every: str | None,
    stamp: str | None,
    rescue: str | None,
    schema=None,
    infer_types: bool = True,
    hints: str | None = None,
    sample_files: int | None = None,
    evolve: bool = False,
    multi_line: bool = False,
    max_files_per_trigger: int | None = None,
    options: Mapping[str, str] | None = None,
) -> StreamingQuery:
    """The stream delivers the names of new files; each batch reads its files by their own columns."""
    chosen = {**(options or {}), **({"multiLine": "true"} if multi_line else {})}
    if schema is None:
        schema = remembered_schema(
            spark,
            f"{state}/schema",
            lambda: infer_schema(spark, folder, fmt, infer_types, hints, sample_files, chosen),
            evolve,
        )
    # the names of a batch pass through the driver
    limit = {"maxFilesPerTrigger": str(max_files_per_trigger or FILES_PER_BATCH)}
    # only the names are asked for, so the files' content is not read here
    names = spark.readStream.format("binaryFile").schema(FILE).options(**limit).load(folder).select("path")

    def handle(batch: DataFrame, batch_id: int) -> None:
        paths = sorted(r["path"] for r in batch.collect())
        rows = read_bound(batch.sparkSession, paths, fmt, schema, rescue, chosen)
        write_batch(stamped(rows, stamp) if stamp else rows, target, batch_id)

    return each_batch(names, handle, f"{state}/checkpoint", every=every, target=target)


def ingest_folders(
    spark: SparkSession, folders: Mapping[str, str], root: str, target: str, state: str, **options
) -> dict[str, str]:
    """Ingest several ``{folder: format}`` at the same time and wait for all; returns their tables."""
    queries = [
        ingest_folder(spark, f"{root}/{name}", fmt, f"{target}/{name}", f"{state}/{name}", **options)
        for name, fmt in folders.items()
    ]
    drain(queries)
    return {name: f"{target}/{name}" for name in folders}


def ingest_all(
    spark: SparkSession, root: str, fmt: str, target: str, state: str, **options
) -> dict[str, str]:
    """One raw table per sub-folder found below ``root``."""
    folders = {name: fmt for name in list_folders(spark, root)}
    return ingest_folders(spark, folders, root, target, state, **options)
