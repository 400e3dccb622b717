"""Batch writes: tables, files, clustered layout, compaction, snapshot rewrites."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakepipe.operators.changes import keep_unless
from lakepipe.operators.ranges import interleaved_rank
from lakepipe.sources.files import (
    create_file,
    delete_file,
    delete_folder,
    list_folders,
    list_hidden,
    list_tree,
    move_file,
    path_exists,
    read_small_text,
)

FILE_BYTES = 256 * 2**20
MAX_FILES = 1_000_000
#: Types whose values take eight bytes of a row, or little more.
FIXED_TYPES = (T.NumericType, T.BooleanType, T.DatetimeType, T.AnyTimeType, T.NullType, T.DayTimeIntervalType)


def write_files(
    df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", files: int | None = None
) -> None:
    """Write files; ``files`` fixes their number by an even redistribution of the rows."""
    if files:
        df = df.repartition(files)
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def overwrite_table(df: DataFrame, name: str, fmt: str = "parquet") -> None:
    """Replace a table, with the schema of the frame."""
    df.write.format(fmt).mode("overwrite").option("overwriteSchema", True).saveAsTable(name)


def append_table(df: DataFrame, name: str, fmt: str = "parquet") -> None:
    df.write.format(fmt).mode("append").saveAsTable(name)


def create_table(spark: SparkSession, name: str, columns: str, fmt: str = "parquet") -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {fmt}")


def insert_rows(spark: SparkSession, name: str, values: str) -> None:
    spark.sql(f"INSERT INTO {name} VALUES {values}")


def file_count(df: DataFrame, bytes_per_file: int = FILE_BYTES) -> int:
    """Files for whose rows a task reads about ``bytes_per_file``, by one pass over the frame that counts rows and bytes.

    Stored files are as much smaller as they compress. Spark's own estimate goes by the stored size of its input, so it
    would hand one task many times the wanted bytes of a table that compresses well.
    """
    rows = F.count(F.lit(1)) * F.lit(8 + 8 * len(df.columns))
    sized = [f"`{f.name}`" for f in df.schema.fields if not isinstance(f.dataType, FIXED_TYPES)]
    texts = [F.coalesce(F.sum(F.octet_length(F.col(c).cast("string"))), F.lit(0)) for c in sized]
    size = df.agg(sum(texts, rows).alias("n")).first()["n"]
    return max(1, min(MAX_FILES, math.ceil(size / bytes_per_file)))


def clustered(
    df: DataFrame, columns: Sequence[str], files: int | None = None, interleave: bool = False
) -> DataFrame:
    """Rows laid out so that file statistics can skip files for filters on ``columns``.

    Sorted by the columns in turn, which serves filters on the first one. With ``interleave`` by their quantile ranks with
    the bits interleaved, so that a filter on any one of them skips files; the frame is then read three times, and again by
    the sort's own sample.

    Without ``files`` their number follows from the size of the rows, for which they are read once more. A hash of the row ranks below the layout columns, so
    one frequent value is spread over several neighbouring files instead of ending in a single task.
    """
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"layout columns not in the table: {missing}")
    files = files or file_count(df)
    spread = df.withColumn("__spread", F.xxhash64(*df.columns))
    if interleave:
        spread = interleaved_rank(spread, columns, "__rank", bits=min(10, 60 // len(columns)))
        placed = spread.repartitionByRange(files, "__rank", "__spread").sortWithinPartitions("__rank")
        return placed.drop("__rank", "__spread")
    return (
        spread.repartitionByRange(files, *columns, "__spread")
        .sortWithinPartitions(*columns)
        .drop("__spread")
    )


def write_clustered(
    df: DataFrame,
    path: str,
    columns: Sequence[str],
    files: int | None = None,
    mode: str = "overwrite",
    interleave: bool = False,
) -> None:
    clustered(df, columns, files, interleave).write.mode(mode).parquet(path)


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """Names of a table's folder levels (``name=value``), outermost first."""
    names: list[str] = []
    while folders := [f for f in list_folders(spark, path) if "=" in f]:
        names.append(folders[0].split("=")[0])
        path = f"{path}/{folders[0]}"
    return names


def compact(spark: SparkSession, path: str, target: str, rows_per_file: int) -> int:
    """Copy a table of many small files into evenly filled files; returns the file count.

    Folder levels are kept: rows of a folder go together, and a large folder gets several files.
    """
    df = spark.read.parquet(path)
    levels = partition_columns(spark, path)
    if levels:
        sizes = df.groupBy(*levels).agg(F.ceil(F.count("*") / rows_per_file).cast("int").alias("__files"))
        named = sizes.select(*[F.col(c).alias(f"__{c}") for c in levels], "__files")
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in levels]
        spots = df.join(named, same).withColumn("__spot", F.pmod(F.xxhash64(*df.columns), F.col("__files")))
        files = sizes.agg(F.sum("__files")).first()[0] or 0
        placed = spots.repartition(max(1, files), *levels, "__spot").select(*df.columns)
        placed.write.mode("overwrite").partitionBy(*levels).parquet(target)
        return files
    files = max(1, math.ceil(df.count() / rows_per_file))
    df.repartition(files).write.mode("overwrite").parquet(target)
    return files


def rewrite_without(
    spark: SparkSession, path: str, target: str, predicate: str | Column
) -> None:
    """New snapshot of a table without the rows that match ``predicate``; folder levels are kept."""
    kept = keep_unless(spark.read.parquet(path), predicate)
    kept.write.mode("overwrite").partitionBy(*partition_columns(spark, path)).parquet(target)


def delete_rows(spark: SparkSession, path: str, predicate: str | Column, max_files: int = 100_000) -> int:
    """Delete the rows that match ``predicate`` in place; only files that hold such rows are written again.

    One pass finds the files with hits (column statistics skip files that cannot have any). Their other rows are written to
    new files of the same folders first, then the old files go. A run that was cut short between the two leaves a mark
    with the old files' names: the next call, or ``finish_delete``, removes them. Readers in between may see rows of these
    files twice. More than ``max_files`` files with hits are refused, as their names pass through the driver: rewrite the
    table then. Returns the number of files replaced.
    """
    finish_delete(spark, path)
    levels = partition_columns(spark, path)
    table = spark.read.parquet(path)
    condition = F.expr(predicate) if isinstance(predicate, str) else predicate
    hits = table.where(condition).select(F.col("_metadata.file_path").alias("file")).distinct()
    names = sorted(r["file"] for r in hits.limit(max_files + 1).collect())
    if len(names) > max_files:
        raise ValueError(f"more than {max_files} files hold rows to delete: rewrite the table instead")
    if not names:
        return 0
    staged = f"{path}/_delete-{uuid.uuid4().hex}"
    old = spark.read.option("basePath", path).parquet(*[unquote(n) for n in names]).select(*table.columns)
    keep_unless(old, condition).write.partitionBy(*levels).parquet(f"{staged}/rows")
    create_file(spark, f"{staged}/ready", "\n".join(unquote(n) for n in names))
    finish_delete(spark, path)
    return len(names)


def finish_delete(spark: SparkSession, path: str) -> None:
    """Put a delete that was cut short into effect, or drop it where it had not been ready."""
    if not path_exists(spark, path):
        return
    for staged in list_hidden(spark, path, "_delete-"):
        names = read_small_text(spark, f"{staged}/ready")
        if names is not None:
            for file in list_tree(spark, f"{staged}/rows"):
                move_file(spark, file, f"{path}/{file.split('/rows/', 1)[1]}")
            for name in names.split("\n"):
                delete_file(spark, name)
        delete_folder(spark, staged)


def read_evolved(spark: SparkSession, path: str) -> DataFrame:
    """Read a folder whose files gained columns over time; older rows get nulls."""
    return spark.read.option("mergeSchema", True).parquet(path)
