"""Exact dedup by most-significant-byte-first radix partitioning.

Documents start in one bucket. Each level splits every open bucket by the next run of bytes and by whether a document
ends inside it. A bucket with one document is settled, a bucket whose documents all end together is a group of equal
texts; the others go on. Only bytes are compared: no digest decides equality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepipe.llm.common import join_rows, keyed, without_rows
from lakepipe.session import cut_lineage

BLANKS = r"[\x20\x09-\x0D]+"


def _name() -> Column:
    """A bucket is named after its least row; null ids come last."""
    return F.struct(F.col("_id").isNull().alias("none"), F.col("_id"), F.col("_h"))


def normalized(text: Column) -> Column:
    """Each run of white space becomes one space; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def _slice(offset: int, width: int) -> list[Column]:
    """The next bytes, and the text's length where it ends within them (else -1)."""
    length = F.length("_body")
    return [
        F.substring("_body", offset + 1, width).alias("_next"),
        F.when(length <= offset + width, length).otherwise(-1).alias("_end"),
    ]


def _split(rows: DataFrame) -> DataFrame:
    """Rows of buckets with several documents, with the bucket's new name and size.

    The per-bucket figures come from an aggregate with a map side; the join back has one row per bucket on the other
    side, so a bucket that holds a third of all rows is cut up by Spark's skew join.
    """
    named = (
        rows.groupBy("_bucket", "_next", "_end")
        .agg(F.min(_name()).alias("_name"), F.min("_id").alias("_first"), F.count("*").alias("_n"))
        .where("_n > 1")
    )
    on = ["_bucket", "_next", "_end"]
    return rows.join(named, on).select("_id", "_h", "_end", "_name", "_first", "_n")


def equal_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 128, growth: int = 8
) -> DataFrame:
    """Rows of texts that occur more than once: (_id, _h, _name, _first, _n), once per distinct (id, text).

    ``_name`` stands for the group, ``_first`` is the smallest id of the group (null only if all are null), ``_n`` its number of rows. ``width`` is the
    number of bytes of the first level; each later one takes ``growth`` times more. Null text counts as empty.
    """
    rows = keyed(docs, id_col, text_col).withColumn("_body", F.encode(normalized(F.col("_text")), "UTF-8"))
    start = F.struct(
        F.lit(True).alias("none"),
        F.lit(None).cast(docs.schema[id_col].dataType).alias("_id"),
        F.lit(0).cast("long").alias("_h"),
    )
    level = _split(rows.select("_id", "_h", start.alias("_bucket"), *_slice(0, width)))
    level = cut_lineage(level)
    ended = "_end >= 0"
    found = [level.where(ended)]
    going = level.where(f"NOT {ended}").drop("_first", "_n", "_end")
    if going.isEmpty():
        return _together(found)
    # only documents that share their start with another one are needed from here on
    open_rows = going.select("_id", "_h").distinct()
    bodies = join_rows(rows, open_rows, "left_semi").select("_id", "_h", "_body")
    bodies = cut_lineage(bodies)
    offset = width
    while not going.isEmpty():
        width *= growth
        # a row given twice is in both frames twice: names are made unique, bodies keep the count
        names = going.dropDuplicates(["_id", "_h"]).withColumnRenamed("_name", "_bucket")
        part = join_rows(bodies.select("_id", "_h", *_slice(offset, width)), names)
        level = cut_lineage(_split(part.select("_id", "_h", "_bucket", "_next", "_end")))
        found.append(level.where(ended))
        going = level.where(f"NOT {ended}").drop("_first", "_n", "_end")
        offset += width
    return _together(found)


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("_id", "_h", "_name", "_first", "_n").dropDuplicates(["_id", "_h"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256`` of the normalised text.

    Null text counts as empty, empty texts are equal to one another. A null id comes after every other id. Rows that
    repeat an id with an equal text all carry the same answer and all count in ``group_size``.
    """
    rows = keyed(docs, id_col, text_col).select(
        "_id", "_h", F.sha2(F.encode(normalized(F.col("_text")), "UTF-8"), 256).alias("text_sha256")
    )
    keep = F.when(F.col("_n").isNotNull(), F.col("_first")).otherwise(F.col("_id"))
    return join_rows(rows, equal_texts(docs, id_col, text_col), "left").select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without later copies, columns as given: of each group the row of the smallest id stays.

    Of rows that repeat an id with an equal text one stays.
    """
    groups = equal_texts(docs, id_col, text_col)
    left = without_rows(docs, groups.where(_name() != F.col("_name")), id_col, text_col)
    rows = keyed(left, id_col, text_col).select("_id", "_h")
    twins = cut_lineage(rows.groupBy("_id", "_h").count().where("count > 1").select("_id", "_h"))
    if twins.isEmpty():
        return left
    single = without_rows(left, twins, id_col, text_col)
    named = left.select("*", F.xxhash64(F.col(text_col)).alias("_twin"))
    again = twins.select(F.col("_id").alias("_tid"), F.col("_h").alias("_th"))
    on = named[id_col].eqNullSafe(again["_tid"]) & (named["_twin"] == again["_th"])
    one = named.join(again, on, "left_semi").dropDuplicates([id_col, "_twin"])
    return single.unionByName(one.select(*docs.columns))
