"""Nested columns and JSON text: inferring, parsing, flattening."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakepipe.functions.scalars import unescape_json, wrap_json


_TYPE_PARTS = re.compile(
    r"(?P<name>`(?:[^`]|``)*`|\w+(?=:))|DECIMAL\((?P<digits>\d+),(?P<scale>\d+)\)|(?P<word>OBJECT<>|\w+)"
)
_TYPE_WORDS = {"OBJECT<>": "STRING", "OBJECT": "STRUCT", "VARIANT": "STRING", "VOID": "STRING"}


def _readable(variant_type: str) -> str:
    """A variant schema as a type that ``from_json`` accepts.

    Mixed values stay text; fractions become doubles, as in Spark's own JSON
    inference, and only whole numbers too long for a bigint stay decimals.
    """

    def part(found: re.Match) -> str:
        if found["name"]:
            return found["name"] if found["name"].startswith("`") else f"`{found['name']}`"
        if found["digits"]:
            whole = found["scale"] == "0" and int(found["digits"]) > 18
            return found[0] if whole else "DOUBLE"
        return _TYPE_WORDS.get(found["word"], found["word"])

    return _TYPE_PARTS.sub(part, variant_type)


def infer_json_type(df: DataFrame, column: str | Column) -> str | None:
    """Common type of all JSON documents of a column, found by one distributed aggregate.

    Broken documents are ignored. Only the type reaches the driver.
    """
    value = F.col(column) if isinstance(column, str) else column
    found = df.agg(F.schema_of_variant_agg(F.try_parse_json(value)).alias("t")).first()["t"]
    return None if found in (None, "VOID", "VARIANT") else _readable(found)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is worked out once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def document_of(text: Column) -> Column:
    """The text as a variant if it is one JSON document, else null; parsed once.

    It is read as the only item of a list, followed by a hash of the text. Neither ``1, 2`` nor ``1, "b": 2`` passes, nor
    text that closes the list itself: it would have to hold its own hash.
    """
    def read(text: Column) -> Column:
        mark = F.xxhash64(text)
        listed = F.try_parse_json(F.concat(F.lit("[["), text, F.lit("],"), mark.cast("string"), F.lit("]")))

        def only_item(found: Column) -> Column:
            closed = F.coalesce(F.try_variant_get(found, "$[1]", "bigint") == mark, F.lit(False))
            alone = F.try_variant_get(found, "$[0][1]", "variant").isNull()
            return F.when(closed & alone, F.try_variant_get(found, "$[0][0]", "variant"))

        return _once(listed, only_item)

    return _once(text, read)


def one_document(text: Column) -> Column:
    """The text if it is one JSON document, else null."""
    return F.when(document_of(text).isNotNull(), text)


def _variant_types(df: DataFrame, *documents: str) -> list[str]:
    """Variant schemas of columns of documents, from one pass over the rows."""
    found = df.agg(*[F.schema_of_variant_agg(d).alias(f"k{i}") for i, d in enumerate(documents)]).first()
    return [kind if kind not in (None, "VOID") else "STRING" for kind in found]


def _typed(document: Column, text: Column, variant_type: str) -> Column:
    """A document as a value of its inferred type.

    The variant itself is cast. Read once more is only what a variant does not keep: how parts that stay JSON text were
    written, and the sign of zero.
    """
    words = {found["word"] or found["digits"] and "DECIMAL" for found in _TYPE_PARTS.finditer(variant_type)}
    wrapped = wrap_json(F.when(document.isNotNull(), text))
    again = F.from_json(wrapped, f"STRUCT<`data`: {_readable(variant_type)}>")["data"]
    if words & {"VARIANT", "OBJECT<>"}:
        return again
    value = F.try_variant_get(document, "$", _readable(variant_type))
    return F.when(F.contains(text, F.lit("-0")), again).otherwise(value) if words & {"DECIMAL", "DOUBLE", "FLOAT"} else value


def parse_json_columns(df: DataFrame, *columns: str) -> DataFrame:
    """Replace JSON text columns by typed columns of an inferred type.

    Documents are read as parts of a list, so objects, arrays and bare values
    all work. Text that is not JSON becomes null. Where documents disagree the
    differing part stays JSON text.
    """
    if not columns:
        return df
    read = {c: f"__document{i}" for i, c in enumerate(columns)}
    documents = df.withColumns({d: document_of(F.col(c)) for c, d in read.items()})
    types = _variant_types(documents, *read.values())
    typed = {c: _typed(F.col(d), F.col(c), t) for (c, d), t in zip(read.items(), types)}
    return documents.withColumns(typed).drop(*read.values())


def parse_with(column: str, schema: str | T.DataType) -> Column:
    return F.from_json(column, schema)


def parse_like(column: str, sample: str) -> Column:
    """Parse with the type of a sample document."""
    return F.from_json(column, F.schema_of_json(F.lit(sample)))


def json_path(column: str, path: str) -> Column:
    """``a.b.c`` inside JSON text, as text."""
    return F.get_json_object(column, f"$.{path}")


def expand(df: DataFrame, column: str, keep: bool = False) -> DataFrame:
    """Replace a struct by its fields."""
    rest = df.columns if keep else [c for c in df.columns if c != column]
    return df.select(*rest, f"{column}.*")


def flatten(df: DataFrame, separator: str = "_") -> DataFrame:
    """Expand structs at any depth; a field is named ``parent_child``. Arrays are left alone."""

    def leaves(path: Column, name: str, kind: T.DataType) -> list[Column]:
        if not isinstance(kind, T.StructType):
            return [path.alias(name)]
        return [
            leaf
            for f in kind.fields
            for leaf in leaves(path.getField(f.name), f"{name}{separator}{f.name}", f.dataType)
        ]

    return df.select(
        *[leaf for f in df.schema.fields for leaf in leaves(F.col(f"`{f.name}`"), f.name, f.dataType)]
    )


def explode_rows(df: DataFrame, column: str, out: str | None = None, keep_empty: bool = False) -> DataFrame:
    """One row per array element; rows without elements vanish unless ``keep_empty``."""
    unfold = F.explode_outer if keep_empty else F.explode
    out = out or column
    rest = [c for c in df.columns if c not in (column, out)]
    return df.select(*rest, unfold(column).alias(out))


def parse_two_levels(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Parse a JSON column, expand it, parse the JSON text found inside, expand that too.

    Both types come from the same pass: the inner text is read out of the parsed document.
    """
    # columns of their own, so that each text is parsed once in a pass
    read = df.withColumn("__outer", document_of(F.col(outer)))
    inner_text = F.try_variant_get("__outer", f'$["{inner}"]', "string")
    types = _variant_types(read.withColumn("__inner", document_of(inner_text)), "__outer", "__inner")
    first = expand(read.withColumn(outer, _typed(F.col("__outer"), F.col(outer), types[0])).drop("__outer"), outer)
    documents = first.withColumn("__inner", document_of(F.col(inner)))
    return expand(documents.withColumn(inner, _typed(F.col("__inner"), F.col(inner), types[1])).drop("__inner"), inner)


def join_arrays(columns: Sequence[str]) -> Column:
    """One long vector from several array columns."""
    return F.concat(*columns)


__all__ = [
    "expand",
    "explode_rows",
    "flatten",
    "infer_json_type",
    "join_arrays",
    "json_path",
    "parse_json_columns",
    "parse_like",
    "parse_two_levels",
    "parse_with",
    "unescape_json",
]
