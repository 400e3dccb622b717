"""Column expressions shared by the clean-up steps. All of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The timestamp text formats of the incoming feeds.
FEED_TIMESTAMP = "MM-dd-yyyy HH:mm:ss"
ORDER_TIMESTAMP = "MM-dd-yyyy H:mm:ss"
HISTORY_TIMESTAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSZ"


def _col(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def pseudonym(value: str | Column) -> Column:
    return F.sha1(_col(value).cast("string"))


def parse_timestamp(value: str | Column, pattern: str = FEED_TIMESTAMP) -> Column:
    """Null instead of an error for text that does not match."""
    return F.try_to_timestamp(_col(value), F.lit(pattern))


def to_whole(value: str | Column) -> Column:
    return _col(value).try_cast("int")


def days_between(as_of: str | Column, value: str | Column) -> Column:
    """Whole days from ``value`` to ``as_of``; a date text is taken as a literal."""
    until = F.lit(as_of).cast("date") if isinstance(as_of, str) else as_of
    return F.datediff(until, _col(value))


def epoch_to_timestamp(value: str | Column) -> Column:
    return F.timestamp_seconds(_col(value))


def wrap_json(value: str | Column, field: str = "data") -> Column:
    """``{"data": <value>}``, so that arrays and bare values parse like objects."""
    return F.concat(F.lit(f'{{"{field}": '), _col(value), F.lit("}"))


def padded_id(prefix: str, value: str | Column, width: int = 12) -> Column:
    return F.concat(F.lit(prefix), F.lpad(_col(value).cast("string"), width, "0"))


def _document_in(value: Column) -> Column:
    """The text of a variant that is text and holds a JSON object or array, else null."""
    text = F.try_variant_get(value, "$", "string")
    kind = F.schema_of_variant(F.try_parse_json(text))
    holds = (F.schema_of_variant(value) == "STRING") & (kind.startswith("OBJECT") | kind.startswith("ARRAY"))
    return F.when(holds, text)


def unescape_json(value: str | Column) -> Column:
    """JSON text in which a document that was quoted as text is a document again.

    That may be the whole text or members of its outermost object. The text is read by a JSON parser, so empty strings,
    escapes and quotes inside stay what they are, and the quoted documents come out as they were written. Members come
    out in the order of their names. Text that is not JSON gives null.
    """
    whole = F.try_parse_json(_col(value))
    members = F.map_entries(F.try_variant_get(whole, "$", "map<string,variant>"))

    def written(member: Column) -> Column:
        name = F.to_json(F.array(member["key"]))
        content = F.coalesce(_document_in(member["value"]), F.to_json(member["value"]))
        return F.concat(name.substr(F.lit(2), F.length(name) - 2), F.lit(":"), content)

    opened = F.concat(F.lit("{"), F.array_join(F.transform(members, written), ","), F.lit("}"))
    is_object = F.schema_of_variant(whole).startswith("OBJECT")
    return F.when(is_object, opened).otherwise(F.coalesce(_document_in(whole), F.to_json(whole)))


def map_values(value: str | Column, mapping: Mapping[str, int]) -> Column:
    """Value mapping; anything else becomes null."""
    column = _col(value)
    cases = None
    for key, out in mapping.items():
        cases = F.when(column == key, out) if cases is None else cases.when(column == key, out)
    return cases


def rules_met(rules: Sequence[str]) -> Column:
    """How many of the predicates (SQL text) hold in a row; a predicate that is null does not."""
    return sum((F.coalesce(F.expr(rule), F.lit(False)).cast("int") for rule in rules), F.lit(0))


def matches(a: str | Column, b: str | Column) -> Column:
    return F.coalesce(_col(a) == _col(b), F.lit(False)).cast("int")
