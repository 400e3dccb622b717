"""Change-data-capture: turn a feed of row changes into current state or history."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakepipe.operators.ranges import ranges_needed, with_neighbours
from lakepipe.session import written


def _names(value: str | Sequence[str]) -> list[str]:
    return [value] if isinstance(value, str) else list(value)


def _condition(value: str | Column | None) -> Column:
    if value is None:
        return F.lit(False)
    column = F.expr(value) if isinstance(value, str) else value
    return F.coalesce(column, F.lit(False))


def _tie_breaker(df: DataFrame, column: str | None) -> Column:
    return F.col(column) if column else F.xxhash64(*df.columns)


def _all(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def reduce_changes(
    feed: DataFrame,
    keys: str | Sequence[str],
    sequence_by: str | Sequence[str],
    apply_as_deletes: str | Column | None = None,
    tie_breaker: str | None = None,
) -> DataFrame:
    """Last change of each key, deletes kept as tombstones in ``__deleted``.

    Reducing reduced feeds again gives the same rows, so late and out-of-order
    batches can be folded in any order. ``__tie`` carries the tie breaker.
    """
    keys, sequence = _names(keys), _names(sequence_by)
    marked = feed
    if "__deleted" not in feed.columns:
        marked = feed.withColumns(
            {"__tie": _tie_breaker(feed, tie_breaker), "__deleted": _condition(apply_as_deletes)}
        )
    rest = [c for c in marked.columns if c not in keys]
    return (
        marked.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*sequence, "__tie")).alias("__row"))
        .select(*keys, "__row.*")
        .select(*marked.columns)
    )


def apply_changes_scd1(
    feed: DataFrame,
    keys: str | Sequence[str],
    sequence_by: str | Sequence[str],
    apply_as_deletes: str | Column | None = None,
    except_columns: Sequence[str] = (),
    ignore_null_updates: bool = False,
    tie_breaker: str | None = None,
) -> DataFrame:
    """Current state: the latest change of each key; a key whose latest change is a delete is gone.

    With ``ignore_null_updates`` a null in a change leaves the older value in
    place, but values from before the key's last delete never come back.
    """
    keys, sequence = _names(keys), _names(sequence_by)
    if not ignore_null_updates:
        latest = reduce_changes(feed, keys, sequence, apply_as_deletes, tie_breaker)
        return latest.filter(~F.col("__deleted")).drop("__deleted", "__tie", *except_columns)

    deleted = _condition(apply_as_deletes)
    order = F.struct(*sequence, _tie_breaker(feed, tie_breaker).alias("__tie"))
    marked = feed.withColumns({"__deleted": deleted, "__order": order})
    rest = [c for c in feed.columns if c not in keys and c not in except_columns]
    live = ~F.col("__deleted")
    newest = [
        F.max_by(F.struct("__order", F.col(c).alias("value")), F.when(live & F.col(c).isNotNull(), F.col("__order")))
        .alias(f"__at_{i}")
        for i, c in enumerate(rest)
    ]
    state = marked.groupBy(*keys).agg(
        F.max(F.when(F.col("__deleted"), F.col("__order"))).alias("__last_delete"),
        F.max(F.when(live, F.col("__order"))).alias("__last_live"),
        *newest,
    )

    def after_delete(when: Column) -> Column:
        return F.col("__last_delete").isNull() | (when > F.col("__last_delete"))

    return state.filter(F.col("__last_live").isNotNull() & after_delete(F.col("__last_live"))).select(
        *keys,
        *[
            F.when(after_delete(F.col(f"__at_{i}.__order")), F.col(f"__at_{i}.value")).alias(c)
            for i, c in enumerate(rest)
        ],
    )


def apply_changes_scd2(
    feed: DataFrame,
    keys: str | Sequence[str],
    sequence_by: str | Sequence[str],
    apply_as_deletes: str | Column | None = None,
    except_columns: Sequence[str] = (),
    track_history_on: Sequence[str] | None = None,
    track_history_except: Sequence[str] | None = None,
    tie_breaker: str | None = None,
    start_column: str = "start_at",
    end_column: str = "end_at",
    ranges: int | str | None = "auto",
) -> DataFrame:
    """History: each accepted change opens a version, the next change or delete closes it.

    ``end_at`` is null for the current version. With a track list only a change
    in a tracked column opens a version; the other columns of an open version
    show their newest value. Changes of a key that share one sequence value count
    as one: the greatest tie breaker (by default a hash of the row) wins.

    With ``ranges=None`` a task sorts each key. With a number the changes are reduced to one per key and sequence value,
    on the map side first, written to the shared folder, and compared inside that many ranges of (key, sequence) of about
    equal size, so that one key may hold any share of the feed. ``auto`` counts the changes per key first, and cuts ranges
    (twice the shuffle width) if any key has more than one task should sort. The result is the same.
    """
    keys, sequence = _names(keys), _names(sequence_by)
    hidden = set(except_columns)
    shown = [c for c in feed.columns if c not in keys and c not in hidden]
    marked = feed.withColumns(
        {
            "__tie": _tie_breaker(feed, tie_breaker),
            "__deleted": _condition(apply_as_deletes),
            "__here": F.lit(True),
        }
    )
    tracked = None
    if track_history_on is not None:
        tracked = list(track_history_on)
    elif track_history_except is not None:
        tracked = [c for c in shown if c not in track_history_except and c not in sequence]
    if ranges == "auto":
        ranges = ranges_needed(feed, keys)
    needed = [*dict.fromkeys([*keys, *sequence, *shown, *(tracked or [])]), "__tie", "__deleted", "__here"]
    marked = marked.select(*needed)
    if tracked is None:
        found = _versions(marked, keys, sequence, ranges)
    else:
        found = _tracked_versions(marked, keys, sequence, tracked, shown, ranges)
    return found.select(*keys, *shown, F.col("__start").alias(start_column), F.col("__end").alias(end_column))


def _versions(
    marked: DataFrame, keys: Sequence[str], sequence: Sequence[str], ranges: int | None
) -> DataFrame:
    """Every change but the last of its sequence value is dropped; deletes only close."""
    changes = _one_per_sequence(marked, keys, sequence, ranges)
    if ranges is not None:
        changes = with_neighbours(changes, keys, sequence, lead={"__close": sequence[0]}, ranges=ranges)
    return (
        changes.filter(~F.col("__deleted"))
        .withColumn("__start", F.col(sequence[0]))
        .withColumnRenamed("__close", "__end")
    )


def _one_per_sequence(
    marked: DataFrame, keys: Sequence[str], sequence: Sequence[str], ranges: int | None
) -> DataFrame:
    """The change that counts of each key and sequence value; without ranges with ``__close``, the next sequence value."""
    if ranges is not None:
        rest = [c for c in marked.columns if c not in keys and c not in sequence]
        latest = F.max_by(F.struct(*rest), F.struct("__tie")).alias("__row")
        return written(marked.groupBy(*keys, *sequence).agg(latest).select(*keys, *sequence, "__row.*"))
    following = with_neighbours(
        marked,
        keys,
        [*sequence, "__tie"],
        lead={"__next_here": "__here", **{f"__next_{c}": c for c in sequence}},
    )
    superseded = F.coalesce(F.col("__next_here"), F.lit(False)) & _all(
        F.col(f"__next_{c}").eqNullSafe(F.col(c)) for c in sequence
    )
    kept = following.filter(~superseded).withColumnRenamed(f"__next_{sequence[0]}", "__close")
    return kept.drop("__next_here", *[f"__next_{c}" for c in sequence[1:]])


def _tracked_versions(
    marked: DataFrame,
    keys: Sequence[str],
    sequence: Sequence[str],
    tracked: Sequence[str],
    shown: Sequence[str],
    ranges: int | None,
) -> DataFrame:
    """Runs of changes that agree in the tracked columns become one version.

    All steps sort the same way, so without ``ranges`` they share one shuffle and sort. With them ranges are cut anew for
    the first and last changes of the versions, which are written to the shared folder before.
    """
    order = [*sequence, "__tie"] if ranges is None else list(sequence)
    untracked = [c for c in shown if c not in tracked and c not in sequence]

    def step(df: DataFrame, **columns) -> DataFrame:
        return with_neighbours(df, keys, order, ranges=ranges, **columns)

    compared = step(
        _one_per_sequence(marked, keys, sequence, ranges).drop("__close"),
        lag={
            "__prev_here": "__here",
            "__prev_deleted": "__deleted",
            **{f"__prev_{c}": c for c in tracked},
        },
        lead={
            "__next_here": "__here",
            "__next_deleted": "__deleted",
            "__close": sequence[0],
            **{f"__next_{c}": c for c in tracked},
        },
    )

    def breaks(side: str) -> Column:
        return (
            F.col(f"__{side}_here").isNull()
            | F.col("__deleted")
            | F.col(f"__{side}_deleted")
            | _any(~F.col(f"__{side}_{c}").eqNullSafe(F.col(c)) for c in tracked)
        )

    # of the changes inside a version only the first and the last are needed from here on
    borders = (
        compared.withColumns({"__opens": breaks("prev"), "__ends": breaks("next")})
        .filter(F.col("__opens") | F.col("__ends"))
        .drop(*[f"__{side}_{c}" for side in ("prev", "next") for c in ("here", "deleted", *tracked)])
    )
    paired = step(
        borders if ranges is None else written(borders),
        lead={"__end_close": "__close", **{f"__end_{c}": c for c in untracked}},
    ).filter(F.col("__opens") & ~F.col("__deleted"))

    def at_end(own: str, end: str) -> Column:
        return F.when(F.col("__ends"), F.col(own)).otherwise(F.col(end))

    return paired.withColumns(
        {
            "__start": F.col(sequence[0]),
            "__end": at_end("__close", "__end_close"),
            **{c: at_end(c, f"__end_{c}") for c in untracked},
        }
    )


def splice_changes(
    known: DataFrame | None,
    new: DataFrame,
    keys: str | Sequence[str],
    sequence_by: str | Sequence[str],
    apply_as_deletes: str | Column | None = None,
    tie_breaker: str | None = None,
    ranges: int | str | None = "auto",
) -> DataFrame:
    """What new changes alter in a stored history: the entries that are new, and those whose end they move.

    An entry is a change with ``__end``, the next sequence value of its key, and its tie breaker and delete mark (a delete
    is an entry too, which readers leave out). ``known`` holds the entries stored so far (None: none yet). Of a key only
    what reaches beyond its earliest new change is compared, cut into ranges as in ``apply_changes_scd2``. A change that is known already alters nothing; of several
    with one key and sequence value the greatest tie breaker wins, whenever it came.
    """
    keys, sequence = _names(keys), _names(sequence_by)
    first = sequence[0]
    marked = new.withColumns({"__tie": _tie_breaker(new, tie_breaker), "__deleted": _condition(apply_as_deletes)})
    both = marked.withColumns({"__stored": F.lit(False), "__was": F.lit(None).cast(new.schema[first].dataType)})
    if known is not None:
        since = new.groupBy(*[F.col(k).alias(f"__of_{k}") for k in keys]).agg(F.min(F.struct(first)).alias("__since"))
        since = since.withColumn("__since", F.col(f"__since.{first}"))
        reaches = F.col("__since").isNull() | F.col("__end").isNull() | (F.col("__end") >= F.col("__since"))
        same = _all(F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys)
        near = known.join(since, same & reaches).drop(*[f"__of_{k}" for k in keys], "__since")
        near = near.withColumn("__stored", F.lit(True)).withColumnRenamed("__end", "__was")
        both = both.unionByName(near, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c not in sequence]
    latest = F.max_by(F.struct(*rest), F.struct("__tie", "__stored")).alias("__row")
    merged = both.groupBy(*keys, *sequence).agg(latest).select(*keys, *sequence, "__row.*")
    if ranges is not None:
        merged = written(merged)
    if ranges == "auto":
        ranges = ranges_needed(merged, keys)
    placed = with_neighbours(merged, keys, sequence, lead={"__end": first}, ranges=ranges)
    moved = ~F.col("__stored") | ~F.col("__was").eqNullSafe(F.col("__end"))
    return placed.filter(moved).drop("__stored", "__was")


def snapshot_diff(
    old: DataFrame, new: DataFrame, keys: str | Sequence[str], label: str = "change_type"
) -> DataFrame:
    """Rows inserted, updated or deleted between two states with unique keys.

    Updates and inserts carry the new values, deletes the old ones.
    """
    keys = _names(keys)
    values = [c for c in new.columns if c not in keys]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*[F.col(k).alias(f"{name}_{k}") for k in keys], F.struct(*values).alias(name))

    same_key = [F.col(f"__old_{k}").eqNullSafe(F.col(f"__new_{k}")) for k in keys]
    both = side(old, "__old").join(side(new, "__new"), same_key, "full")
    change = (
        F.when(F.col("__old").isNull(), "insert")
        .when(F.col("__new").isNull(), "delete")
        .when(~F.col("__old").eqNullSafe(F.col("__new")), "update")
    )
    return (
        both.withColumn(label, change)
        .filter(F.col(label).isNotNull())
        .select(
            *[F.coalesce(f"__new_{k}", f"__old_{k}").alias(k) for k in keys],
            F.coalesce("__new", "__old").alias("__row"),
            label,
        )
        .select(*keys, "__row.*", label)
    )


def keep_unless(df: DataFrame, predicate: str | Column) -> DataFrame:
    """State after deleting the rows for which ``predicate`` is true (null keeps the row)."""
    return df.filter(~_condition(predicate))
