"""Ordered work split by ranges of rows, so that no single task owns a whole key or table.

A window hands every row of a key to one task. Here rows are cut into ranges of (key, order columns), whatever their
types: the cut points are rows of the table itself, picked from a sample that is a scalar subquery of the same plan, and a
row finds its range by a binary search in generated code. As a cut point is the first row of its range, a copy of it also
closes the range before: neighbours are then found inside ranges, with one shuffle and no second pass over the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows looked at for each cut point: ranges then differ by about a fifth of their size.
SAMPLE_PER_RANGE = 30
_SHARE = 1 << 40

#: Rows of a key that one task sorts without trouble.
MAX_ROWS_PER_KEY = 5_000_000

PART, HEAD, EDGE = "__part", "__head", "__edge"


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def default_ranges(spark: SparkSession) -> int:
    """Twice the shuffle width: ranges of a hot key spread over the tasks evenly enough."""
    return max(2, 2 * shuffle_width(spark))


def ranges_needed(df: DataFrame, keys: Sequence[str]) -> int | None:
    """How many ranges to cut ``df`` into, None where no key has more than ``MAX_ROWS_PER_KEY`` rows (an exact count)."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"))
    large = not sizes.where(F.col("__rows") > MAX_ROWS_PER_KEY).isEmpty()
    return default_ranges(df.sparkSession) if large else None


def _sample(df: DataFrame, point: Column, ranges: int) -> DataFrame:
    """Distinct values ``at`` of about ``SAMPLE_PER_RANGE`` rows for each range.

    They are chosen by a hash of their values: whenever the plan is run again, the same ones.
    """
    rows = df.select(F.lit(1).alias("one")).agg(F.count("one").alias("n")).scalar()
    wanted = float(_SHARE * ranges * SAMPLE_PER_RANGE)
    chosen = F.pmod(F.xxhash64("at"), F.lit(_SHARE)) * rows.cast("double") <= wanted
    return df.select(point.alias("at")).where(chosen).distinct()


def _cuts(held: Column, ranges: int) -> Column:
    """Inner cut points of a sorted array: every so many values."""
    return F.filter(
        F.transform(
            F.sequence(F.lit(1), F.lit(ranges - 1)),
            lambda i: F.get(held, F.floor(i * F.size(held) / ranges).cast("int")),
        ),
        lambda x: x.isNotNull(),
    )


def _search(df: DataFrame, cuts: str, point: Column, out: str, ranges: int) -> DataFrame:
    """Add how many of the sorted values of column ``cuts`` are at or below ``point``: a binary search, one step a projection."""
    df = df.withColumn(out, F.lit(0))
    step = 1 << ((ranges - 1).bit_length() - 1)
    while step:
        next_cut = F.get(F.col(cuts), F.col(out) + (step - 1))
        reached = next_cut.isNotNull() & (next_cut <= point)
        df = df.withColumn(out, F.when(reached, F.col(out) + step).otherwise(F.col(out)))
        step >>= 1
    return df


def sorted_ranges(df: DataFrame, columns: Sequence[str], ranges: int | None = None) -> DataFrame:
    """Add the range of each row by ``columns`` (``PART``, from 0) and whether it is the first one of it (``HEAD``).

    Columns may have any types that sort; nulls come first. Equal values are always in one range. ``df`` is read three
    times: counted, sampled, cut.
    """
    ranges = ranges or default_ranges(df.sparkSession)
    point = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    held = _sample(df, point, ranges).agg(F.sort_array(F.collect_list("at")).alias("held"))
    # a column of its own: the subquery stands in the plan once, the search reads its value
    cut = df.withColumn("__cuts", held.select(F.array_distinct(_cuts(F.col("held"), ranges)).alias("cuts")).scalar())
    found = _search(cut, "__cuts", point, PART, ranges)
    head = F.coalesce(F.get("__cuts", F.col(PART) - 1) == point, F.lit(False))
    return found.withColumn(HEAD, head).drop("__cuts")


def interleaved_rank(df: DataFrame, columns: Sequence[str], out: str, bits: int = 10) -> DataFrame:
    """Add a number whose bits are those of each column's quantile rank in turn: rows near in it are near in every column.

    Each column is cut into up to ``2 ** bits`` ranges of about equally many rows, whatever its type; nulls rank lowest. A
    frequent value takes the ranks of all ranges it fills, so that the others keep theirs and each bit halves the rows.
    All cut points come from one sample. ``df`` is read three times.
    """
    if not 1 <= len(columns) * bits <= 62:
        raise ValueError(f"{len(columns)} columns of {bits} bits do not fit in a number")
    ranges = 1 << bits
    point = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    held = _sample(df, point, ranges).agg(
        *[F.sort_array(F.collect_list(f"at.c{i}")).alias(f"c{i}") for i in range(len(columns))]
    )
    cuts = held.select(F.struct(*[_cuts(F.col(f"c{i}"), ranges).alias(f"c{i}") for i in range(len(columns))]).alias("cuts"))
    found = df.withColumn("__cuts", cuts.scalar())
    rank = F.lit(0).cast("long")
    for i, c in enumerate(columns):
        found = _search(found.withColumn("__own", F.col(f"__cuts.c{i}")), "__own", F.col(c), f"__rank{i}", ranges)
        for bit in range(bits):
            place = bit * len(columns) + len(columns) - 1 - i
            one = F.shiftright(F.col(f"__rank{i}"), bit).bitwiseAND(F.lit(1)).cast("long")
            rank = rank.bitwiseOR(F.shiftleft(one, place))
    return found.withColumn(out, rank).drop("__cuts", "__own", *[f"__rank{i}" for i in range(len(columns))])


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    lead: Mapping[str, str] | None = None,
    lag: Mapping[str, str] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Add ``{new column: column of the next / previous row}`` within each key.

    Without ``ranges`` this is the plain window, a task for each key. With them no task gets more than a range of rows,
    whatever the keys; ``order`` must then tell the rows of a key apart. Null keys are keys like any other.
    """
    lead, lag = dict(lead or {}), dict(lag or {})

    def shifted(frame: DataFrame, partition: Sequence[str]) -> DataFrame:
        window = Window.partitionBy(*partition).orderBy(*order)
        added = {out: F.lead(src).over(window) for out, src in lead.items()}
        added |= {out: F.lag(src).over(window) for out, src in lag.items()}
        return frame.withColumns(added)

    if ranges is None:
        return shifted(df, keys)

    names = df.columns
    ranged = sorted_ranges(df, [*keys, *order], ranges)
    places = F.when(F.col(HEAD), F.array(F.col(PART), F.col(PART) - 1)).otherwise(F.array(F.col(PART)))
    copied = ranged.withColumn("__at", F.explode(places)).withColumn(EDGE, F.col("__at") != F.col(PART))
    done = shifted(copied, [*keys, "__at"])
    # the first row of a range sees what follows it there, its copy in the range before what goes before it
    if not lag:
        done = done.filter(~F.col(EDGE))
    elif not lead:
        done = done.filter(F.col(EDGE) | ~F.col(HEAD))
    else:
        shown = [n for n in names if n not in {*keys, *order}]
        both = (
            done.filter(HEAD)
            .groupBy(*keys, *order)
            .agg(
                F.first(F.struct(*shown)).alias("__row") if shown else F.lit(None).alias("__row"),
                F.first(F.when(~F.col(EDGE), F.struct(*lead)), True).alias("__next"),
                F.first(F.when(F.col(EDGE), F.struct(*lag)), True).alias("__last"),
            )
        )
        parts = [*keys, *order, *[f"__row.{n}" for n in shown], *[f"__next.{n}" for n in lead], *[f"__last.{n}" for n in lag]]
        done = done.filter(~F.col(HEAD)).select(*names, *lead, *lag).unionByName(both.select(*parts))
    return done.select(*names, *lead, *lag)


def running_totals(
    df: DataFrame,
    order_by: str,
    measures: Mapping[str, str],
    within: Sequence[str] = (),
    descending: bool = False,
    ranges: int | None = None,
) -> DataFrame:
    """Running sums ``{new column: measure}`` over a whole table or inside each group, however many and large they are.

    Rows are cut into ranges of (group, order), summed up inside each range, and shifted by the totals of the group's
    earlier ranges. ``order_by`` must be unique in each group; add up ties before. ``df`` is read four times: hand in a
    stored frame. Null groups are groups like any other.
    """
    within = list(within)
    ranged = sorted_ranges(df, [*within, order_by], ranges).drop(HEAD)

    def direction(column: str) -> Column:
        return F.col(column).desc() if descending else F.col(column).asc()

    inside = Window.partitionBy(*within, PART).orderBy(direction(order_by))
    local = ranged.withColumns({out: F.sum(src).over(inside) for out, src in measures.items()})

    # one row for each range that a group reaches into
    totals = ranged.groupBy(*within, PART).agg(*[F.sum(src).alias(f"__total_{out}") for out, src in measures.items()])
    before = Window.partitionBy(*within).orderBy(direction(PART)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(c).alias(f"__in_{c}") for c in [*within, PART]],
        *[F.coalesce(F.sum(f"__total_{out}").over(before), F.lit(0)).alias(f"__before_{out}") for out in measures],
    )
    same = F.col(PART) == F.col(f"__in_{PART}")
    for c in within:
        same &= F.col(c).eqNullSafe(F.col(f"__in_{c}"))
    joined = local.join(offsets, same)
    return joined.withColumns({out: F.col(out) + F.col(f"__before_{out}") for out in measures}).select(
        *df.columns, *measures
    )
