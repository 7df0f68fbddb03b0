"""Exact order statistics and exact n-smallest selection without a global sort.

A pass counts rows per sub-interval of the value range; the sub-interval that
holds the wanted rank is divided again until it is a single value or small
enough to list. Each pass reads only the columns asked for, handles all of
them at once, combines map-side and brings back a fixed number of rows, so
neither a hot value nor the table size matters.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.columns import as_keys, named
from packetloom.session import materialize

SPLITS = 2048
LISTABLE = 50_000
SMALL_LIMIT = 1_000


class Extent(NamedTuple):
    """Finite range of a column, with the rows inside, below and above it."""

    low: float | int | None
    high: float | int | None
    inside: int
    under: int
    over: int

    @property
    def total(self) -> int:
        return self.under + self.inside + self.over


class Interval(NamedTuple):
    """Part of a column's range that holds a wanted rank, down to a single value."""

    column: int
    low: float | int
    high: float | int
    below: int
    inside: int


def _long_form(df: DataFrame, cols: Sequence[str], kind: str) -> DataFrame:
    """Column number ``c`` and value ``v`` of every value that is present."""
    cells = [F.struct(F.lit(i).alias("c"), named(c).cast(kind).alias("v")) for i, c in enumerate(cols)]
    if len(cells) == 1:
        values = df.select(F.lit(0).alias("c"), named(cols[0]).cast(kind).alias("v"))
    else:
        values = df.select(F.inline(F.array(*cells)))
    return values.filter("v is not null" if kind == "bigint" else "v is not null and not isnan(v)")


def _extents(values: DataFrame, columns: int, kind: str) -> list[Extent]:
    infinite = "false" if kind == "bigint" else "abs(v) = double('inf')"
    rows = (
        values.groupBy("c")
        .agg(
            F.expr(f"min(if({infinite}, null, v)) as low"),
            F.expr(f"max(if({infinite}, null, v)) as high"),
            F.expr(f"count_if(not {infinite}) as inside"),
            F.expr(f"count_if({infinite} and v < 0) as under"),
            F.expr(f"count_if({infinite} and v > 0) as over"),
        )
        .collect()
    )
    found = {row["c"]: Extent(*row[1:]) for row in rows}
    return [found.get(i, Extent(None, None, 0, 0, 0)) for i in range(columns)]


def _interval_table(values: DataFrame, intervals: Sequence[Interval], stuck: set[Interval], kind: str) -> DataFrame:
    """The intervals as a table, a row each: few, as there are at most columns times ranks of them.

    A double's slot is its share of the interval, from halves so that no difference overflows. An
    interval that a pass could not shrink is cut in two at ``cut``, which its highest value exceeds.
    """
    rows = []
    for i, part in enumerate(intervals):
        if kind == "double":
            half = part.high / 2 - part.low / 2
            cut = part.low + half if part.low + half < part.high else part.low
            rows.append((i, part.column, part.low, part.high, half, cut, part in stuck or half == 0))
        else:
            rows.append((i, part.column, part.low, part.high, Decimal((part.high - part.low) // SPLITS + 1), None, False))
    number = "decimal(20,0)" if kind == "bigint" else "double"
    schema = f"i int, ic int, low {kind}, high {kind}, step {number}, cut double, halve boolean"
    return values.sparkSession.createDataFrame(rows, schema)


def _pass(values: DataFrame, intervals: Sequence[Interval], stuck: set[Interval], kind: str) -> list:
    """Rows per (interval, sub-interval); few enough rows are listed by value."""
    listing = sum(i.inside for i in intervals) <= LISTABLE
    table = F.broadcast(_interval_table(values, intervals, stuck, kind))
    within = (F.col("c") == F.col("ic")) & F.col("v").between(F.col("low"), F.col("high"))
    if kind == "double":
        share = (F.col("v") / 2 - F.col("low") / 2) / F.col("step")
        slot = F.when(F.col("halve"), (F.col("v") > F.col("cut")).cast("bigint")).otherwise(F.least(F.floor(share * SPLITS), F.lit(SPLITS - 1)))
    else:
        slot = F.expr("cast((cast(v as decimal(20, 0)) - low) div step as bigint)")
    return (
        values.join(table, within)
        .select("v", "i", (F.col("v") if listing else slot).alias("s"))
        .groupBy("i", "s")
        .agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count(F.lit(1)).alias("n"))
        .orderBy("i", "low")
        .collect()
    )


def _at_ranks(
    values: DataFrame, extents: Sequence[Extent], wanted: Sequence[tuple[int, int]], kind: str
) -> dict[tuple[int, int], Interval | None]:
    """The value at each wanted (column, zero-based rank), with its row counts."""
    found: dict[tuple[int, int], Interval | None] = {}
    pending: dict[tuple[int, int], Interval] = {}
    for column, rank in set(wanted):
        extent = extents[column]
        if not 0 <= rank < extent.total:
            found[column, rank] = None
        elif rank < extent.under:
            found[column, rank] = Interval(column, -math.inf, -math.inf, 0, extent.under)
        elif rank >= extent.under + extent.inside:
            below = extent.under + extent.inside
            found[column, rank] = Interval(column, math.inf, math.inf, below, extent.over)
        else:
            pending[column, rank] = Interval(column, extent.low, extent.high, extent.under, extent.inside)
    stuck: set[Interval] = set()
    while True:
        for place, part in list(pending.items()):
            if part.low == part.high:
                found[place] = part
                del pending[place]
        if not pending:
            return found
        intervals = sorted(set(pending.values()))
        counts: dict[Interval, list] = {part: [] for part in intervals}
        for row in _pass(values, intervals, stuck, kind):
            counts[intervals[row["i"]]].append(row)
        stuck = {part for part in intervals if [(r["low"], r["high"]) for r in counts[part]] == [(part.low, part.high)]}
        for (column, rank), part in pending.items():
            below = part.below
            for row in counts[part]:
                if rank < below + row["n"]:
                    pending[column, rank] = Interval(column, row["low"], row["high"], below, row["n"])
                    break
                below += row["n"]


def _single_column(df: DataFrame, col: str, ranks: Sequence[int]) -> list[Interval | None]:
    kind = "bigint" if isinstance(df.schema[col].dataType, T.IntegralType) else "double"
    values = _long_form(df, [col], kind)
    found = _at_ranks(values, _extents(values, 1, kind), [(0, r) for r in ranks], kind)
    return [found[0, r] for r in ranks]


def order_statistics(df: DataFrame, col: str, ranks: Sequence[int]) -> list:
    """Values at the given zero-based ranks in ascending order.

    Null and NaN are skipped; a rank outside the data gives None.
    """
    return [part and part.low for part in _single_column(df, col, ranks)]


def quantiles(
    df: DataFrame, cols: str | Sequence[str], probs: Sequence[float]
) -> dict[str, list[float | None]]:
    """Exact quantiles of each column, interpolated between neighbouring values."""
    cols = as_keys(cols)
    values = _long_form(df, cols, "double")
    extents = _extents(values, len(cols), "double")
    places = [[p * (e.total - 1) for p in probs] if e.total else [] for e in extents]

    def neighbours(column: int, place: float) -> tuple[int, int]:
        return int(place), min(int(place) + 1, extents[column].total - 1)

    wanted = [(c, r) for c, row in enumerate(places) for place in row for r in neighbours(c, place)]
    at = _at_ranks(values, extents, wanted, "double")
    result = {}
    for c, name in enumerate(cols):
        row: list[float | None] = [] if places[c] else [None] * len(probs)
        for place in places[c]:
            lower, upper = (at[c, r].low for r in neighbours(c, place))
            share = place - int(place)
            row.append(float(lower if share == 0 or lower == upper else lower + (upper - lower) * share))
        result[name] = row
    return result


def smallest(df: DataFrame, order: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    """Exactly ``n`` rows with the smallest numeric ``order`` value, nulls first, NaN last.

    Rows that tie are taken in the order of ``ties``, then of a hash of the whole row, at every ``n``; so
    only equal rows are an open choice. Small ``n`` is a top-n. Beyond that the cut value is found first
    and the rows are then taken by a filter, so no task ever holds the result.
    """
    if n <= 0:
        return df.limit(0)
    value = named(order)
    if n <= SMALL_LIMIT:
        return df.orderBy(value, *[named(t) for t in ties], _row_hash(df)).limit(n)
    missing = df.filter(value.isNull()).count()
    if n <= missing:
        return first_rows(df.filter(value.isNull()), n, ties)
    (place,) = _single_column(df, order, [n - missing - 1])
    if place is None:  # every value is taken, and NaN comes after all of them
        last = F.isnan(value.cast("double")) & value.isNotNull()
        ordered = df.filter(~last)
        left = n - ordered.count()
        return ordered.unionByName(first_rows(df.filter(last), left, ties)) if left > 0 else ordered
    cut, below = F.lit(place.low), missing + place.below
    if below + place.inside == n:
        return df.filter(value.isNull() | (value <= cut))
    rest = first_rows(df.filter(value == cut), n - below, ties)
    return df.filter(value.isNull() | (value < cut)).unionByName(rest)


def _row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[named(c) for c in df.columns])


def first_rows(df: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """``n`` rows in the order of ``keys``, of any sortable type, then of a hash of the whole row.

    Small ``n`` is a top-n. Otherwise rows are dealt out by ranges of that order, stored with their place
    in their range, and taken by each range's quota; equal rows are dealt out by a running number, so a row
    that repeats without end is no single task.
    """
    order = [*[named(k) for k in keys], _row_hash(df)]
    if n <= SMALL_LIMIT:
        return df.orderBy(*order).limit(n)
    names = [f"k{i}" for i in range(len(order))]
    rows = df.select(F.struct(*[named(c) for c in df.columns]).alias("row"), *[o.alias(c) for o, c in zip(order, names, strict=True)])
    rows = rows.withColumn("number", F.monotonically_increasing_id())
    ranged = rows.repartitionByRange(*names, "number").sortWithinPartitions(*names, "number")
    placed = ranged.select("row", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias("place"))
    placed = materialize(placed, "first-rows")
    quotas, left = [], n
    for part, size in sorted(placed.groupBy("part").count().collect()):  # a row a task
        quotas.append((part, min(size, left)))
        left -= quotas[-1][1]
    table = df.sparkSession.createDataFrame(quotas, "part int, quota long")
    return placed.join(F.broadcast(table), "part").filter("place < quota").select("row.*")
