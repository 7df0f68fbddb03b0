"""Splits, exact samples and folds that do not depend on partitioning.

``key`` names the column or columns that identify a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions.columns import HASH_SPACE, as_keys, key_digest, key_hash, leading_number, named
from packetloom.operators.select import LISTABLE, first_rows, smallest
from packetloom.operators.shape import fill_zero

ROWS_PER_SLICE = 100_000
MAX_SLICES = 2**20
#: Bits of the hash that orders a sample, and of the ranges that it is counted by.
HASH_BITS, CELL_BITS = 60, 14


def split(
    df: DataFrame,
    key: str | Sequence[str],
    fraction: float = 0.7,
    seed: int | None = 42,
    method: str = "hash",
) -> tuple[DataFrame, DataFrame]:
    """Two disjoint parts, the first with about ``fraction`` of the rows.

    The hash split is a filter on the key, so each part can be recomputed on
    its own and a rerun on other partitions gives the same rows.
    ``method="random"`` is Spark's row sampler.
    """
    if method == "random":
        first, second = df.randomSplit([fraction, 1.0 - fraction], seed=seed)
        return first, second
    if method != "hash":
        raise ValueError(f"unknown split method {method!r}")
    chosen = key_hash(key, seed) < F.lit(round(fraction * HASH_SPACE))
    return df.filter(chosen), df.filter(~chosen)


def sample_size(rows: int, fraction: float) -> int:
    """``rows * fraction`` rounded half away from zero."""
    return int(rows * fraction + 0.5)


def sample_exact(
    df: DataFrame, key: str | Sequence[str], fraction: float, seed: int | None = None
) -> DataFrame:
    """Exactly ``round(n * fraction)`` rows without replacement, nulls filled by 0.

    The rows with the smallest key hash are taken. One scan counts rows by ranges of the hash, which are
    even by nature, and so tells the range that holds the last row to take and how many of its rows
    belong. A second one lists these hashes; the sample is then a filter on rows where they lie. A range
    with more rows than can be listed, which takes a key that repeats very often, is resolved by
    further passes and quotas.
    """
    keys = as_keys(key)
    hashed = df.withColumn("__d", key_digest(keys, seed)).withColumn("__h", leading_number(F.col("__d"), hex_digits=15))
    cell = F.shiftright("__h", HASH_BITS - CELL_BITS)
    counts = dict(hashed.select(cell.alias("c")).groupBy("c").count().collect())  # at most 2^CELL_BITS rows
    n = left = sample_size(sum(counts.values()), fraction)
    last = -1
    for c in sorted(counts):
        if left < counts[c]:
            last = c
            break
        left -= counts[c]
    if last < 0:
        return fill_zero(df if n else df.limit(0))
    below, inside = hashed.where(F.col("__h") < F.lit(last << (HASH_BITS - CELL_BITS))), hashed.where(cell == last)
    order = ["__h", "__d", *keys]
    if left and counts[last] <= LISTABLE:
        listed = inside.groupBy(*[named(c) for c in order]).agg(F.count("*").alias("__n")).orderBy(*[named(c) for c in order])
        taken, cut = 0, None
        for row in listed.select("__n", F.struct(*[named(c) for c in order]).alias("__at")).collect():
            if taken + row["__n"] > left:
                break
            taken, cut = taken + row["__n"], row["__at"]
        if taken == left:  # otherwise the last key repeats, and only some of its rows belong
            at = [F.lit(v).cast(hashed.schema[c].dataType) for c, v in zip(order, cut, strict=True)]
            upto = F.struct(*[named(c) for c in order]) <= F.struct(*[v.alias(c) for c, v in zip(order, at, strict=True)])
            return fill_zero(hashed.where((F.col("__h") < F.lit(last << (HASH_BITS - CELL_BITS))) | ((cell == last) & upto)).drop("__h", "__d"))
    if left:
        below = below.union(smallest(inside, "__h", left, ties=order[1:]))
    return fill_zero(below.drop("__h", "__d"))


def limit_rows(df: DataFrame, n: int, order_by: str, ties: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows by a key, then by ``ties``; files have no row order to rely on."""
    numeric = dict(df.dtypes)[order_by] in ("tinyint", "smallint", "int", "bigint", "float", "double")
    return smallest(df, order_by, n, ties) if numeric else first_rows(df, n, [order_by, *ties])


def stratified_folds(
    df: DataFrame,
    key: str | Sequence[str],
    label: str,
    k: int = 10,
    seed: int | None = None,
    out: str = "fold",
    exact: bool = True,
    slices: int | None = None,
) -> DataFrame:
    """Number rows by shuffled position within their label, modulo ``k``.

    With a two-valued label a plain window would put each class into one task.
    Here every class is cut into hash slices that are ranked side by side, and
    a slice starts at the number of rows in the slices before it. ``slices``
    follows from the row count unless given.
    ``exact=False`` takes the fold from the hash alone: no shuffle, folds equal
    in expectation only.
    """
    if not exact:
        return df.withColumn(out, (key_hash(key, seed) % F.lit(k)).cast("int"))
    if slices is None:
        slices = min(max(df.count() // ROWS_PER_SLICE, 1), MAX_SLICES)
    cols = df.columns
    # The coalesced slice is never null; saying so spares the join a null filter.
    slice_of = F.floor(leading_number(F.col("__d")) / F.lit(HASH_SPACE / slices))
    sliced = df.withColumn("__d", key_digest(key, seed)).withColumns(
        {
            "__g": F.coalesce(named(label).cast("string"), F.lit("\0null")),
            "__s": F.coalesce(slice_of, F.lit(0)),
        }
    )
    sizes = sliced.groupBy("__g", "__s").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("__g").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__g", "__s", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__b"))
    within = Window.partitionBy("__g", "__s").orderBy("__d", *[named(c) for c in as_keys(key)])
    position = F.col("__b") + F.row_number().over(within) - F.lit(1)
    return (
        sliced.join(starts, ["__g", "__s"])
        .withColumn(out, (position % F.lit(k)).cast("int"))
        .select(*[named(c) for c in cols], named(out))
    )
