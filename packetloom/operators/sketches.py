"""Descriptive statistics that are stored by day and merged, quantiles within a stated rank error.

A row holds the mergeable state of one column in one group: count, mean and squared deviations, smallest and
largest value, and a KLL sketch of the values. Adding a day reads that day alone; a month or a threshold
over all days merges its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.columns import is_finite, named
from packetloom.operators.stats import QUARTILES, numeric_columns

#: Size of a sketch; larger ones err less.
SIZE = 4096


def rank_error(size: int = SIZE) -> float:
    """How far the rank of a quantile may be off, as a share of the rows, with 99 % confidence.

    Fixed values of the published KLL sketch; merging does not add to it.
    """
    return 2.296 / size**0.9021


def sketch_columns(df: DataFrame, cols: Sequence[str] | None = None, by: Sequence[str] = (), size: int = SIZE) -> DataFrame:
    """One row for each group of ``by`` and column: ``column``, ``n``, ``mean``, ``m2``, ``low``, ``high``, ``sketch``.

    One pass with partial sketches before the shuffle. Null and non-finite values do not count; a column
    without others has ``n`` = 0 and null state.
    """
    cols = [c for c in numeric_columns(df) if c not in by] if cols is None else list(cols)
    aggregates = []
    for i, c in enumerate(cols):
        value = F.when(is_finite(named(c)), named(c).cast("double"))
        aggregates += [
            F.count(value).alias(f"n{i}"), F.avg(value).alias(f"mean{i}"), (F.var_pop(value) * F.count(value)).alias(f"m2{i}"),
            F.min(value).alias(f"low{i}"), F.max(value).alias(f"high{i}"), F.kll_sketch_agg_double(value, F.lit(size)).alias(f"sketch{i}"),
        ]
    groups = [named(c) for c in by]
    summary = df.groupBy(*groups).agg(*aggregates)
    rows = [F.struct(F.lit(c).alias("column"), *[F.col(f"{p}{i}").alias(p) for p in ("n", "mean", "m2", "low", "high", "sketch")]) for i, c in enumerate(cols)]
    return summary.select(*groups, F.inline(F.array(*rows)))


def merge_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same rows over larger groups: days to months, or all of them."""
    filled = sketches.where("n > 0")
    groups = [named(c) for c in by]
    total, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    # squared deviations around the common mean, through those around a group's own
    spread = F.sum("m2") + F.sum(F.col("n") * F.col("mean") * F.col("mean")) - total * mean * mean
    return filled.groupBy(*groups, "column").agg(
        total.alias("n"), mean.alias("mean"), F.greatest(spread, F.lit(0.0)).alias("m2"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch").alias("sketch"),
    )


def describe_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``stats.describe``'s row for each column, from merged sketches; quartiles are values that occur."""
    quartiles = F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, QUARTILES)))
    merged = merge_sketches(sketches, by).withColumn("q", quartiles)
    deviation = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return merged.select(
        *[named(c) for c in by], "column", F.col("n").alias("count"), "mean", deviation.alias("std"), F.col("low").alias("min"),
        F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), F.col("high").alias("max"),
    )


def sketch_threshold(sketches: DataFrame, column: str, q: float = 0.95) -> float | None:
    """The score below which about a share ``q`` of all sketched rows lies."""
    merged = merge_sketches(sketches.where(F.col("column") == column))
    row = merged.select(F.kll_sketch_get_quantile_double("sketch", F.lit(float(q)))).first()
    return row[0] if row else None
