"""Min-max scaling and standardisation as column expressions.

Fitting is one aggregate over all requested columns and brings back one row.
The fitted numbers then become literals, so applying them is a narrow
projection that stays in generated code and works on streams too.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.columns import is_finite, named

Bounds = Mapping[str, tuple[float | None, float | None]]
Moments = Mapping[str, tuple[float | None, float | None]]


def _finite(value: Column) -> Column:
    """The value as a double; NaN and infinite ones as null."""
    return F.when(is_finite(value), value.cast("double"))


def _pairs(df: DataFrame, cols: Sequence[str], left, right) -> dict[str, tuple]:
    aggregates: list[Column] = []
    for i, c in enumerate(cols):
        value = _finite(named(c))
        aggregates += [left(value).alias(f"a{i}"), right(value).alias(f"b{i}")]
    row = df.agg(*aggregates).first()
    return {c: (row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(cols)}


def fit_bounds(df: DataFrame, cols: Sequence[str]) -> Bounds:
    """Minimum and maximum of each column's finite values, all in one pass."""
    return _pairs(df, cols, F.min, F.max)


def fit_moments(df: DataFrame, cols: Sequence[str]) -> Moments:
    """Mean and population standard deviation of each column's finite values, in one pass."""
    return _pairs(df, cols, F.avg, F.stddev_pop)


def minmax_column(value: Column, low: float | None, high: float | None) -> Column:
    """Scale into [0, 1]; a constant column becomes 0, not 0.5, and a non-finite value null."""
    value = _finite(value)
    if low is None or high is None:
        return value
    if high == low:
        return F.when(value.isNotNull(), value - F.lit(float(low)))
    return (value - F.lit(float(low))) / F.lit(float(high) - float(low))


def standard_column(value: Column, mean: float | None, sd: float | None) -> Column:
    """Centre and divide by the population deviation (by 1 if it is zero); a non-finite value becomes null."""
    value = _finite(value)
    if mean is None or sd is None:
        return value
    return (value - F.lit(float(mean))) / F.lit(float(sd) if sd else 1.0)


def minmax(
    df: DataFrame,
    cols: Sequence[str],
    bounds: Bounds | None = None,
    suffix: str = "",
    clamp: bool = False,
) -> DataFrame:
    """Min-max scale columns, by the batch's own bounds unless some are given.

    ``suffix`` keeps the raw columns and adds scaled ones; with saved bounds
    values may leave [0, 1] unless ``clamp`` is set.
    """
    bounds = fit_bounds(df, cols) if bounds is None else bounds
    scaled = {}
    for c in cols:
        column = minmax_column(named(c), *bounds[c])
        if clamp:
            column = F.when(column.isNotNull(), F.least(F.greatest(column, F.lit(0.0)), F.lit(1.0)))
        scaled[c + suffix] = column
    return df.withColumns(scaled)


def standardize(
    df: DataFrame, cols: Sequence[str], moments: Moments | None = None, suffix: str = ""
) -> DataFrame:
    """Scale columns to mean 0 and population standard deviation 1."""
    moments = fit_moments(df, cols) if moments is None else moments
    return df.withColumns({c + suffix: standard_column(named(c), *moments[c]) for c in cols})
