"""Descriptive statistics and covariance of score columns."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.columns import named
from packetloom.operators.select import quantiles

QUARTILES = (0.25, 0.5, 0.75)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def describe(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum per column.

    One row per column. Quartiles are exact and interpolated;
    ``exact=False`` uses the mergeable sketch and saves the extra passes.
    Null and NaN do not count.
    """
    cols = numeric_columns(df) if cols is None else list(cols)
    aggregates = []
    for i, c in enumerate(cols):
        value = F.nanvl(named(c).cast("double"), F.lit(None).cast("double"))
        aggregates += [
            F.count(value).alias(f"count{i}"),
            F.avg(value).alias(f"mean{i}"),
            F.stddev_samp(value).alias(f"std{i}"),
            F.min(value).alias(f"min{i}"),
            F.max(value).alias(f"max{i}"),
        ]
        if not exact:
            aggregates.append(F.percentile_approx(value, list(QUARTILES), 10_000).alias(f"q{i}"))
    summary = df.agg(*aggregates)
    quartiles_of = quantiles(df, cols, QUARTILES) if exact else {}
    rows = []
    for i, c in enumerate(cols):
        if exact:
            quartiles = [F.lit(q).cast("double") for q in quartiles_of[c]]
        else:
            quartiles = [F.col(f"q{i}")[j] for j in range(len(QUARTILES))]
        rows.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"count{i}").alias("count"),
                F.col(f"mean{i}").alias("mean"),
                F.col(f"std{i}").alias("std"),
                F.col(f"min{i}").alias("min"),
                quartiles[0].alias("p25"),
                quartiles[1].alias("p50"),
                quartiles[2].alias("p75"),
                F.col(f"max{i}").alias("max"),
            )
        )
    return summary.select(F.inline(F.array(*rows)))


def covariance(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Sample covariance of every pair of numeric columns, in long form.

    All pairs come from one aggregate; a pair uses the rows where both values
    are present.
    """
    cols = numeric_columns(df) if cols is None else list(cols)
    pairs = list(combinations_with_replacement(range(len(cols)), 2))
    values = df.select(
        *[
            F.nanvl(named(c).cast("double"), F.lit(None).cast("double")).alias(f"v{i}")
            for i, c in enumerate(cols)
        ]
    )
    summary = values.agg(*[F.covar_samp(f"v{i}", f"v{j}").alias(f"c{i}_{j}") for i, j in pairs])
    cells = [
        F.struct(
            F.lit(cols[i]).alias("column_a"),
            F.lit(cols[j]).alias("column_b"),
            F.col(f"c{min(i, j)}_{max(i, j)}").alias("covariance"),
        )
        for i in range(len(cols))
        for j in range(len(cols))
    ]
    return summary.select(F.inline(F.array(*cells)))


def quantile_threshold(df: DataFrame, score: str, q: float = 0.95, exact: bool = True) -> float | None:
    """The score below which a share ``q`` of the rows lies."""
    if exact:
        return quantiles(df, score, [q])[score][0]
    return df.agg(F.percentile_approx(named(score), q, 10_000)).first()[0]
