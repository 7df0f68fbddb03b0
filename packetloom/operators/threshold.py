"""Threshold sweep and choice of the best threshold."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate, repeat, takewhile

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.columns import named
from packetloom.operators.evaluate import positive_label, with_detection_stats

# Objective name -> statistic it maximises (fixed values).
OBJECTIVES = {
    "accuracy": "accuracy",
    "fn_to_accuracy": "fn_to_accuracy",
    "fn_weighted": "weighted_fn_to_accuracy",
    "detection": "weighted_detection_to_accuracy",
    "lambda": "lambda",
}


def threshold_grid(start: float = 1.0, stop: float = 0.0, step: float = 0.01) -> list[float]:
    """Thresholds from ``start`` down to ``stop`` (excluded).

    Each is the one before less ``step``: ``start - i * step`` differs in the
    last bits and would move scores that sit on a grid point.
    """
    falling = accumulate(repeat(step), lambda x, by: x - by, initial=start)
    return list(takewhile(lambda x: x > stop, falling))


def threshold_sweep(
    df: DataFrame, label: str, score: str, grid: Sequence[float] | None = None
) -> DataFrame:
    """Detection statistics at every grid threshold, from one pass over the rows.

    Each score is turned into the number of grid points it does not exceed;
    counting rows per number gives a histogram no larger than the grid, and a
    running sum over it gives the flagged rows at each threshold. Null and NaN
    scores are never flagged.
    """
    points = sorted(set(threshold_grid() if grid is None else grid), reverse=True)
    value = named(score).cast("double")
    mirrored = df.select(
        positive_label(label).alias("positive"),
        F.when(value.isNotNull() & ~F.isnan(value), -value).otherwise(float("inf")).alias("mirrored"),
    )
    slots = Bucketizer(
        splits=[float("-inf"), *[-x for x in points], float("inf")],
        inputCol="mirrored",
        outputCol="slot",
    ).transform(mirrored)
    # The default never applies; it tells the optimizer that slots are not null,
    # so the later join does not add a filter that buckets every row again.
    slot = F.coalesce(F.col("slot").cast("int"), F.lit(len(points)))
    histogram = slots.groupBy(slot.alias("slot")).agg(
        F.count_if("positive").alias("pos"), F.count_if(~F.col("positive")).alias("neg")
    )
    steps = df.sparkSession.createDataFrame(
        [*enumerate(points), (len(points), None)],
        T.StructType([T.StructField("slot", T.IntegerType()), T.StructField("threshold", T.DoubleType())]),
    )
    # At most one row per grid point from here on, so one window task is enough.
    upto = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy("slot").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    joined = steps.join(histogram, "slot", "left").select(
        "slot", "threshold", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg")
    )
    counts = joined.select(
        "threshold",
        (F.sum("neg").over(everything) - F.sum("neg").over(upto)).alias("tn"),
        F.sum("neg").over(upto).alias("fp"),
        (F.sum("pos").over(everything) - F.sum("pos").over(upto)).alias("fn"),
        F.sum("pos").over(upto).alias("tp"),
    )
    return with_detection_stats(counts.filter("threshold is not null"))


def best_threshold(sweep: DataFrame, objective: str = "accuracy", best: float = 0.0) -> DataFrame:
    """One row: the highest threshold with the largest objective value.

    Only values above ``best`` can win; if there is none the row holds
    threshold 0 and ``best``.
    """
    if objective not in OBJECTIVES:
        raise ValueError(f"unknown objective {objective!r}; choose from {sorted(OBJECTIVES)}")
    candidate = F.struct(named(OBJECTIVES[objective]).alias("value"), F.col("threshold"))
    winner = sweep.filter(named(OBJECTIVES[objective]) > F.lit(float(best))).agg(
        F.max(candidate).alias("top")
    )
    return winner.select(
        F.lit(objective).alias("objective"),
        F.coalesce("top.threshold", F.lit(0.0)).alias("threshold"),
        F.coalesce("top.value", F.lit(float(best))).alias("value"),
    )


def evaluate(
    df: DataFrame,
    label: str,
    score: str,
    objective: str = "fn_to_accuracy",
    grid: Sequence[float] | None = None,
) -> DataFrame:
    """Report at the best threshold: the threshold, its value and all statistics.

    Threshold 0 is swept along, so the fallback row needs no second pass.
    """
    if objective not in OBJECTIVES:
        raise ValueError(f"unknown objective {objective!r}; choose from {sorted(OBJECTIVES)}")
    points = threshold_grid() if grid is None else list(grid)
    sweep = threshold_sweep(df, label, score, [*points, 0.0])
    value = named(OBJECTIVES[objective])
    wins = (F.col("threshold") > 0) & (value > 0)
    row = F.struct(*[named(c) for c in sweep.columns])
    tops = sweep.agg(
        F.max(F.when(wins, F.struct(value.alias("value"), F.col("threshold"), row.alias("row")))).alias("top"),
        F.max(F.when(F.col("threshold") == 0, row)).alias("zero"),
    )
    return tops.select(
        F.lit(objective).alias("objective"),
        F.coalesce("top.value", F.lit(0.0)).alias("value"),
        F.coalesce("top.row", "zero").alias("row"),
    ).select("objective", "value", "row.*")
