"""Confusion matrices, detection statistics and model reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.functions.columns import exceeds, is_finite, named, ratio

LOSS_EPSILON = 1e-7


def confusion(df: DataFrame, label: str, pred: str, predicted_only: bool = True) -> DataFrame:
    """Counts for every (actual, predicted) pair; a null label is class 1, so that all rows with a prediction count.

    The predicted classes are all that occur, or with ``predicted_only=False`` those that occur as labels.
    The rows are read once, by a grouped count. Its result is no larger than
    the matrix, so it is packed into one row to learn the classes, and zeros
    for all pairs are added before the final sum.
    """
    counts = (
        df.groupBy(
            F.coalesce(named(label).cast("double"), F.lit(1.0)).alias("actual"),
            named(pred).cast("double").alias("predicted"),
        )
        .agg(F.count(F.lit(1)).alias("n"))
    )
    packed = counts.agg(
        F.collect_list(F.struct("actual", "predicted", "n")).alias("cells"),
        F.collect_set("actual").alias("classes"),
        (F.array_union(F.collect_set("actual"), F.collect_set("predicted")) if predicted_only else F.collect_set("actual")).alias("columns"),
    )
    known = F.expr("filter(cells, c -> array_contains(columns, c.predicted))")
    zeros = F.expr(
        """flatten(transform(classes, a -> transform(columns, p ->
             named_struct('actual', a, 'predicted', p, 'n', 0L))))"""
    )
    return (
        packed.select(F.inline(F.concat(known, zeros)))
        .groupBy("actual", "predicted")
        .agg(F.sum("n").alias("n"))
        .orderBy("actual", "predicted")
    )


def multiclass_accuracy(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Share of rows whose prediction equals the label; a row without either is a miss."""
    hit = named(label).cast("double") == named(pred).cast("double")
    return df.agg(ratio(F.count_if(hit), F.count(F.lit(1))).alias("accuracy"))


def positive_label(label: str) -> Column:
    """Whether a row counts as positive; a null label does, as it does when labels are made."""
    return F.coalesce(named(label) == 1, F.lit(True))


def _counts(positive: Column, flagged: Column) -> list[Column]:
    return [
        F.count_if(~positive & ~flagged).alias("tn"),
        F.count_if(~positive & flagged).alias("fp"),
        F.count_if(positive & ~flagged).alias("fn"),
        F.count_if(positive & flagged).alias("tp"),
    ]


def binary_counts(df: DataFrame, label: str, flag: str) -> DataFrame:
    """tn, fp, fn, tp, accuracy and missed-positive rate in one row.

    Every row counts: a null label is positive, a null flag isn't raised.
    """
    counts = df.agg(*_counts(positive_label(label), F.coalesce(named(flag).cast("int") == 1, F.lit(False))))
    total = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return counts.select(
        "*",
        ratio(F.col("tp") + F.col("tn"), total).alias("accuracy"),
        ratio(F.col("fn"), total).alias("missed_positive_rate"),
    )


def with_detection_stats(counts: DataFrame) -> DataFrame:
    """Derive the detection statistics from columns tn, fp, fn, tp.

    The order of the arithmetic is part of the definition: it decides ties
    between thresholds.
    """
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    half, third = F.lit(2.0), F.lit(3.0)
    return (
        counts.withColumn("total", tn + fp + fn + tp)
        .withColumns(
            {
                "accuracy": ratio(tp + tn, F.col("total")),
                "fn_inverse": ratio(fn, F.col("total")),
                "percent_detected": ratio(tp, tp + fn),
            }
        )
        .withColumn("percent_fn", (F.lit(100.0) - F.lit(100.0) * F.col("fn_inverse")) / F.lit(100.0))
        .withColumns(
            {
                "fn_to_accuracy": (F.col("accuracy") + F.col("percent_fn")) / half,
                "weighted_fn_to_accuracy": (F.col("percent_fn") * 2.0 + F.col("accuracy")) / third,
                "weighted_detection_to_accuracy": (F.col("percent_detected") + F.col("accuracy")) / half,
            }
        )
        .withColumn(
            "lambda",
            (F.col("weighted_detection_to_accuracy") + F.col("weighted_fn_to_accuracy")) / half,
        )
    )


def detection_stats(df: DataFrame, label: str, score: str, x: float) -> DataFrame:
    """The thirteen detection statistics at one threshold, as one row."""
    return with_detection_stats(df.agg(*_counts(positive_label(label), exceeds(score, x))))


def mean_threshold(df: DataFrame, score: str) -> float | None:
    """The mean score, used as an alert threshold."""
    return df.agg(F.avg(named(score))).first()[0]


def mean_threshold_report(df: DataFrame, label: str, score: str) -> DataFrame:
    """Binary counts of the rows above the mean score, with the threshold."""
    cut = mean_threshold(df, score)
    limit = F.lit(cut).cast("double")
    flagged = df.select(named(label).alias("label"), exceeds(score, limit).cast("int").alias("flag"))
    return binary_counts(flagged, "label", "flag").withColumn("threshold", limit)


def regression_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Row count, root mean squared error and R squared over the rows with a finite label and prediction, in one aggregate."""
    both = is_finite(named(label)) & is_finite(named(pred))
    y = F.when(both, named(label).cast("double"))
    r = y - named(pred).cast("double")
    sums = df.agg(
        F.count(r).alias("n"), F.sum(r * r).alias("sse"), (F.var_pop(y) * F.count(y)).alias("sst")
    )
    return sums.select(
        "n",
        F.sqrt(ratio(F.col("sse"), F.col("n"))).alias("rmse"),
        (F.lit(1.0) - ratio(F.col("sse"), F.col("sst"))).alias("r2"),
    )


def train_report(df: DataFrame, label: str, probability: str) -> DataFrame:
    """Mean cross-entropy with clipped probabilities, and accuracy at 0.5, over the rows with a finite probability.

    A null label is positive.
    """
    p = F.when(is_finite(named(probability)), named(probability).cast("double"))
    clipped = F.least(F.greatest(p, F.lit(LOSS_EPSILON)), F.lit(1.0 - LOSS_EPSILON))
    positive = positive_label(label)
    loss = F.when(p.isNotNull(), -F.when(positive, F.log(clipped)).otherwise(F.log(F.lit(1.0) - clipped)))
    hit = (p > 0.5) == positive
    return df.agg(
        F.count(p).alias("n"),
        F.avg(loss).alias("loss"),
        ratio(F.count_if(hit), F.count(p)).alias("accuracy"),
    )
