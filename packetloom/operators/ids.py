"""Intrusion detection by logistic regression: fit and batch scoring."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.columns import named
from packetloom.operators.encode import (
    assemble,
    hash_features,
    one_hot,
    one_hot_features,
    string_index,
    vector_name,
)
from packetloom.operators.frequency_index import IndexedModel, fit_frequency_index
from packetloom.operators.sliced_logistic import SlicedModel, fit_sliced

# Settings of the saved intrusion-detection fit (fixed values).
LOGISTIC_SETTINGS = {
    "regParam": 0.0,
    "elasticNetParam": 0.0,
    "maxIter": 100,
    "tol": 1e-6,
    "fitIntercept": True,
    "standardization": True,
    "threshold": 0.5,
    "aggregationDepth": 2,
    "family": "auto",
}
#: Slots of ``encoding="table"`` beyond which weights and optimiser history are cut into slices on the executors.
MOST_SLOTS = 1_500_000


def fit_ids(
    df: DataFrame,
    label: str,
    cats: Sequence[str],
    nums: Sequence[str],
    handle_invalid: str = "error",
    encoding: str = "index",
    order: Sequence[str] | None = None,
    num_hashed: int = 2**18,
    **logistic_settings,
) -> PipelineModel | IndexedModel | SlicedModel:
    """Fit index → one-hot → assemble → logistic regression.

    ``encoding`` is the caller's choice at every size. ``"index"`` keeps a
    dictionary of the categories on the driver and in every task; ``"table"``
    gives the same indexes from a stored table by joins and names no category
    in the vector; only the weights and the optimiser's history grow with the categories, and beyond ``MOST_SLOTS`` of
    them, in a plain fit (no regularisation, two classes), neither is on the driver any more; ``"hash"`` needs none and puts all categoricals into ``num_hashed`` slots, which stand
    first, so it cannot refuse an unseen value and takes ``handle_invalid="keep"``
    alone. ``order`` gives the assembly order of the original column names (of
    the numerics, if hashed), and ``logistic_settings`` override those of the
    regression.
    """
    cats, nums = list(cats), list(nums)
    if encoding not in ("index", "table", "hash"):
        raise ValueError(f"unknown encoding {encoding!r}")
    if cats and encoding == "hash" and handle_invalid != "keep":
        raise ValueError("hashed categoricals know no unseen value: set handle_invalid='keep'")
    logistic = LogisticRegression(
        featuresCol="features", labelCol=label, **{**LOGISTIC_SETTINGS, **logistic_settings}
    )
    if not cats:
        stages = [assemble(nums), logistic]
    elif encoding == "hash":
        stages = [hash_features(cats, num_hashed), assemble(["hashed", *(c for c in (order or nums) if c not in cats)]), logistic]
    else:
        inputs = [vector_name(c) if c in cats else c for c in (order or [*cats, *nums])]
        keep = "keep" if handle_invalid == "keep" else "error"
        stages = [string_index(cats, handle_invalid), one_hot(cats, keep), assemble(inputs), logistic]
    train = df.select(
        *[named(c) for c in dict.fromkeys([*cats, *nums])], named(label).cast("double").alias(label)
    )
    if cats and encoding == "table":
        index = fit_frequency_index(train, cats, handle_invalid)
        # the slots of one_hot: with "keep" a null has one if there is any, else the last category has none
        nulls = train.agg(*[F.coalesce(F.max(named(c).isNull()), F.lit(False)) for c in cats]).first()
        slots = {c: index.sizes[c] + (bool(null) if keep == "keep" else -1) for c, null in zip(cats, nulls, strict=True)}
        settings = {**LOGISTIC_SETTINGS, **logistic_settings}
        free = {"maxIter", "tol", "threshold", "aggregationDepth"}
        if sum(slots.values()) > MOST_SLOTS and all(settings[k] == LOGISTIC_SETTINGS.get(k) for k in settings if k not in free):
            own = [c for c in (order or [*cats, *nums]) if c in nums]
            return fit_sliced(train, label, index, {c: slots[c] for c in cats}, own, settings["maxIter"], settings["tol"], settings["threshold"])
        parts = [(c, slots.get(c)) for c in (order or [*cats, *nums])]
        return IndexedModel(index, parts, Pipeline(stages=[logistic]).fit(one_hot_features(index.transform(train), parts)))
    return Pipeline(stages=stages).fit(train)


def score(model: Model | IndexedModel, df: DataFrame) -> DataFrame:
    """Input columns plus raw prediction, probability and prediction; lazy, no shuffle."""
    return model.transform(df)


def probability_of_one(df: DataFrame, out: str = "score", probability: str = "probability") -> DataFrame:
    """Add the class-1 probability as a plain double column."""
    return df.withColumn(out, vector_to_array(named(probability))[1])


def timed_score(model: Model | IndexedModel, df: DataFrame) -> DataFrame:
    """Score every row; report rows, seconds, seconds per row.

    One job scores and counts: its sums need each row's probability and prediction, and are all that it
    brings back.
    """
    scored = probability_of_one(score(model, df), "__p")
    sums = scored.agg(F.count(F.lit(1)).alias("rows"), F.sum("__p"), F.sum("prediction"))
    start = time.perf_counter()
    rows = sums.first()["rows"]
    seconds = time.perf_counter() - start
    schema = T.StructType(
        [
            T.StructField("rows", T.LongType()),
            T.StructField("seconds", T.DoubleType()),
            T.StructField("seconds_per_row", T.DoubleType()),
        ]
    )
    return df.sparkSession.createDataFrame([(rows, seconds, seconds / rows if rows else None)], schema)
