"""Combined score: regularised logistic regression over two scores."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import DataFrame

from packetloom.functions.columns import named
from packetloom.operators.ids import probability_of_one
from packetloom.operators.mlp import EPOCHS, classifier_pipeline, score_mlp
from packetloom.operators.scale import Bounds, fit_bounds, minmax

# Penalty weights on the absolute and squared coefficients (fixed values).
L1 = 0.01
L2 = 0.01


@dataclass
class Stacker:
    """A fitted combiner, the score columns it reads and their bounds."""

    model: PipelineModel
    cols: list[str]
    bounds: Bounds

    def apply(self, scaled: DataFrame, out: str) -> DataFrame:
        return probability_of_one(self.model.transform(scaled), out)


def fit_stack(
    df: DataFrame,
    scores: Sequence[str],
    label: str,
    l1: float = L1,
    l2: float = L2,
    max_iter: int = EPOCHS,
    tol: float = 1e-9,
    bounds: Bounds | None = None,
) -> Stacker:
    """Minimise mean cross-entropy + l1·|w| + l2·‖w‖² over min-maxed scores.

    Spark's penalty is λ(α|w| + (1-α)/2·‖w‖²), hence λ = l1 + 2·l2 and
    α = l1 / λ; weights are penalised in min-max units, so no standardisation.
    """
    cols = list(scores)
    bounds = fit_bounds(df, cols) if bounds is None else bounds
    strength = l1 + 2 * l2
    logistic = LogisticRegression(
        featuresCol="__features",
        labelCol="__label",
        regParam=strength,
        elasticNetParam=l1 / strength if strength else 0.0,
        standardization=False,
        maxIter=max_iter,
        tol=tol,
    )
    scaled = minmax(df, cols, bounds, suffix="__scaled").select(
        *[named(c + "__scaled") for c in cols], named(label).cast("double").alias("__label")
    )
    return Stacker(classifier_pipeline(logistic, cols).fit(scaled), cols, bounds)


def score_stack(
    stacker: Stacker, df: DataFrame, out: str = "combined_score", bounds: Bounds | None = None,
    score_bounds: Bounds | None = None,
) -> DataFrame:
    """Rows with the combined score, min-maxed to [0, 1]."""
    return score_mlp(stacker, df, out, bounds, score_bounds)
