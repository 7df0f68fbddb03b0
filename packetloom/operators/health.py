"""Host health: ordinary least squares on host metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.columns import named
from packetloom.operators.encode import assemble


def fit_linear(df: DataFrame, label: str, cols: Sequence[str]) -> PipelineModel:
    """Least squares by the normal equations: one pass whatever the row count."""
    regression = LinearRegression(
        featuresCol="features", labelCol=label, predictionCol="prediction", solver="normal", regParam=0.0
    )
    train = df.select(named(label).cast("double").alias(label), *[named(c) for c in cols])
    return Pipeline(stages=[assemble(cols), regression]).fit(train)


def residuals(model: PipelineModel, df: DataFrame, label: str) -> DataFrame:
    """Add prediction and residual (label minus prediction) to each row."""
    scored = model.transform(df).drop("features")
    return scored.withColumn("residual", named(label) - F.col("prediction"))


def coefficients(model: PipelineModel, cols: Sequence[str]) -> dict[str, float]:
    """Fitted coefficients by column name, intercept included."""
    fitted = model.stages[-1]
    return {"intercept": float(fitted.intercept), **dict(zip(cols, map(float, fitted.coefficients), strict=True))}
