"""Host load prediction: filter, choose the target, fit, report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from packetloom.operators.evaluate import regression_report
from packetloom.operators.health import fit_linear, residuals
from packetloom.operators.shape import filter_rows, select_features
from packetloom.plans import formats


def train_host_health(
    df: DataFrame,
    label: str = formats.HOST_LABEL,
    features: Sequence[str] = tuple(formats.HOST_FEATURES),
    predicate: str | None = None,
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    """The fitted model, per-row residuals, and the one-row fit report.

    ``label`` may be any metric (memory instead of load, say); ``predicate``
    limits the rows to, for example, one host at noon.
    """
    rows = filter_rows(df, predicate) if predicate else df
    train = select_features(rows, label, features, alias="label")
    model = fit_linear(train, "label", features)
    scored = residuals(model, train, "label")
    return model, scored, regression_report(scored, "label", "prediction")
