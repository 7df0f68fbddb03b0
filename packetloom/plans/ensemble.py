"""The stacked chain: anomaly score → malicious score → combined score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.columns import named
from packetloom.operators.anomaly import LinearReconstruction, fit_anomaly
from packetloom.operators.conv import ConvReconstruction
from packetloom.operators.evaluate import mean_threshold_report
from packetloom.operators.mlp import MaliciousScorer, fit_mlp, raw_probability
from packetloom.operators.scale import Bounds, fit_bounds, minmax
from packetloom.operators.shape import binary_label, drop_unlabelled, fill_zero
from packetloom.operators.stack import Stacker, fit_stack
from packetloom.operators.threshold import evaluate
from packetloom.plans import formats
from packetloom.plans.detection import finite_rates
from packetloom.session import forget, materialize


@dataclass(frozen=True)
class EnsembleFormat:
    """Which columns are features and label, and how the scores are called."""

    features: Sequence[str] = tuple(formats.ENSEMBLE_FEATURES)
    label: str = formats.FLOW_LABEL
    benign: str = formats.FLOW_BENIGN
    unlabelled: str = formats.FLOW_UNLABELLED
    anomaly: str = "anomaly_score"
    malicious: str = "malicious_score"
    combined: str = "combined_score"


@dataclass
class EnsembleModel:
    """Three fitted stages; ``score_bounds`` are the raw score ranges seen in training."""

    layout: EnsembleFormat
    anomaly: LinearReconstruction | ConvReconstruction
    malicious: MaliciousScorer
    stack: Stacker
    score_bounds: dict[str, tuple[float, float]] = field(default_factory=dict)

    def save(self, spark: SparkSession, path: str) -> None:
        self.malicious.save(spark, f"{path}/malicious")
        self.stack.model.write().overwrite().save(f"{path}/stack")
        linear = isinstance(self.anomaly, LinearReconstruction)
        if not linear:
            self.anomaly.save(spark, f"{path}/anomaly")
        rows = [
            (stage, column, *map(_number, pair))
            for stage, bounds in (
                ("anomaly", self.anomaly.bounds),
                ("stack", self.stack.bounds),
                ("score", self.score_bounds),
            )
            for column, pair in bounds.items()
        ]
        spark.createDataFrame(rows, "stage string, name string, low double, high double").coalesce(
            1
        ).write.mode("overwrite").parquet(f"{path}/bounds")
        lay = self.layout
        header = (
            list(lay.features), lay.label, lay.benign, lay.unlabelled, lay.anomaly, lay.malicious,
            lay.combined, linear, list(self.anomaly.center) if linear else None,
            self.anomaly.axes if linear else None,
        )
        schema = (
            "features array<string>, label string, benign string, unlabelled string, anomaly string, "
            "malicious string, combined string, linear boolean, center array<double>, axes array<array<double>>"
        )
        spark.createDataFrame([header], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/format")

    @staticmethod
    def load(spark: SparkSession, path: str) -> EnsembleModel:
        header = spark.read.parquet(f"{path}/format").first()
        bounds: dict[str, dict] = {"anomaly": {}, "stack": {}, "score": {}}
        for row in spark.read.parquet(f"{path}/bounds").collect():
            bounds[row["stage"]][row["name"]] = (row["low"], row["high"])
        layout = EnsembleFormat(
            tuple(header["features"]), header["label"], header["benign"], header["unlabelled"],
            header["anomaly"], header["malicious"], header["combined"],
        )
        features = list(layout.features)
        if header["linear"]:
            anomaly = LinearReconstruction(
                features, bounds["anomaly"], list(header["center"]), [list(a) for a in header["axes"]]
            )
        else:
            anomaly = ConvReconstruction.load(spark, f"{path}/anomaly")
        return EnsembleModel(
            layout,
            anomaly,
            MaliciousScorer.load(spark, f"{path}/malicious"),
            Stacker(
                PipelineModel.load(f"{path}/stack"), [layout.anomaly, layout.malicious], bounds["stack"]
            ),
            bounds["score"],
        )


def _number(value) -> float | None:
    return None if value is None else float(value)


def _rescaled(
    raw: DataFrame, column: str, given: Bounds | None, keep: bool
) -> tuple[DataFrame, Bounds]:
    """Min-max a raw score; ``keep`` stores the raw rows so they are computed once."""
    if keep:
        raw = materialize(raw, column)
    bounds = fit_bounds(raw, [column]) if given is None else given
    scaled = minmax(raw, [column], bounds)
    if keep:
        scaled._scratch = raw._scratch
    return scaled, bounds


def filled_features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Nulls as 0 in all columns, NaN and infinite feature values too."""
    return fill_zero(finite_rates(df, features))


def labelled_rows(df: DataFrame, layout: EnsembleFormat, out: str = "is_malicious") -> DataFrame:
    """Rows that carry a label, nulls filled, with the 0/1 label added."""
    return binary_label(
        fill_zero(drop_unlabelled(df, layout.label, layout.unlabelled)),
        layout.label, layout.benign, out=out, drop=False,
    )


def ensemble_fit(
    df: DataFrame,
    layout: EnsembleFormat | None = None,
    method: str = "pca",
    k: int = 2,
    max_iter: int = 100,
    keep_stages: bool = True,
    key: str | Sequence[str] | None = None,
    **anomaly_settings,
) -> EnsembleModel:
    """Fit the three stages one after the other on labelled flows.

    The anomaly stage learns from every row; the later stages from rows that
    carry a label. ``keep_stages`` writes each scored stage to the shared
    scratch folder instead of computing it again; they are deleted at the end.
    ``key`` deals the rows to the same training batches on every layout of the
    table. Null, NaN and infinite features count as 0.
    """
    layout = layout or EnsembleFormat()
    features = list(layout.features)
    filled = filled_features(df, features)
    if method == "conv1d":
        anomaly_settings = {"key": key, **anomaly_settings}
    anomaly = fit_anomaly(filled, features, k=k, method=method, **anomaly_settings)
    raw = anomaly.distance(filled, layout.anomaly, anomaly.bounds)
    first, seen_anomaly = _rescaled(raw, layout.anomaly, None, keep_stages)

    rows = labelled_rows(first, layout, "__label")
    malicious = fit_mlp(rows, [*features, layout.anomaly], "__label", epochs=max_iter, key=key)
    raw = raw_probability(malicious, rows, layout.malicious, malicious.bounds)
    second, seen_malicious = _rescaled(raw, layout.malicious, None, keep_stages)

    stack = fit_stack(second, [layout.anomaly, layout.malicious], "__label", max_iter=max_iter)
    raw = raw_probability(stack, second, layout.combined, stack.bounds)
    seen_combined = fit_bounds(raw, [layout.combined])
    seen = {**seen_anomaly, **seen_malicious, **seen_combined}
    if keep_stages:
        forget(first, second)
    return EnsembleModel(layout, anomaly, malicious, stack, seen)


def _unit(bounds: Bounds, column: str) -> tuple[float | None, float | None]:
    """Range of a score after it was min-maxed by ``bounds``: no pass needed."""
    low, high = bounds[column]
    if low is None:
        return (None, None)
    return (0.0, 0.0) if low == high else (0.0, 1.0)


def ensemble_score(
    model: EnsembleModel,
    df: DataFrame,
    bounds: str = "batch",
    labelled_only: bool = False,
    keep_stages: bool = False,
) -> DataFrame:
    """Add the three scores to every row; key, label and raw features ride along.

    ``bounds="batch"`` scales by the ranges of the rows being scored.
    ``bounds="saved"`` uses the training ranges: one narrow pass, no fitting
    jobs, and the only choice for a stream. ``labelled_only`` drops unlabelled
    rows after the anomaly stage, as a labelled test run does.
    """
    if bounds not in ("batch", "saved"):
        raise ValueError(f"unknown bounds {bounds!r}")
    layout, saved = model.layout, bounds == "saved"

    def given(column: str) -> Bounds | None:
        return {column: model.score_bounds[column]} if saved else None

    filled = filled_features(df, layout.features)
    ranges = dict(model.anomaly.bounds if saved else fit_bounds(filled, model.anomaly.cols))
    raw = model.anomaly.distance(filled, layout.anomaly, ranges)
    first, seen = _rescaled(raw, layout.anomaly, given(layout.anomaly), keep_stages)
    ranges[layout.anomaly] = _unit(seen, layout.anomaly)
    if labelled_only:
        first = drop_unlabelled(first, layout.label, layout.unlabelled)
        ranges = ranges if saved else dict(fit_bounds(first, model.malicious.cols))

    raw = raw_probability(model.malicious, first, layout.malicious, model.malicious.bounds if saved else ranges)
    second, seen = _rescaled(raw, layout.malicious, given(layout.malicious), keep_stages)
    ranges[layout.malicious] = _unit(seen, layout.malicious)

    raw = raw_probability(model.stack, second, layout.combined, model.stack.bounds if saved else ranges)
    third, _ = _rescaled(raw, layout.combined, given(layout.combined), keep_stages)
    return third


def stage_report(scored: DataFrame, layout: EnsembleFormat, score: str) -> DataFrame:
    """Counts of rows above the mean of one stage's score, against the label."""
    rows = binary_label(scored, layout.label, layout.benign, out="__label", drop=False)
    return mean_threshold_report(rows, "__label", score)


def ensemble_report(
    scored: DataFrame, layout: EnsembleFormat, objective: str = "fn_to_accuracy"
) -> DataFrame:
    """Combined-score report at the best threshold over rows that carry a label."""
    rows = labelled_rows(scored, layout, "__label").select("__label", named(layout.combined))
    return evaluate(rows, "__label", layout.combined, objective).withColumn("score", F.lit(layout.combined))
