"""Train, evaluate and apply intrusion detection on connection or flow records."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.columns import is_finite, named
from packetloom.operators.evaluate import confusion, multiclass_accuracy
from packetloom.operators.ids import fit_ids, score
from packetloom.operators.sampling import split
from packetloom.operators.shape import binary_label, select_features
from packetloom.plans import formats


@dataclass
class DetectionRun:
    """A fitted model with the held-out rows it scored."""

    model: PipelineModel
    scored: DataFrame

    def confusion(self) -> DataFrame:
        return confusion(self.scored, "label", "prediction")

    def accuracy(self) -> DataFrame:
        return multiclass_accuracy(self.scored, "label", "prediction")


def train_detection(
    df: DataFrame,
    key: str | Sequence[str],
    label: str,
    benign: str,
    cats: Sequence[str],
    nums: Sequence[str],
    order: Sequence[str] | None = None,
    handle_invalid: str = "error",
    encoding: str = "index",
    fraction: float = 0.7,
    seed: int = 42,
    **fit_settings,
) -> DetectionRun:
    """Label, split 70/30 by key, fit on the larger part and score the rest."""
    keys = [key] if isinstance(key, str) else list(key)
    features = list(dict.fromkeys([*(order or [*cats, *nums]), *keys]))
    labelled = binary_label(select_features(df, label, features), "label_unreg", benign)
    train, test = split(labelled, keys, fraction, seed)
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        model = fit_ids(train, "label", cats, nums, handle_invalid, encoding, order, **fit_settings)
    finally:
        train.unpersist()
    return DetectionRun(model, score(model, test))


def train_connections(df: DataFrame, key: str | Sequence[str], **settings) -> DetectionRun:
    """Connection records: three categoricals and eighteen numerics."""
    nums = [c for c in formats.CONNECTION_ORDER if c not in formats.CONNECTION_CATEGORICAL]
    return train_detection(
        df, key, formats.CONNECTION_LABEL, formats.CONNECTION_BENIGN,
        formats.CONNECTION_CATEGORICAL, nums, formats.CONNECTION_ORDER, **settings,
    )


def finite_rates(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Non-finite values of ``cols`` as 0, as missing ones are filled; nulls stay."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(is_finite(named(c)) | named(c).isNull(), named(c)).otherwise(0.0) for c in cols if kinds[c] in ("double", "float")})


def train_flows(df: DataFrame, key: str | Sequence[str], **settings) -> DetectionRun:
    """Flow records: both addresses hashed (2^18 slots unless ``num_hashed`` says otherwise), unseen ones kept.

    A rate over a duration of zero is NaN or infinite in raw flows; ``finite_rates`` turns these into 0.
    """
    nums = [c for c in formats.FLOW_ORDER if c not in formats.FLOW_CATEGORICAL]
    settings = {"handle_invalid": "keep", "encoding": "hash", **settings}
    return train_detection(
        finite_rates(df, nums), key, formats.FLOW_LABEL, formats.FLOW_BENIGN,
        formats.FLOW_CATEGORICAL, nums, formats.FLOW_ORDER, **settings,
    )
