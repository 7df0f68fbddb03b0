"""Saving and loading fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from packetloom.operators.conv import ConvReconstruction
from packetloom.operators.frequency_index import IndexedModel
from packetloom.operators.mlp import MaliciousScorer
from packetloom.operators.sliced_logistic import SlicedModel

#: Models that store themselves in Parquet.
OWN_FORMAT = (ConvReconstruction, MaliciousScorer, IndexedModel, SlicedModel)


def save_model(model, path: str, spark: SparkSession | None = None) -> None:
    """Save a fitted model, replacing what is there.

    Spark ML models use their own format; the convolutional reconstruction and
    the perceptron are one Parquet row of arrays, an index its tables.
    """
    if isinstance(model, OWN_FORMAT):
        model.save(spark or SparkSession.getActiveSession(), path)
    else:
        model.write().overwrite().save(path)


def load_model(path: str, kind: type = PipelineModel, spark: SparkSession | None = None):
    """Load what ``save_model`` saved; ``kind`` names the model class."""
    if kind in OWN_FORMAT:
        return kind.load(spark or SparkSession.getActiveSession(), path)
    return kind.load(path)
