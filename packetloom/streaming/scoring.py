"""Apply fitted models to a stream of log files.

Scoring is a narrow projection, so a fitted pipeline works on a stream as it
is; the ensemble uses saved bounds there, or scales each micro-batch by its own
ranges.
"""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from packetloom.operators.ids import score
from packetloom.plans.ensemble import EnsembleModel, ensemble_score
from packetloom.session import forget


def read_parquet_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def score_stream(model: Model | EnsembleModel, stream: DataFrame) -> DataFrame:
    """Scored stream."""
    if isinstance(model, EnsembleModel):
        return ensemble_score(model, stream, bounds="saved")
    return score(model, stream)


def write_parquet_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append scored rows as Parquet, working off everything available now."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def score_batches(
    model: EnsembleModel, stream: DataFrame, path: str, checkpoint: str, rows_labelled: bool = False
) -> StreamingQuery:
    """Score each micro-batch by the ranges of its own rows, as a batch run does, into ``<path>/batch=<id>``.

    A batch that is worked off again after a failure replaces its folder, so no
    row is written twice. Batches whose rows should share a range have to
    arrive together; saved bounds make scores comparable across batches.
    """

    def work(batch: DataFrame, batch_id: int) -> None:
        scored = ensemble_score(model, batch, bounds="batch", labelled_only=rows_labelled, keep_stages=True)
        scored.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        forget(scored)

    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
