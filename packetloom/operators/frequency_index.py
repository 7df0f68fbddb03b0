"""Indexes by descending frequency for categoricals with any number of values.

No dictionary is held anywhere: values are counted by a grouping, ranked by ranges of (count, value) that
each number their own rows, and the index comes to the rows by a join in which frequent values are
broadcast. ``encode.string_index`` does the same for small categoricals within Spark ML.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.functions.columns import named
from packetloom.operators.encode import index_name, one_hot_features
from packetloom.operators.lookup import lookup
from packetloom.session import materialize


def global_ranks(df: DataFrame, order: Sequence, name: str = "ranks") -> DataFrame:
    """``df`` with ``rank`` (from 0) by ``order``, without sorting it in one task.

    Rows are dealt by ranges of the order; each range numbers its own, starting after the rows of the
    ranges before it. Only the ranges' sizes, one row each, are broadcast. ``order`` must tell rows apart.
    """
    spread = materialize(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), name)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = spread.groupBy("__range").agg(F.count("*").alias("__size"))
    starts = starts.select("__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    local = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    ranked = spread.withColumn("__local", local).join(F.broadcast(starts), "__range")
    return ranked.withColumn("rank", F.col("__start") + F.col("__local")).drop("__range", "__local", "__start")


@dataclass
class FrequencyIndex:
    """For each column a stored table (``value``, ``n``, ``index``), its number of values and the rows counted."""

    tables: dict[str, DataFrame]
    sizes: dict[str, int]
    rows: int
    handle_invalid: str = "error"

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``<column>_index`` as double.

        A null or unseen value is an error, is left out with ``"skip"``, and gets the number of values with
        ``"keep"``.
        """
        for column, table in self.tables.items():
            out = index_name(column)
            known = table.select(F.col("value").alias(column), "n", F.col("index").alias(out))
            df = lookup(df, column, known, "n", self.rows, [out])
            if self.handle_invalid == "keep":
                df = df.withColumn(out, F.coalesce(named(out), F.lit(float(self.sizes[column]))))
            elif self.handle_invalid == "skip":
                df = df.where(named(out).isNotNull())
            else:
                shown = F.concat(F.lit(f"unseen value in {column}: "), F.coalesce(named(column).cast("string"), F.lit("null")))
                df = df.withColumn(out, F.coalesce(named(out), F.raise_error(shown).cast("double")))
        return df

    def save(self, spark: SparkSession, path: str) -> None:
        for i, (column, table) in enumerate(self.tables.items()):
            table.write.mode("overwrite").parquet(f"{path}/table{i}")
        header = [(c, self.sizes[c], self.rows, self.handle_invalid) for c in self.tables]
        spark.createDataFrame(header, "name string, size long, rows long, handle_invalid string").coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FrequencyIndex:
        header = spark.read.parquet(f"{path}/columns").collect()
        tables = {r["name"]: spark.read.parquet(f"{path}/table{i}") for i, r in enumerate(header)}
        return FrequencyIndex(tables, {r["name"]: r["size"] for r in header}, header[0]["rows"], header[0]["handle_invalid"])


def fit_frequency_index(df: DataFrame, cols: Sequence[str], handle_invalid: str = "error") -> FrequencyIndex:
    """Count and rank the values of each column as strings: most frequent first, ties by value. Nulls aren't values."""
    if handle_invalid not in ("error", "keep", "skip"):
        raise ValueError(f"unknown handle_invalid {handle_invalid!r}")
    tables, sizes = {}, {}
    for column in cols:
        counts = df.where(named(column).isNotNull()).groupBy(named(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
        ranked = global_ranks(counts, [F.desc("n"), F.asc("value")], "index-ranges")
        tables[column] = materialize(ranked.select("value", "n", F.col("rank").cast("double").alias("index")), "index")
        sizes[column] = tables[column].count()
    return FrequencyIndex(tables, sizes, df.count(), handle_invalid)


@dataclass
class IndexedModel:
    """A frequency index, the parts of the vector made from its columns, and a fitted pipeline that reads it; used like the pipeline."""

    index: FrequencyIndex
    parts: list[tuple[str, int | None]]
    pipeline: PipelineModel

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(one_hot_features(self.index.transform(df), self.parts))

    def save(self, spark: SparkSession, path: str) -> None:
        self.index.save(spark, f"{path}/index")
        parts = [(i, *part) for i, part in enumerate(self.parts)]
        spark.createDataFrame(parts, "place int, name string, width long").coalesce(1).write.mode("overwrite").parquet(f"{path}/parts")
        self.pipeline.write().overwrite().save(f"{path}/pipeline")

    @staticmethod
    def load(spark: SparkSession, path: str) -> IndexedModel:
        parts = [(r["name"], r["width"]) for r in spark.read.parquet(f"{path}/parts").orderBy("place").collect()]
        return IndexedModel(FrequencyIndex.load(spark, f"{path}/index"), parts, PipelineModel.load(f"{path}/pipeline"))
