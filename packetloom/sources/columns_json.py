"""JSON documents of the form ``{column: {row: value}}``, read by many tasks.

Such a document has no lines to split at. It is read as text cut at its commas, which Spark splits into blocks
like any other file. Whether a comma lies inside a string follows from the number of quotes before it, and
the column of a cell from the last column name before it; both are running sums in a block, carried from block
to block in a table with one row each. Cells then meet by row key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.session import materialize

STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
#: One cell: the braces and column name that may open before it, its key, its value, the braces that may close.
CELL = rf"^\s*\{{?\s*(?:({STRING})\s*:\s*\{{)?\s*(?:({STRING})\s*:\s*({STRING}|[^\"\{{\}}\s]+))?(?:\s*\}})*\s*$"


def _decoded(text: Column, kind: str = "string") -> Column:
    """A JSON value as ``kind``."""
    return F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{kind}>")[0]


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """The text between commas with ``file``, ``block``, ``id`` (its place in the block), ``odd`` (quotes in it, modulo
    2) and ``before`` (quotes before it in the block, modulo 2)."""
    plain = spark.read.option("lineSep", ",").text(path)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")]
    bare = F.regexp_replace("value", r"\\.", "")
    pieces = plain.select("value", *place).withColumn("odd", F.pmod(F.regexp_count(bare, F.lit('"')), F.lit(2)))
    earlier = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.pmod(F.coalesce(F.sum("odd").over(earlier), F.lit(0)), F.lit(2))
    begun = Window.partitionBy("file", "block").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("before", before)
    # pieces up to here that start outside a string, if the block does and if it doesn't
    counts = [F.sum((F.col("before") == parity).cast("long")).over(begun).alias(f"begun{parity}") for parity in (0, 1)]
    return pieces.select("*", *counts)


def _blocks(pieces: DataFrame) -> DataFrame:
    """One row a block: whether it starts inside a string, and how many cells start before it."""
    sums = pieces.groupBy("file", "block").agg(F.pmod(F.sum("odd"), F.lit(2)).alias("odd"), F.max("begun0").alias("n0"), F.max("begun1").alias("n1"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("inside", F.pmod(F.coalesce(F.sum("odd").over(earlier), F.lit(0)), F.lit(2)))
    sums = sums.withColumn("cells", F.when(F.col("inside") == 0, F.col("n0")).otherwise(F.col("n1")))
    return sums.select("file", "block", "inside", F.coalesce(F.sum("cells").over(earlier), F.lit(0)).alias("first"), "cells")


def column_cells(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``column``, ``row``, ``value`` (JSON text) of every cell. Anything but cells is an error."""
    pieces = materialize(_pieces(spark, path), "json-pieces")
    blocks = materialize(_blocks(pieces), "json-blocks")
    rows = pieces.join(F.broadcast(blocks.select("file", "block", "inside", "first")), ["file", "block"])
    begun = F.when(F.col("inside") == 0, F.col("begun0")).otherwise(F.col("begun1"))
    rows = rows.select("file", "block", "id", "value", "odd", (F.col("before") == F.col("inside")).alias("starts"), (F.col("first") + begun).alias("cell"))
    whole = rows.where("starts and odd = 0").select("file", "block", "cell", F.col("value").alias("text"))
    parts = rows.where("not starts or odd = 1").groupBy("file", "cell")
    parts = parts.agg(F.min("block").alias("block"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "id", "value"))), lambda p: p["value"]), ",").alias("text"))
    cells = whole.union(parts.select("file", "block", "cell", "text"))
    group = lambda i: F.nullif(F.regexp_extract("text", CELL, i), F.lit(""))
    # what isn't a cell is carried along and refused at the end, where no filter can move in front
    bad = F.when(~F.col("text").rlike(CELL), F.substring("text", 1, 80))
    cells = cells.select("file", "block", "cell", bad.alias("bad"), group(1).alias("header"), group(2).alias("key"), group(3).alias("value"))
    # the headers that a block's cells can lie under: those inside it and the last one before
    headers = cells.where("header is not null").select("file", F.col("cell").alias("start"), _decoded(F.col("header")).alias("column"))
    headers = materialize(headers, "json-headers")
    over = blocks.join(headers, "file").where("start <= first + cells")
    last = Window.partitionBy("file", "block")
    over = over.withColumn("open", F.max(F.when(F.col("start") <= F.col("first"), F.col("start"))).over(last))
    over = over.where("open is null or start >= open").groupBy("file", "block").agg(F.sort_array(F.collect_list(F.struct("start", "column"))).alias("headers"))
    found = cells.where("key is not null or bad is not null").join(F.broadcast(over), ["file", "block"], "left")
    under = F.filter("headers", lambda h: h["start"] <= F.col("cell"))
    column = F.when(F.size(under) > 0, F.element_at(under, -1)["column"])
    wrong = F.raise_error(F.concat(F.lit("not a document of columns: "), F.coalesce("bad", "key")))
    row = F.when(F.col("bad").isNull() & column.isNotNull(), _decoded(F.col("key"))).otherwise(wrong.cast("string"))
    return found.select("file", column.alias("column"), row.alias("row"), "value")


def infer_fields(cells: DataFrame) -> list[T.StructField]:
    """The documents' columns by name with the narrowest of long, double and string that holds all values."""
    text = _decoded(F.col("value"))
    kinds = cells.select("column", text.alias("text")).groupBy("column").agg(
        F.coalesce(F.bool_and(F.col("text").isNull() | F.col("text").try_cast("bigint").isNotNull()), F.lit(False)).alias("whole"),
        F.coalesce(F.bool_and(F.col("text").isNull() | F.col("text").try_cast("double").isNotNull()), F.lit(False)).alias("real"),
    )
    return [
        T.StructField(r["column"], T.LongType() if r["whole"] else T.DoubleType() if r["real"] else T.StringType())
        for r in kinds.orderBy("column").collect()
    ]


def read_column_documents(spark: SparkSession, path: str, fields: list[T.StructField] | None, index: str) -> DataFrame:
    """One row for each row key of each document (a file), with a column for each field; absent cells are null."""
    cells = column_cells(spark, path)
    if fields is None:
        cells = materialize(cells, "json-cells")
        fields = infer_fields(cells)
    values = [F.max(F.when(F.col("column") == f.name, F.col("value"))).alias(f"c{i}") for i, f in enumerate(fields)]
    rows = cells.groupBy("file", "row").agg(*values)
    return rows.select(F.col("row").alias(index), *[_decoded(F.col(f"c{i}"), f.dataType.simpleString()).alias(f.name) for i, f in enumerate(fields)])
