"""Readers for delimited and JSON logs.

Give a schema where one is known: inference costs a full extra pass.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.columns import named, quoted
from packetloom.operators.sampling import limit_rows
from packetloom.sources.columns_json import read_column_documents

INDEX_COLUMN = "row_id"

Schema = T.StructType | str


def _delimited(
    spark: SparkSession, path: str, sep: str, schema: Schema | None, multiline: bool
) -> DataFrame:
    reader = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("enforceSchema", False)
    )
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_csv(
    spark: SparkSession, path: str, schema: Schema | None = None, multiline: bool = False
) -> DataFrame:
    """Comma-separated file with a header. Header names are kept verbatim.

    An empty value is null, quoted or not.
    ``multiline`` allows line breaks inside quoted values; such files cannot be
    split, so it is off by default.
    """
    return _delimited(spark, path, ",", schema, multiline)


def read_tsv(
    spark: SparkSession,
    path: str,
    schema: Schema | None = None,
    index_col: bool | str = True,
    rows: int | None = None,
    multiline: bool = False,
) -> DataFrame:
    """Tab-separated file whose first column is a row index.

    ``index_col=True`` drops the index, a name keeps it under that name, and
    ``False`` means there is none. ``rows`` keeps the rows with the lowest index.
    """
    df = _delimited(spark, path, "\t", schema, multiline)
    if not index_col:
        if rows is not None:
            raise ValueError("rows needs an index column to order by")
        return df
    first = df.columns[0]
    if rows is not None:
        df = limit_rows(df, rows, first)
    return df.withColumnRenamed(first, index_col) if isinstance(index_col, str) else df.drop(first)


def read_json(
    spark: SparkSession,
    path: str,
    schema: Schema | None = None,
    layout: str = "records",
    multiline: bool = False,
    index: str = INDEX_COLUMN,
) -> DataFrame:
    """JSON logs in one of two layouts.

    ``records``: one object per row (one per line, or whole documents with
    ``multiline``). ``columns``: objects of the form ``{column: {row: value}}``;
    the row key becomes ``index``. One object per line is parsed by the task that
    reads the line; with ``multiline`` a file is one object, laid out freely,
    and is read in blocks by many tasks.
    """
    if layout == "records":
        reader = spark.read.option("multiLine", multiline)
        return (reader.schema(schema) if schema is not None else reader).json(path)
    if layout != "columns":
        raise ValueError(f"unknown JSON layout {layout!r}")
    if multiline:
        given = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        return read_column_documents(spark, path, None if given is None else list(given.fields), index)
    objects = spark.read.text(path).filter("trim(value) <> ''")
    fields = _column_fields(objects, schema)
    nested = ", ".join(f"{quoted(f.name)}: map<string, {f.dataType.simpleString()}>" for f in fields)
    parsed = objects.select(F.from_json("value", f"struct<{nested}>").alias("o"))
    return parsed.select(F.explode(_rows_by_key(fields)).alias(index, "row")).select(
        named(index), *[F.col(f"row.c{i}").alias(f.name) for i, f in enumerate(fields)]
    )


def _column_fields(objects: DataFrame, schema: Schema | None) -> list[T.StructField]:
    """Flat columns of column-layout objects; types are inferred if not given."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if schema is not None:
        return list(schema.fields)
    cells = objects.select(F.explode(F.from_json("value", "map<string, map<string, string>>"))).select(
        F.col("key").alias("column"), F.explode("value").alias("row", "text")
    )
    text = F.col("text")
    kinds = (
        cells.groupBy("column")
        .agg(
            F.coalesce(F.bool_and(text.isNull() | text.try_cast("bigint").isNotNull()), F.lit(False)).alias("whole"),
            F.coalesce(F.bool_and(text.isNull() | text.try_cast("double").isNotNull()), F.lit(False)).alias("real"),
        )
        .orderBy("column")
        .collect()
    )
    return [
        T.StructField(
            r["column"], T.LongType() if r["whole"] else T.DoubleType() if r["real"] else T.StringType()
        )
        for r in kinds
    ]


def _rows_by_key(fields: list[T.StructField]):
    """Merge the per-column maps of one object into row key → row, without a shuffle."""

    def cell(i: int, value):
        return F.struct(
            *[
                (value if j == i else F.lit(None)).cast(f.dataType).alias(f"c{j}")
                for j, f in enumerate(fields)
            ]
        )

    def merge(i: int):
        def both(_, rows, value):
            return F.struct(
                *[
                    (value if j == i else rows[f"c{j}"]).cast(f.dataType).alias(f"c{j}")
                    for j, f in enumerate(fields)
                ]
            )

        return both

    def column(i: int):
        values = F.col(f"o.{quoted(fields[i].name)}")
        return F.coalesce(values, F.create_map().cast(f"map<string, {fields[i].dataType.simpleString()}>"))

    rows = F.transform_values(column(0), lambda _, v: cell(0, v))
    for i in range(1, len(fields)):
        rows = F.map_zip_with(rows, column(i), merge(i))
    return rows


def load(
    spark: SparkSession, path: str, schema: Schema | None = None, tabbed: bool = False, **options
) -> DataFrame:
    """Pick the reader by file extension, upper or lower case.

    ``tabbed`` reads ``.csv`` as the tab-separated, indexed variant.
    """
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension == ".json":
        return read_json(spark, path, schema, **options)
    if extension == ".tsv" or (extension == ".csv" and tabbed):
        return read_tsv(spark, path, schema, **options)
    if extension == ".csv":
        return read_csv(spark, path, schema, **options)
    raise ValueError(f"no reader for {extension!r}; use .csv, .tsv or .json")
