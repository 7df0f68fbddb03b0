"""Writers and the preview used when no output is asked for."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

from packetloom.functions.columns import named
from packetloom.session import forget, scratch_path


def _write_delimited(df: DataFrame, path: str, sep: str, mode: str) -> None:
    (
        df.write.mode(mode)
        .option("header", True)
        .option("sep", sep)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Comma-separated files with a header."""
    _write_delimited(df, path, ",", mode)


def write_tsv(df: DataFrame, path: str, index: str, mode: str = "overwrite") -> None:
    """Tab-separated files with a header; the row key ``index`` comes first."""
    rest = [named(c) for c in df.columns if c != index]
    _write_delimited(df.select(named(index), *rest), path, "\t", mode)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per row; null fields are written too."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_one_file(df: DataFrame, order: Sequence[str], column: str, path: str) -> None:
    """The strings of ``column`` as the lines of a single file, in the order of other columns.

    Ranges of the order are sorted side by side and stored; then one task passes the stored files on, one after
    the other, and holds a line at a time.
    """
    spark, parts = df.sparkSession, scratch_path(df.sparkSession, "sorted-lines")
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(named(column)).write.text(parts)
    stored = spark.read.text(parts)
    stored._scratch = parts
    files = sorted(stored.inputFiles())  # part files are numbered by range
    lines = reduce(DataFrame.union, [spark.read.text(f) for f in files]) if files else stored
    lines.coalesce(1).write.text(path)
    forget(stored)


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """A few rows to look at."""
    return df.limit(n)
