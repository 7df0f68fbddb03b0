"""Projection, labelling, cleaning and config-driven shaping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.columns import benign_as_zero, exceeds, named


def select_features(
    df: DataFrame, label: str, cols: Sequence[str], alias: str = "label_unreg"
) -> DataFrame:
    """Keep the label under ``alias`` and the listed feature columns."""
    return df.select(named(label).alias(alias), *[named(c) for c in cols])


def binary_label(
    df: DataFrame, col: str = "label_unreg", benign: str = "normal", out: str = "label", drop: bool = True
) -> DataFrame:
    """Add a 0/1 label (benign = 0; everything else, null included, = 1)."""
    labelled = df.withColumn(out, benign_as_zero(col, benign))
    return labelled.drop(col) if drop and col != out else labelled


def drop_unlabelled(df: DataFrame, col: str, sentinel: str = "0") -> DataFrame:
    """Drop rows whose label is the sentinel string; rows with a null label stay."""
    return df.filter(~named(col).eqNullSafe(F.lit(sentinel)))


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Replace null and NaN by 0 in numeric columns; strings are left alone."""
    wanted = set(df.columns if cols is None else cols)
    filled = []
    for field in df.schema.fields:
        column = named(field.name)
        if field.name in wanted and isinstance(field.dataType, T.NumericType):
            zero = F.lit(0).cast(field.dataType)
            if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
                column = F.nanvl(column, zero)
            column = F.coalesce(column, zero)
        filled.append(column.alias(field.name))
    return df.select(*filled)


def filter_rows(df: DataFrame, predicate: str) -> DataFrame:
    """Keep the rows that satisfy a SQL predicate."""
    return df.filter(predicate)


def shape(df: DataFrame, spec: Mapping[str, object], rename: bool = False) -> DataFrame:
    """Keep the configured columns that exist, in config order.

    ``spec`` maps a column name to its settings. ``transform`` is a SQL
    expression over the source columns; ``col_name`` is the new name and is
    applied only with ``rename=True``. Absent columns are ignored, and so are
    settings that are not a mapping.
    """
    present = set(df.columns)
    kept = []
    for name, settings in spec.items():
        if name not in present:
            continue
        options = settings if isinstance(settings, Mapping) else {}
        transform = options.get("transform")
        column = F.expr(str(transform)) if transform else named(name)
        target = options.get("col_name") if rename else None
        kept.append(column.alias(str(target) if target else name))
    return df.select(*kept)


def with_score(df: DataFrame, name: str, score: Column) -> DataFrame:
    """Put a score beside the row it belongs to; label and key ride along."""
    return df.withColumn(name, score)


def flag(df: DataFrame, score: str, threshold: float | Column, out: str = "flag") -> DataFrame:
    """1 where the score is strictly above the threshold, else 0."""
    return df.withColumn(out, exceeds(score, threshold).cast("int"))
