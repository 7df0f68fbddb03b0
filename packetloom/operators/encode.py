"""Categorical encoding and vector assembly."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import FeatureHasher, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.columns import named


def index_name(col: str) -> str:
    return f"{col}_index"


def vector_name(col: str) -> str:
    return f"{col}_vec"


def string_index(cols: Sequence[str], handle_invalid: str = "error") -> StringIndexer:
    """Index by descending frequency, ties alphabetical; all columns in one pass."""
    return StringIndexer(
        inputCols=list(cols),
        outputCols=[index_name(c) for c in cols],
        stringOrderType="frequencyDesc",
        handleInvalid=handle_invalid,
    )


def one_hot(cols: Sequence[str], handle_invalid: str = "error") -> OneHotEncoder:
    """One-hot vectors of the indexed columns, last category dropped."""
    return OneHotEncoder(
        inputCols=[index_name(c) for c in cols],
        outputCols=[vector_name(c) for c in cols],
        dropLast=True,
        handleInvalid=handle_invalid,
    )


def assemble(cols: Sequence[str], out: str = "features") -> VectorAssembler:
    """One feature vector from columns and vectors; null is an error, so fill first."""
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="error")


def hash_features(cols: Sequence[str], n: int = 2**18, out: str = "hashed") -> FeatureHasher:
    """Fixed-width encoding for categoricals with too many values to index."""
    return FeatureHasher(
        inputCols=list(cols), outputCol=out, numFeatures=n, categoricalCols=list(cols)
    )


def one_hot_features(df: DataFrame, parts: Sequence[tuple[str, int | None]], out: str = "features") -> DataFrame:
    """The vector of ``one_hot`` and ``assemble``, whose metadata names no slot, so that it can have any number of them.

    A part is an indexed column with its number of slots (an index beyond them has none), or a numeric with
    None. A null or NaN is an error.
    """
    places, size = [], 0
    for _, width in parts:
        places.append((size, width))
        size += 1 if width is None else width

    def make(*values):
        at, found = [], []
        for value, (start, width) in zip(values, places, strict=True):
            if value is None or value != value:
                raise ValueError("null or NaN among the features: fill first")
            if width is None and value != 0:
                at.append(start)
                found.append(value)
            elif width is not None and value < width:
                at.append(start + int(value))
                found.append(1.0)
        return Vectors.sparse(size, at, found)

    columns = [named(c if width is None else index_name(c)).cast("double") for c, width in parts]
    return df.withColumn(out, F.udf(make, VectorUDT())(*columns))
