"""Column expressions: labels, flags, hashes, rates and small model formulas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_SPACE = 2**32


def quoted(name: str) -> str:
    """A column name safe inside an expression (spaces, slashes and dots)."""
    return "`" + name.replace("`", "``") + "`"


def named(name: str) -> Column:
    """The column with exactly this name."""
    return F.col(quoted(name))


def benign_as_zero(label: str, benign: str) -> Column:
    """0 for the benign token, 1 for every other value, null included."""
    return F.when(named(label) == F.lit(benign), 0).otherwise(1)


def is_finite(value: Column) -> Column:
    """True for a number that is neither NaN nor infinite; false for null."""
    value = value.cast("double")
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def finite_or_zero(value: Column) -> Column:
    """The value as a double; null, NaN and infinite ones as 0."""
    return F.when(is_finite(value), value.cast("double")).otherwise(F.lit(0.0))


def exceeds(score: str, threshold: float | Column) -> Column:
    """Strictly above the threshold. A null or NaN score is never above it."""
    value = named(score).cast("double")
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return F.coalesce((value > limit) & ~F.isnan(value), F.lit(False))


def ratio(top: Column, bottom: Column) -> Column:
    """``top / bottom``, null where the denominator is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def logistic_score(cols: Sequence[str], weights: Sequence[float], intercept: float) -> Column:
    """Logistic-regression probability written out as a column expression."""
    z = F.lit(float(intercept))
    for name, weight in zip(cols, weights, strict=True):
        z = z + F.lit(float(weight)) * named(name)
    return sigmoid(z)


def as_keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def key_digest(key: str | Sequence[str], seed: int | None = None) -> Column:
    """md5 of the key columns, salted by ``seed``; never null."""
    parts: list[Column] = [] if seed is None else [F.lit(str(seed))]
    parts += [F.coalesce(named(k).cast("string"), F.lit("")) for k in as_keys(key)]
    return F.md5(F.concat_ws(":", *parts))


def leading_number(digest: Column, hex_digits: int = 8) -> Column:
    """Leading hex digits of a digest as a non-negative integer."""
    return F.conv(F.substring(digest, 1, hex_digits), 16, 10).cast("bigint")


def key_hash(key: str | Sequence[str], seed: int | None = None, hex_digits: int = 8) -> Column:
    """Leading digits of the key digest; below ``HASH_SPACE`` for eight digits."""
    return leading_number(key_digest(key, seed), hex_digits)


def fenced(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """``df`` with new ``columns``, computed once a row.

    A filter on something built from plain columns is moved below their projection with every formula
    written out, which multiplies from stage to stage. Values that come out of an array of one
    struct stay where they are, still in generated code.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
