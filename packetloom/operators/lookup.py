"""Joins of rows to a table with one row a key, whatever share of the rows a key holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.columns import named

#: A key with this share of the rows is broadcast; at most ``1 / HEAVY_SHARE`` keys can be.
HEAVY_SHARE = 0.001


def lookup(rows: DataFrame, key: str, table: DataFrame, count: str, total: int, values: Sequence[str]) -> DataFrame:
    """``rows`` with ``values`` of ``table`` by equal ``key``; null where the key is null or unknown.

    ``table`` has one row a key, as a string, and the number of rows that have it in ``count``. Frequent keys
    come by broadcast; their rows get keys of their own for the shuffled join, so that they spread, and
    so do rows without a key.
    """
    heavy = F.col(count) >= HEAVY_SHARE * total
    struct = F.struct(*[named(v) for v in values])
    often = table.where(heavy).select(named(key).alias("__often"), struct.alias("__often_values"))
    seldom = table.where(~heavy).select(named(key).alias("__seldom"), struct.alias("__seldom_values"))
    found = rows.join(F.broadcast(often), named(key).cast("string") == F.col("__often"), "left")
    spread = F.struct(F.lit(True).alias("alone"), F.xxhash64(*[named(c) for c in rows.columns]).cast("string").alias("key"))
    own = F.struct(F.lit(False).alias("alone"), named(key).cast("string").alias("key"))
    probe = F.when(F.col("__often").isNotNull() | named(key).isNull(), spread).otherwise(own)
    found = found.withColumn("__probe", probe).join(
        seldom.withColumn("__seldom", F.struct(F.lit(False).alias("alone"), F.col("__seldom").alias("key"))),
        F.col("__probe") == F.col("__seldom"),
        "left",
    )
    made = F.coalesce("__often_values", "__seldom_values")
    return found.select(*[named(c) for c in rows.columns], *[made[v].alias(v) for v in values])
