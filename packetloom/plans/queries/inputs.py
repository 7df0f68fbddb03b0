"""The driver's tables in the roles of flow records, host metrics and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.plans.ensemble import EnsembleFormat

FLOW_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
FLOW_NUMERICS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FLOW_LAYOUT = EnsembleFormat(features=tuple(FLOW_NUMERICS), label="verdict")

HOST_SQL = """
  select event_id, 'host-' || (user_id % 7) as hostname, cast(hour(ts) as integer) as hour, value as load,
         cast(regexp_extract(props, '[0-9]+') as double) / 100.0 as memutil,
         user_id / 150.0 as netutil
  from events"""

SCORED_SQL = """
  select event_id, event_type, (value - lo) / (hi - lo) as score,
         case when event_type = 'error' then 1 else 0 end as truth
  from events, (select min(value) as lo, max(value) as hi from events)"""

FLOW_SQL = """
  select *, cast(floor(l_quantity / 10) as integer) as size_class,
         case when (l_linenumber + floor(l_quantity / 10) >= 7) <> (l_partkey % 10 = 0) then 1 else 0 end as label
  from lineitem"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as flows: supplier and part play the addresses.

    ``verdict`` depends on two features, so models have something to learn,
    and is turned round for every tenth part, so no model can be perfect.
    """
    size_class = F.floor(F.col("l_quantity") / 10)
    attack = (F.col("l_linenumber") + size_class >= 7) != (F.col("l_partkey") % 10 == 0)
    return table(spark, sf_dir, "lineitem").select(
        "*",
        size_class.cast("string").alias("size_class"),
        F.col("l_suppkey").cast("string").alias("source_ip"),
        F.col("l_partkey").cast("string").alias("dest_ip"),
        F.when(attack, "DDoS").otherwise("BENIGN").alias("verdict"),
    )


def host_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as host metrics."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.concat(F.lit("host-"), (F.col("user_id") % 7).cast("string")).alias("hostname"),
        F.hour("ts").alias("hour"),
        F.col("value").alias("load"),
        (F.get_json_object("props", "$.k").cast("double") / 100.0).alias("memutil"),
        (F.col("user_id") / 150.0).alias("netutil"),
    )


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a score in [0, 1] and a 0/1 truth."""
    from packetloom.operators.scale import minmax

    events = table(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        F.col("value").alias("score"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("truth"),
    )
    return minmax(events, ["score"])
