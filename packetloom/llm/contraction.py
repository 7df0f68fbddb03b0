"""Subtree totals of a forest of any depth by parallel tree contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from packetloom.llm.common import materialize
from packetloom.session import forget, scratch_path


def subtree_totals(nodes: DataFrame, values: list[str], name: str = "contraction") -> DataFrame:
    """``node`` and, for each column of ``values``, its sum over the node's subtree, the node included.

    ``nodes`` has ``node`` (long, unique), ``parent`` (null or no node's number: a root) and the values
    (long, no nulls). Rounds alternate two steps. Rake: every leaf goes, and its values are added to its
    parent's. Compress: of the nodes with one child those go whose random number is smaller than their
    child's and than that of a parent that has one child too, so no two of them touch; the child moves up
    to the parent, which takes over the values. A round removes all leaves and about a third of each
    chain, so trees of any shape end after a number of rounds logarithmic in their nodes. A raked node's
    total is known when it goes; re-expansion visits the rounds backwards and gives each compressed node
    the sum of what it held and its child's total.

    Joins are on node numbers that occur once on both sides, and the children of a node meet in sums
    that are combined before the shuffle, so a node with very many children makes no hot task. Every step
    is stored in the shared folder, and a state is deleted once the next one stands.
    """
    spark = nodes.sparkSession
    base = scratch_path(spark, name)
    longs = lambda *names: StructType([StructField(c, LongType()) for c in names])
    raked_at, chain_at, full_at = (f"{base}/{step}" for step in ("raked", "compressed", "expanded"))
    totals, chains = longs("node", "parent", *values, "round"), longs("node", "parent", "child", *values, "round")

    def stored(df: DataFrame, place: str, k: int, schema: StructType) -> DataFrame:
        df.write.parquet(f"{place}/round={k}")
        return spark.read.schema(schema).parquet(f"{place}/round={k}").drop("round")

    def plus(tree: DataFrame, extra: DataFrame) -> DataFrame:
        """``tree`` with the values of ``extra`` added to those of their ``parent``."""
        sums = extra.where("parent is not null").groupBy(F.col("parent").alias("target")).agg(*(F.sum(v).cast("long").alias(f"s_{v}") for v in values))
        rows = tree.join(sums, F.col("node") == F.col("target"), "left")
        return rows.select("node", "parent", *((F.col(v) + F.coalesce(f"s_{v}", F.lit(0))).cast("long").alias(v) for v in values))

    def number(node: str, k: int) -> Column:
        return F.xxhash64(F.col(node), F.lit(k))

    known = nodes.select(F.col("node").alias("parent"))
    inner = nodes.where("parent is not null").join(known, "parent", "left_semi").select("node", "parent", *values)
    tops = nodes.join(inner.select("node"), "node", "left_anti").select("node", F.lit(None).cast("long").alias("parent"), *values)
    alive, k = materialize(inner.union(tops), f"{name}-alive"), 0
    while not alive.isEmpty():
        held = alive.where("parent is not null").select(F.col("parent").alias("target")).distinct()
        has_child = F.col("node") == F.col("target")
        leaves = stored(alive.join(held, has_child, "left_anti").select("node", "parent", *values), raked_at, k, totals)
        raked = materialize(plus(alive.join(held, has_child, "left_semi"), leaves), f"{name}-raked")
        forget(alive)
        only = raked.where("parent is not null").groupBy(F.col("parent").alias("up")).agg(F.count("*").alias("n"), F.min("node").alias("child")).where("n = 1").select("up", "child")
        chain = raked.where("parent is not null").join(only, F.col("node") == F.col("up"))
        chain = chain.join(only.select(F.col("up").alias("above"), F.col("child").alias("below")), F.col("node") == F.col("below"), "left")
        least = (number("node", k) < number("child", k)) & (F.col("above").isNull() | (number("node", k) < number("above", k)))
        gone = stored(chain.where(least).select("node", "parent", "child", *values), chain_at, k, chains)
        moved = gone.select(F.col("child").alias("target"), F.col("parent").alias("higher"))
        rest = raked.join(gone.select("node"), "node", "left_anti").join(moved, has_child, "left")
        alive = materialize(plus(rest.select("node", F.coalesce("higher", "parent").alias("parent"), *values), gone), f"{name}-alive")
        forget(raked)
        k += 1
    forget(alive)
    if not k:
        return spark.createDataFrame([], longs("node", *values))

    ended = spark.read.schema(totals).parquet(raked_at)
    done = None
    for i in reversed(range(k)):
        gone = spark.read.schema(chains).parquet(chain_at).where(F.col("round") == i)
        if gone.isEmpty():
            continue
        # the child outlived this round, so its total comes from a later one
        later = ended.where(F.col("round") > i).select("node", *values)
        later = later.union(done.select("node", *values)) if done is not None else later
        later = later.select(F.col("node").alias("target"), *(F.col(v).alias(f"s_{v}") for v in values))
        full = gone.join(later, F.col("child") == F.col("target"))
        full.select("node", "parent", *((F.col(v) + F.col(f"s_{v}")).alias(v) for v in values)).write.parquet(f"{full_at}/round={i}")
        done = spark.read.schema(totals).parquet(full_at)
    found = ended.select("node", *values)
    return found.union(done.select("node", *values)) if done is not None else found
