"""Connected components of an edge table, as rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import materialize
from packetloom.session import forget


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node``, ``component`` (its smallest node) for the nodes of ``edges`` (``a``, ``b``).

    Alternating stars: each round ties a node's larger neighbours, then its smaller ones, to the least
    node it sees, so that trees flatten in a logarithmic number of rounds. A round is an aggregation of
    minima, summed before the shuffle, and a join back whose hubs adaptive execution splits. Rounds are
    stored in shared storage; loops and repeated edges don't matter; null ends are left out.
    """
    edges = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a <> b").distinct(), f"{name}-large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e")).select(F.col("e.b").alias("a"), F.col("e.m").alias("b"))
        last, edges = edges, materialize(small.where("a <> b").distinct(), f"{name}-small")
        forget(last, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
