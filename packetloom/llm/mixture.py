"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets an exponential key, -ln(u) / quality; in the order of their keys the documents of a
source are a weighted sample without replacement. A source whose target holds it more than once gives
complete epochs first; the rest of its target is filled in key order up to the word budget.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import heavy_light_join, materialize

WORD = r"[^\x20\x09-\x0D]+"


def quality_weight(words: Column, symbols: Column) -> Column:
    """0 to 1: falls with the symbols per word."""
    return (1 + words) / (1 + words + 4 * symbols)


def uniform(doc_id: Column, seed: str) -> Column:
    """52 bits of md5(seed:id) as a number strictly between 0 and 1."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / F.lit(2.0**52)


def source_targets(sizes: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """A row a source: ``source``, ``source_size``, ``target``.

    Sources by code point, null last, weigh ``weights``, repeating. All words are shared by weight; no
    target is above ``most`` times its source's words, and what is beyond is shared again by weight. With
    sources ordered by cap / weight, the first k are at their caps where the share of the others, (all -
    caps) / weights left, is not above the next one's ratio. One row a source, after partial sums.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (place % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, after, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    leveled = ranked.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(every))
    return leveled.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def _keyed(docs: DataFrame, doc_id: str, text: str, source: str, seed: str) -> DataFrame:
    """``docs`` with ``__size`` (words) and ``__key``."""
    symbols = F.coalesce(F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", "")), F.lit(0))
    rows = docs.withColumn("__size", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"))
    return rows.withColumn("__key", -F.log(uniform(F.col(doc_id), seed)) / quality_weight(F.col("__size"), symbols))


def _placed(docs: DataFrame, doc_id: str, text: str, source: str, weights: tuple[float, ...], most: float, seed: str) -> tuple[DataFrame, DataFrame]:
    """Documents in key order with the words up to each, its source's target, epochs and rest; and each source's filling document."""
    keyed = _keyed(docs, doc_id, text, source, seed).select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col("__size").alias("size"), F.col("__key").alias("key"))
    # stored first: cutting ranges reads its input twice, and texts should be read once
    sizes = materialize(_summed_by_range(materialize(keyed, "mixture-keys")), "mixture-sizes")
    targets = source_targets(sizes, weights, most)
    targets = targets.withColumn("epochs", F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long"))
    targets = targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    totals = sizes.groupBy("source", "slot").agg(F.sum("size").alias("in_slot"))
    before = F.coalesce(F.sum("in_slot").over(Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.withColumn("before", before).join(targets.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of", "in_slot")
    placed = _by_slot(sizes, offsets)
    placed = materialize(placed.withColumn("through", F.col("before") + F.col("within")).drop("before", "within"), "mixture-order")
    # the gap that each source's first documents leave, and the one document that fills it best
    gaps = placed.groupBy("source").agg(F.first("rest").alias("rest"), F.max(F.when(F.col("through") <= F.col("rest"), F.col("through"))).alias("full"))
    gaps = gaps.select("source", (F.col("rest") - F.coalesce("full", F.lit(0))).alias("gap"))
    gaps = placed.select("source", "slot").distinct().join(gaps.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    left = _by_slot(placed.where("through > rest and size > 0"), gaps).where("abs(gap - size) < gap")
    return placed, left.groupBy("source").agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")), "key", "doc_id", "through", "size")).alias("fill"))


def _summed_by_range(keyed: DataFrame) -> DataFrame:
    """``keyed`` with ``slot``, the range of (source, key) that a row lies in, and ``within``, the words of its
    source in that range up to it.

    Ranges hold about as many rows each, whatever the distribution of the keys and the sizes of sources,
    and a task sums up one while it streams by in order.
    """
    order = ["source", "key", "doc_id", "size"]
    kinds = {f.name: f.dataType.simpleString() for f in keyed.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, last, carried = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not len(batch):
                continue
            source, size = batch.column("source").to_pylist(), batch.column("size").to_numpy()
            sums = np.cumsum(size)
            new = np.fromiter((i > 0 and x != source[i - 1] for i, x in enumerate(source)), bool, len(source))
            base = np.where(new, sums - size, 0)
            base[0] = -carried if last == (source[0],) else 0
            start = np.maximum.accumulate(np.where(new, np.arange(len(source)), 0))
            within = sums - base[start]
            last, carried = (source[-1],), int(within[-1])
            yield batch.append_column("slot", pa.array(np.full(len(source), slot, np.int64))).append_column("within", pa.array(within.astype(np.int64)))

    ranges = keyed.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    return ranges.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in order) + ", slot long, within long")


def mix_sources(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: float = 3, seed: str = "mix"
) -> DataFrame:
    """One row a document: ``doc_id``, ``size`` (words), ``source``, ``source_size``, ``target``, ``copies``, ``taken`` = size x copies.

    Copies are the complete epochs, floor(target / source_size), and one more for the documents that come
    first by key while the words taken stay within the rest of the target. The document that would pass it
    is skipped for the one left whose size is nearest to the gap, if taking that brings the sum nearer.
    Documents are taken whole. Null and empty texts have size 0 and key order as any other; a source
    without words has target 0. Keys depend on the id alone, so reruns agree; rows with equal ids share a key
    and order by size. A source's rows lie in ranges of the key with about as many rows each, summed apart
    and offset, so that no task holds a source.
    """
    placed, fills = _placed(docs, doc_id, text, source, weights, most, seed)
    fills = placed.select("source", "slot").distinct().join(fills.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).select("source", "slot", F.col("fill.through").alias("fill"))
    chosen = (F.col("through") <= F.col("rest")) | (F.col("through") == F.coalesce("fill", F.lit(-1))) & (F.col("size") > 0)
    out = _by_slot(placed, fills, "left").withColumn("copies", F.col("epochs") + chosen.cast("long"))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: float = 3, seed: str = "mix"
) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix_sources`` takes it.

    A source's choice is its epochs, the last row by (key, id, size) that fits and the filling one, so rows are
    chosen where they lie and texts of large sources aren't shuffled. Rows equal in id and size are chosen
    alike. All columns stay.
    """
    placed, fills = _placed(docs, doc_id, text, source, weights, most, seed)
    row = F.struct("key", "doc_id", "size")
    plan = placed.groupBy("source").agg(F.count("*").alias("__n"), F.first("epochs").alias("__epochs"), F.max(F.when(F.col("through") <= F.col("rest"), row)).alias("__last"))
    fills = fills.select(F.col("source").alias("of"), F.struct("fill.key", "fill.doc_id", "fill.size").alias("__fill"))
    plan = materialize(plan.join(fills, F.col("source").eqNullSafe(F.col("of")), "left").drop("of"), "mixture-plan")
    total = plan.agg(F.sum("__n")).first()[0] or 0
    rows = heavy_light_join(_keyed(docs, doc_id, text, source, seed), plan.withColumnRenamed("source", source), source, "__n", total, ["__epochs", "__last", "__fill"])
    own = F.struct(F.col("__key").alias("key"), F.col(doc_id).alias("doc_id"), F.col("__size").alias("size"))
    chosen = F.coalesce(own <= F.col("__last"), F.lit(False)) | F.coalesce((own == F.col("__fill")) & (F.col("__size") > 0), F.lit(False))
    copies = (F.coalesce("__epochs", F.lit(0)) + chosen.cast("long")).cast("int")
    return rows.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*docs.columns)


def _by_slot(rows: DataFrame, keyed: DataFrame, how: str = "inner") -> DataFrame:
    """Join on source, null being a source, and slot."""
    keyed = keyed.withColumnRenamed("source", "of").withColumnRenamed("slot", "part")
    return rows.join(keyed, F.col("source").eqNullSafe(F.col("of")) & (F.col("slot") == F.col("part")), how).drop("of", "part")
