"""Order MinHash: signatures of minimal occurrence-numbered k-mers that keep their order in the text.

Each k-mer of code points gets the number of its earlier occurrences, so that a text is a set of
(k-mer, number) pairs. A base hash puts these pairs on a circle of 64-bit numbers; ``ROWS`` points of
the circle each start a rotated order of all pairs. Under each order the ``TUPLE`` minimal pairs are
taken, put back into text order and hashed together. Two texts agree in a component with a probability
that falls with both missing and displaced k-mers, hence with edit distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import blocks, map_blocks, mixed, run_starts

#: Code points in a k-mer (a power of two), pairs in a component, components.
K, TUPLE, ROWS = 8, 2, 64

_STARTS = np.arange(ROWS, dtype=np.uint64) * np.uint64(2**64 // ROWS)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x9E3779B97F4A7C15


def k_mers(text: str) -> np.ndarray:
    """A hash for each k-mer in text order; a shorter text that isn't empty is one k-mer."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    if 0 < len(codes) < K:
        codes = np.concatenate([codes, np.zeros(K - len(codes), np.uint64)])
    width = 1
    while width < K and len(codes) > width:
        codes = codes[:-width] * np.uint64(pow(_BASE, width, 2**64)) + codes[width:]
        width *= 2
    return mixed(codes) if width == K else np.empty(0, np.uint64)


def order_minhash(text: str) -> np.ndarray:
    """``ROWS`` 32-bit components; all zero for the empty text."""
    hashes = k_mers(text)
    if not len(hashes):
        return np.zeros(ROWS, np.uint32)
    order = np.argsort(hashes)
    ordered = hashes[order]
    first = run_starts(ordered)
    keys, places, extra = ordered, order, None
    if not first.all():
        run = np.cumsum(first) - 1
        repeated = np.bincount(run)[run] > 1
        at, of = order[repeated], run[repeated]
        by_place = np.lexsort((at, of))
        at, of, own = at[by_place], of[by_place], ordered[repeated]
        begin = np.flatnonzero(run_starts(of))
        number = np.arange(len(of)) - np.repeat(begin, np.diff(np.append(begin, len(of))))
        order = order.copy()
        order[repeated] = at
        keys, places = ordered[first], order[first]
        later = number > 0
        extra_keys = mixed(own[later] + number[later].astype(np.uint64) * _STEP)
        sort = np.argsort(extra_keys)
        extra = extra_keys[sort], at[later][sort]
    found = [_next(keys, places)] + ([_next(*extra)] if extra else [])
    near = np.concatenate([x for x, _ in found], axis=1)
    where = np.concatenate([x for _, x in found], axis=1)
    if near.shape[1] > TUPLE:
        least = np.argsort(near - _STARTS[:, None], axis=1, kind="stable")[:, :TUPLE]
        near, where = np.take_along_axis(near, least, 1), np.take_along_axis(where, least, 1)
    in_text = np.argsort(where, axis=1, kind="stable")
    near = np.take_along_axis(hashes[where], in_text, 1)
    out = near[:, 0].copy()
    for i in range(1, near.shape[1]):
        out = mixed(out * np.uint64(_BASE) + near[:, i])
    return (mixed(out) >> np.uint64(32)).astype(np.uint32)


def _next(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ``TUPLE`` sorted keys that follow each start on the circle (all keys if there are fewer) and their places."""
    at = (np.searchsorted(keys, _STARTS)[:, None] + np.arange(min(TUPLE, len(keys)))) % len(keys)
    return keys[at], places[at]


def likeness(a: np.ndarray, b: np.ndarray, a_empty: bool, b_empty: bool) -> float:
    """0 to 1: the share of equal components, taken to the power 1 / ``TUPLE`` as a component needs that many hits."""
    if a_empty or b_empty:
        return float(a_empty and b_empty)
    return float((a == b).mean() ** (1 / TUPLE))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: its id and ``fingerprint`` (hex). Null counts as the empty text, whose fingerprint is all zeros.

    Rows are independent: repeated rows and ids stay, other columns are not read, an empty table gives none.
    """
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(block: pa.RecordBatch) -> dict:
        made = [order_minhash(x or "").astype(">u4").tobytes().hex() for x in block.column("text").to_pylist()]
        return {"doc_id": block.column("doc_id"), "fingerprint": made}

    return map_blocks(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", f"doc_id {kind}, fingerprint string", work)


def dealt_by_id(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text``, ``head``: partitions of consecutive ids, each sorted from the largest, null last, ties by text.

    After each stretch of ids follow, marked ``head``, the rows of the largest id of the next one, and after
    the last those of the very first, so that each row's successor is in its partition. Ids alone are read
    to cut the stretches; their number follows the number of partitions.
    """
    spark = docs.sparkSession
    ids = docs.select("doc_id")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ids.rdd.getNumPartitions())
    cuts = ids.stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n) if n > 1 else []
    splits = [-float("inf"), *sorted({*cuts, 0.0}), float("inf")]
    by = Bucketizer(splits=splits, inputCol="__as", outputCol="__part")

    def cut_up(df: DataFrame) -> DataFrame:
        return by.transform(df.withColumn("__as", F.col("doc_id").cast("double"))).withColumn("__bucket", F.coalesce("__part", F.lit(float(len(splits)))))

    cut = cut_up(ids)
    tops = cut.groupBy("__bucket").agg(F.max("doc_id").alias("top"), F.count("*").alias("n")).collect()  # a row a stretch
    known = sorted((r for r in tops if r.top is not None), key=lambda r: -r["__bucket"])
    rest = [r for r in tops if r.top is None]
    chain = [*known, *rest]
    heads = [(r["__bucket"], r.top, chain[i - 1]["__bucket"]) for i, r in enumerate(chain)]
    heads = spark.createDataFrame(heads, f"__b double, __top {docs.schema['doc_id'].dataType.simpleString()}, __to double")
    rows = cut_up(docs.select("doc_id", "text"))
    rows = rows.join(F.broadcast(heads), (F.col("__bucket") == F.col("__b")) & F.col("doc_id").eqNullSafe(F.col("__top")), "left")
    own = F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("head"))
    copy = F.struct(F.col("__to").alias("b"), F.lit(True).alias("head"))
    rows = rows.withColumn("__at", F.explode(F.when(F.col("__to").isNull(), F.array(own)).otherwise(F.array(own, copy))))
    rows = rows.select("doc_id", "text", F.col("__at.b").alias("stretch"), F.col("__at.head").alias("head"))
    # a stretch to a partition: hashed, several would meet in one task
    return rows.repartitionById(len(splits) + 1, F.col("stretch").cast("int")).sortWithinPartitions("stretch", "head", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_first())


def edited_likeness(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    Edited: the last floor(n / 3) code points replaced by the first as many, or all, of the next document's
    in descending id order (null last, equal ids by text; after the last comes the first; a lone document
    follows itself). Null counts as empty. ``edited`` is the edited text's SHA-256.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = dealt_by_id(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(id, text, fingerprint, next text, next fingerprint), over the ends of blocks; None where a block ends."""
        last, done = None, None
        for block in blocks(batches, "text"):
            for stretch, head, key, own in zip(*(block.column(i).to_pylist() for i in ("stretch", "head", "doc_id", "text")), strict=True):
                if stretch == done:
                    continue  # further rows of the head's id
                print_ = order_minhash(own := own or "")
                if last is not None:
                    yield *last, own, print_
                last, done = ((key, own, print_), done) if not head else (None, stretch)
            yield None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        for pair in pairs(batches):
            if pair is not None:
                key, own, a, after, b = pair
                cut = len(own) // 3
                edited = own[: len(own) - cut] + after[:cut]
                e = order_minhash(edited) if cut else a
                made.append((key, len(own), hashlib.sha256(edited.encode()).hexdigest(), a.astype(">u4").tobytes().hex(), e.astype(">u4").tobytes().hex(), likeness(a, e, not own, not edited), likeness(a, b, not own, not after)))
            elif made:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*made, strict=True), arrow, strict=True)], names)
                made = []

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = [to_arrow_type(docs.schema[doc_id].dataType), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    return rows.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
