"""Repeated passages by seed and extend.

Each window of ``LENGTH`` words is tied to its anchor, the least hash of the ``SEED``-word grams inside it
(winnowing: every window has one, and neighbouring windows mostly share it). Documents meet on anchors.
From an anchor a match extends over the windows tied to it, to the left and to the right, as far as the
windows' words agree; runs of neighbouring anchors join up to the maximal repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import P1, WordHashes, blocks, map_blocks, mixed, pack, run_starts, unpack, windows

#: Words of the shortest repeat and of a seed.
LENGTH, SEED = 13, 5
#: Buckets of anchors for each partition of the input.
BUCKETS = 4

_PARTS = ("seeds", "docs", "starts", "counts", "prints", "own_docs", "own_starts", "own_counts")


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's word hashes: seeds, first window and number of windows of each anchor; all windows' prints."""
    if len(words) < LENGTH:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    least, width, span = windows(words, SEED), 1, LENGTH - SEED + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    starts = np.flatnonzero(run_starts(least))
    return least[starts], starts, np.diff(np.append(starts, len(least))), windows(words, LENGTH)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, count numbers."""
    starts, counts = starts.astype(np.int64), counts.astype(np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def _seed_rows(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Anchors packed by block of documents and bucket of seeds.

    Of the anchors of a block that agree in seed and all windows, only the one with the smallest id is sent
    to be met; the others are known to be repeats and go along as ``own``. So a passage in a third of all
    documents is one anchor a block, not one a document. Windows travel as 48 bits beside the seed's 64.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for block in blocks(batches, "text"):
            made = []
            for key, text in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist(), strict=True):
                seeds, starts, counts, prints = anchors(hashes.of((text or b"").split()))
                if len(seeds):
                    made.append((np.full(len(seeds), key, np.int64), seeds, starts.astype(np.uint32), counts.astype(np.uint32), prints))
            if not made:
                continue
            ids, seeds, starts, counts, prints = (np.concatenate(x) for x in zip(*made, strict=True))
            begin = np.cumsum(counts.astype(np.int64)) - counts
            whole = mixed(np.add.reduceat(mixed(prints + _ranges(np.zeros(len(counts), np.int64), counts).astype(np.uint64) * P1), begin) + seeds)
            order = np.lexsort((ids, whole))
            first = run_starts(whole[order])
            owner = ids[order][np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))]
            later = order[(ids[order] > owner)]
            kept = order[ids[order] == owner]  # an anchor that its owner repeats is met at each place
            bucket = (seeds[kept] % np.uint64(n_buckets)).astype(np.int64)
            kept = kept[np.argsort(bucket, kind="stable")]
            bucket.sort()
            later_bucket = (seeds[later] % np.uint64(n_buckets)).astype(np.int64)
            later = later[np.argsort(later_bucket, kind="stable")]
            later_bucket.sort()
            rows = []
            for b in np.unique(np.concatenate([bucket, later_bucket])).tolist():
                at = kept[np.searchsorted(bucket, b) : np.searchsorted(bucket, b, "right")]
                own = later[np.searchsorted(later_bucket, b) : np.searchsorted(later_bucket, b, "right")]
                low = prints[_ranges(begin[at], counts[at])] if len(at) else np.empty(0, np.uint64)
                short = np.ascontiguousarray(low.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                rows.append((b, pack(seeds[at]), pack(ids[at]), pack(starts[at]), pack(counts[at]), short, pack(ids[own]), pack(starts[own]), pack(counts[own])))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i == 0 else pa.binary()) for i, x in enumerate(zip(*rows, strict=True))], ["bucket", *_PARTS])

    return docs.mapInArrow(run, "bucket int, " + ", ".join(f"{p} binary" for p in _PARTS))


def _repeats(kind: str):
    """Of one bucket of anchors: each stretch of windows that also starts in a document with a smaller id."""

    def run(table: pa.Table) -> pa.Table:
        def column(name: str, of: type) -> np.ndarray:
            return np.concatenate([unpack(x, of) for x in table.column(name).to_pylist()])

        counts = column("counts", np.uint32).astype(np.int64)
        short = np.frombuffer(b"".join(table.column("prints").to_pylist()), np.uint8).reshape(-1, 6)
        prints = np.zeros((len(short), 8), np.uint8)
        prints[:, :6] = short
        key = mixed(np.repeat(column("seeds", np.uint64), counts) * P1 + prints.view(np.uint64).ravel())
        docs = np.repeat(column("docs", np.int64), counts)
        starts = _ranges(column("starts", np.uint32).astype(np.int64), counts)
        order = np.argsort(key)
        first = run_starts(key[order])
        owner = np.minimum.reduceat(docs[order], np.flatnonzero(first)) if len(order) else docs
        again = np.zeros(len(key), bool)
        again[order] = docs[order] > owner[np.cumsum(first) - 1]
        docs, starts = docs[again], starts[again]
        new = np.ones(len(docs), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (starts[1:] != starts[:-1] + 1)
        at = np.flatnonzero(new)
        lengths = np.diff(np.append(at, len(docs)))
        out = (np.concatenate([docs[at], column("own_docs", np.int64)]), np.concatenate([starts[at], column("own_starts", np.uint32).astype(np.int64)]), np.concatenate([lengths, column("own_counts", np.uint32).astype(np.int64)]))
        return pa.table({"doc_id": pa.array(out[0], pa.int64()).cast({"int": pa.int32()}.get(kind, pa.int64())), "start": pa.array(out[1].astype(np.int32)), "windows": pa.array(out[2].astype(np.int32))})

    return run


def repeated_stretches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``start``, ``windows``: runs of windows whose words also start in a document with a smaller id."""
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), BUCKETS * rows.rdd.getNumPartitions())
    return _seed_rows(rows, n).groupBy("bucket").applyInArrow(_repeats(kind), f"doc_id {kind}, start int, windows int")


def maximal(starts: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
    """Word ranges [begin, end) that runs of windows cover, joined where they touch or overlap."""
    out: list[list[int]] = []
    for start, count in sorted(zip(starts, counts, strict=True)):
        begin, end = int(start), int(start + count) + LENGTH - 1
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``doc_id``, ``n_words``, ``repeats`` (word ranges [begin, end) that a document with a smaller id has too) and ``kept``, the other words joined by one space.

    Null and empty texts have no words and keep none. Fewer words than ``LENGTH`` have no window. A row
    without id neither loses nor takes words. Rows that repeat an id aren't repeats of each other; if their
    texts differ, each loses the words at all ranges found for the id. Other columns are not read; an empty table gives none.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    marks = repeated_stretches(docs, doc_id, text).groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("windows").alias("counts"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).join(marks, "doc_id", "left")

    def work(block: pa.RecordBatch) -> dict:
        made = []
        for text, starts, counts in zip(*(block.column(c).to_pylist() for c in ("text", "starts", "counts")), strict=True):
            words = (text or b"").split()
            ranges = [(a, min(b, len(words))) for a, b in maximal(starts, counts) if a < len(words)] if starts else []
            kept, at = [], 0
            for a, b in ranges:
                kept += words[at:a]
                at = b
            made.append((len(words), [list(r) for r in ranges], b" ".join(kept + words[at:]).decode("utf-8", "replace")))
        return {"doc_id": block.column("doc_id")} | dict(zip(("n_words", "repeats", "kept"), map(list, zip(*made, strict=True)), strict=True))

    return map_blocks(rows, "text", f"doc_id {kind}, n_words long, repeats array<array<int>>, kept string", work)
