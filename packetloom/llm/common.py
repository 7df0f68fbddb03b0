"""What the text operators share: reading, block-wise Arrow maps, words, hashes, skew-safe joins."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.session import materialize

__all__ = [
    "BLOCK_BYTES",
    "WordHashes",
    "blocks",
    "fold",
    "heavy_light_join",
    "map_blocks",
    "materialize",
    "mixed",
    "pack",
    "read_table",
    "run_starts",
    "unpack",
    "windows",
]

#: Text that a task works on at once; a longer text is a block of its own.
BLOCK_BYTES = 2_000_000
#: A key with this share of the rows is joined by broadcast; at most 1 / share keys can be.
HEAVY_SHARE = 0.001

P1 = np.uint64(0x9E3779B97F4A7C15)
P2 = np.uint64(0xBF58476D1CE4E5B9)
P3 = np.uint64(0x94D049BB133111EB)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts


def blocks(batches: Iterable[pa.RecordBatch], text: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` bytes of text each, so that memory is bounded by a block."""
    for batch in batches:
        column = batch.column(text)
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start = total = 0
        for i, size in enumerate(sizes):
            if i > start and total + size > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if len(batch) > start:
            yield batch.slice(start)


def map_blocks(df: DataFrame, text: str, schema: str, work: Callable[[pa.RecordBatch], dict], most: int = BLOCK_BYTES) -> DataFrame:
    """``work`` turns a block of rows into columns by name; types come from ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    types = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()  # what an earlier task of this worker left
        for block in blocks(batches, text, most):
            made = work(block)
            yield pa.RecordBatch.from_arrays(
                [made[f.name].cast(f.type) if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type, from_pandas=False) for f in arrow], schema=arrow
            )

    return df.mapInArrow(run, types)


class WordHashes(dict):
    """64-bit hashes of words, remembered for the words met before; forgets all when it is full."""

    MOST = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * P2
    x = (x ^ (x >> np.uint64(27))) * P3
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` consecutive items; empty if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, width):
        out *= P1
        out += hashes[i : i + n]
    return mixed(out)


def run_starts(ordered: np.ndarray) -> np.ndarray:
    """True where a sorted array has a new value."""
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return new


def pack(a: np.ndarray) -> bytes:
    """The bytes of all items by place, so that the equal high ones lie together and compress."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unpack(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def heavy_light_join(rows: DataFrame, keyed: DataFrame, key: str, count: str, total: int, values: list[str]) -> DataFrame:
    """Left join of ``rows`` to ``keyed`` (one row a key, with its number of rows in ``count``) without a hot task.

    Keys with ``HEAVY_SHARE`` of all rows or more, at most 1 / ``HEAVY_SHARE`` of them, are broadcast;
    their rows take no part in the shuffled join of the others. A null key is a key.
    """
    line = F.lit(total) * HEAVY_SHARE
    own = "__k_own"
    keyed = keyed.select(F.struct(F.col(key).isNull().alias("no"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("as")).alias("__k_pair"), count, *values)
    heavy = keyed.where(F.col(count) >= line).select(F.col("__k_pair").alias("__k_heavy"), F.struct(*values).alias("__v_heavy"))
    light = keyed.where(F.col(count) < line).select(F.col("__k_pair").alias("__k_light"), F.struct(*values).alias("__v_light"))
    pair = F.struct(F.col(key).isNull().alias("no"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("as"))
    found = rows.withColumn(own, pair).join(F.broadcast(heavy), F.col(own) == F.col("__k_heavy"), "left")
    spread = F.struct(F.lit(True).alias("no"), F.concat(F.lit("-"), F.xxhash64(*rows.columns).cast("string")).alias("as"))
    found = found.withColumn(own, F.when(F.col("__k_heavy").isNotNull(), spread).otherwise(F.col(own)))
    found = found.join(light, F.col(own) == F.col("__k_light"), "left").withColumn("__v", F.coalesce("__v_heavy", "__v_light"))
    return reduce(lambda d, v: d.withColumn(v, F.col(f"__v.{v}")), values, found).drop(own, "__k_heavy", "__k_light", "__v_heavy", "__v_light", "__v")
