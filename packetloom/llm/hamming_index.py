"""Nearest neighbours by multi-index hashing of learned binary codes.

Vectors become 64-bit codes by a rotation learned on a sample. A code is cut into four substrings, each
with an index of its own. Two codes that differ in at most r bits agree up to r // 4 bits in one substring
at least, so probing every index for substrings that near finds all codes within radius r. What is found is
ranked by exact cosines. A query widens its radius until its k-th neighbour's angle says that nearer ones
can hardly lie beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import materialize
from packetloom.session import forget

BITS, PARTS = 64, 4
WIDTH = BITS // PARTS
#: The fit reads at most so many vectors, the first by a hash of their bytes.
SAMPLE = 10_000
#: Turns of the rotation's fit; sample vectors whose neighbours calibrate the radius.
FIT_STEPS, CALIBRATORS = 40, 200
#: Standard deviations of the code distance, given the angle, that a radius covers beyond its mean.
SPARE = 1.7
#: Codes that the first radius is expected to hold for each wanted neighbour.
FIRST_CODES = 40
#: Vectors and queries of an index cell; larger cells are cut.
CELL_VECTORS, CELL_QUERIES = 20_000, 5_000

POPCOUNT = np.bitwise_count(np.arange(1 << WIDTH, dtype=np.uint32)).astype(np.uint8)


@dataclass(frozen=True)
class Codes:
    """A rotation, and how code distances follow angles: a mean ``slope * angle + base`` with ``deviation``."""

    rotation: np.ndarray
    slope: float
    base: float
    deviation: float
    #: share of codes at each distance or less, between a sample vector and the others
    share: np.ndarray

    def encode(self, unit: np.ndarray) -> np.ndarray:
        bits = (unit @ self.rotation > 0).astype(np.uint8)
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()

    def radius(self, cosine: Column) -> Column:
        """Distance within which the codes of vectors at least this near lie with few exceptions."""
        angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
        return F.ceil(angle * self.slope + (self.base + SPARE * self.deviation)).cast("int")

    def first_probe(self, n: int, k: int) -> int:
        """Substring distance of the first round: its radius holds enough codes of ``n`` on average."""
        r = int(np.searchsorted(self.share * n, FIRST_CODES * k))
        return min(r // PARTS, WIDTH)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of very large values stay finite
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision; every row is summed alike, wherever it stands."""
    x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
    dot = lambda a, b: np.einsum("ij,ij->i", a, b)
    return dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))


def fit(sample: np.ndarray, k: int) -> Codes:
    """Iterative quantisation: the rotation that brings the sample's principal axes near to the corners of the cube.

    Vectors with fewer dimensions than bits are lifted by a random orthonormal map, longer ones keep their
    strongest axes. The code distances of near pairs of the sample give the line from angle to radius.
    """
    rng = np.random.default_rng(7)
    x, d = unit_rows(sample), sample.shape[1]
    if d >= BITS:
        lift = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :BITS]
    else:
        lift = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0][:d]
    low = x @ lift
    turn = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
    for _ in range(FIT_STEPS):
        u, _, v = np.linalg.svd(np.where(low @ turn > 0, 1.0, -1.0).T @ low)
        turn = (u @ v).T
    made = Codes(lift @ turn, 0.0, 0.0, 0.0, np.ones(BITS + 1))
    codes, some = made.encode(x), np.arange(min(CALIBRATORS, len(x)))
    distance = np.bitwise_count(codes[some, None] ^ codes[None, :]).astype(np.int64)
    angle = np.arccos(np.clip(x[some] @ x.T, -1, 1))
    share = np.cumsum(np.bincount(distance.ravel(), minlength=BITS + 1)) / distance.size
    near = np.argsort(angle, axis=1)[:, 1 : 10 * k + 1]
    a, h = (np.take_along_axis(m, near, 1).ravel() for m in (angle, distance))
    if len(a) < 20 or np.ptp(a) < 1e-6:
        return Codes(made.rotation, BITS / np.pi, 0.0, np.sqrt(BITS) / 2, share)
    slope = BITS / np.pi if np.ptp(a) < 0.05 else float(np.polyfit(a, h, 1)[0])
    base = float((h - slope * a).mean())
    return Codes(made.rotation, slope, base, max(1.0, float((h - slope * a - base).std())), share)


def distinct_vectors(rows: DataFrame, vec_id: str, vector: str, keep: int, dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(``print``, ``vec_id``) of the rows that take part, and (``print``, ``ids``, ``bytes``): each distinct vector once
    with its ``keep`` smallest ids.

    Equal vectors have equal scores, so a search for that many neighbours needs no more of their ids; a
    vector that a third of the rows share is one entry, and only its smallest ids pass the shuffle.
    """
    single = rows.schema[vector].dataType.elementType.simpleString() == "float"
    kind = np.float32 if single else np.float64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = batch.column("id").to_pylist(), batch.column("v").to_pylist()
            kept = [(i, np.array(v, kind) + kind(0)) for i, v in zip(ids, vectors, strict=True) if v and None not in v]
            kept = [(i, v.tobytes(), len(v)) for i, v in kept if np.isfinite(v).all() and v.any()]
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in kept], t) for j, t in enumerate((pa.int64(), pa.binary(), pa.int32()))], ["vec_id", "bytes", "size"])

    plain = rows.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast(f"array<{'float' if single else 'double'}>").alias("v"))
    made = materialize(plain.mapInArrow(run, "vec_id long, bytes binary, size int").withColumn("print", F.sha2("bytes", 256)), "ann-rows")
    if dim is None:
        most = made.groupBy("size").count().orderBy(F.desc("count"), "size").first()
        dim = most["size"] if most else 0
    made = made.where(F.col("size") == dim)
    ids = made.groupBy("vec_id").agg(F.min("print").alias("print"))
    place = F.row_number().over(Window.partitionBy("print").orderBy("vec_id"))
    first = ids.withColumn("place", place).where(F.col("place") <= keep).groupBy("print").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    one = made.join(first.select("print", F.col("ids")[0].alias("vec_id"), "ids"), ["print", "vec_id"]).dropDuplicates(["print"])
    return ids, one.select("print", "ids", "bytes")


def _matrix(cells: list[bytes], dim: int) -> np.ndarray:
    """The vectors in double precision; their bytes tell whether they were stored in single."""
    kind = np.float32 if len(cells[0]) == 4 * dim else np.float64
    return np.frombuffer(b"".join(cells), kind).reshape(len(cells), dim).astype(np.float64)


def _encoded(distinct: DataFrame, codes: Codes, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch.column("bytes").to_pylist(), dim)
                yield batch.append_column("code", pa.array(codes.encode(unit_rows(x)).view(np.int64)))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in distinct.schema)
    return distinct.mapInArrow(run, f"{kinds}, code long")


def _best(ids: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
    return np.lexsort((ids, -score))[:keep]


def _search(keep: int, dim: int):
    """One cell: queries that probe it against its vectors.

    ``probe`` is the substring distance of a query's round, ``radius`` the code distance that it covers and
    ``done`` the one that earlier rounds have covered. A vector near in several substrings is taken in
    the first of them.
    """

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        asked, entries, scores = [], [], []
        if len(queries) and len(vectors):
            part = queries.column("part")[0].as_py()
            code, entry = vectors.column("code").to_numpy().view(np.uint64), vectors.column("entry").to_numpy()
            matrix = _matrix(vectors.column("bytes").to_pylist(), dim)
            unit = unit_rows(matrix)
            sub = code.view(np.uint16).reshape(-1, PARTS)
            order = np.argsort(sub[:, part], kind="stable")
            values, starts = np.unique(sub[order, part], return_index=True)
            ends = np.append(starts[1:], len(order))
            x = _matrix(queries.column("bytes").to_pylist(), dim)
            x_unit, x_code = unit_rows(x), queries.column("code").to_numpy().view(np.uint64)
            x_sub = x_code.view(np.uint16).reshape(-1, PARTS)
            columns = [queries.column(c).to_pylist() for c in ("query", "probe", "radius", "done")]
            for i, (query, probe, radius, done) in enumerate(zip(*columns, strict=True)):
                hit = POPCOUNT[values ^ x_sub[i, part]] <= probe  # the probes that this index can answer
                if not hit.any():
                    continue
                at = order if hit.all() else order[np.repeat(hit, ends - starts)]
                distance = np.bitwise_count(code[at] ^ x_code[i])
                at = at[(distance <= radius) & (distance.astype(np.int64) > done)]
                for j in range(part):
                    at = at[POPCOUNT[sub[at, j] ^ x_sub[i, j]] > probe]
                if not len(at):
                    continue
                if len(at) > keep:
                    rough = unit[at] @ x_unit[i]
                    at = at[rough >= np.partition(rough, -keep)[-keep] - 1e-9]
                score = cosines(matrix[at], np.broadcast_to(x[i], (len(at), dim)))
                top = np.lexsort((entry[at], -score))[:keep]
                asked.append(query)
                entries.append(entry[at[top]].tolist())
                scores.append(score[top].tolist())
        return pa.table([pa.array(asked, pa.int64()), pa.array(entries, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], ["query", "entry", "score"])

    return run


def _cells(rows: DataFrame, block_bits: int) -> DataFrame:
    """``rows`` once for every substring, with its number ``part`` and the ``block`` of its high bits."""
    rows = rows.withColumn("part", F.explode(F.array(*(F.lit(j) for j in range(PARTS)))))
    sub = F.expr(f"cast(shiftrightunsigned(code, part * {WIDTH}) & {(1 << WIDTH) - 1} as int)")
    return rows.withColumn("block", F.shiftright(sub, WIDTH - block_bits))


def _best(rows: DataFrame, by: str, item: str, keep: int) -> DataFrame:
    """The ``keep`` items of each ``by`` with the largest scores, ties to the smaller; each task cuts its own first."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), item))
    return rows.withColumn("place", place).where(F.col("place") <= keep)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` (cosine): the ``k`` nearest found for each row of ``queries``.

    A row is no candidate of a query with its own id. Equal scores go by smaller id, repeated rows count
    once, and an id with several vectors stands with one of them, the first by their hashes. Rows without
    id and vectors that are null, empty, zero, hold nulls or non-finite values, or have another length than
    most, take no part. Fewer candidates give fewer rows; empty tables give none; other columns aren't read.

    The index holds each distinct vector once in each of the four parts. Its cells are ranges of a
    substring, as many as the number of vectors asks for; a cell with more vectors or queries is cut, and
    each piece meets all its counterparts. A cell only gives a query's best, so nothing grows with the
    number of codes within a radius. The first radius is the same for all queries; the second follows from
    a query's own neighbours, and one that has found too few goes on until its radius holds every code.
    """
    spark, keep = vectors.sparkSession, k + 1
    _, entries = distinct_vectors(vectors, vec_id, vector, keep)
    sample = [r["bytes"] for r in entries.select("bytes", "print").orderBy("print").limit(SAMPLE).collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    single = vectors.schema[vector].dataType.elementType.simpleString() == "float"
    dim = len(sample[0]) // (4 if single else 8)
    codes = fit(_matrix(sample, dim), k)
    entries = materialize(_encoded(entries.withColumn("entry", F.col("ids")[0]), codes, dim), "ann-entries")
    ids, asked = distinct_vectors(queries, vec_id, vector, 1, dim)
    asked = materialize(_encoded(asked.select("print", "bytes", F.col("ids")[0].alias("query")), codes, dim), "ann-queries")
    n = entries.count()
    block_bits = min(WIDTH, max(0, int(np.ceil(np.log2(max(1, n / CELL_VECTORS))))))
    index = _cells(entries.select("entry", "code", "bytes"), block_bits)
    pieces = index.groupBy("part", "block").agg(F.ceil(F.count("*") / CELL_VECTORS).cast("int").alias("pieces"))
    pieces = materialize(pieces, "ann-cells")  # at most PARTS * 2^WIDTH rows
    index = index.join(F.broadcast(pieces), ["part", "block"]).withColumn("piece", F.pmod(F.xxhash64("entry"), "pieces").cast("int"))

    covers = lambda probe: F.when(probe >= WIDTH, BITS).otherwise(PARTS * (probe + 1) - 1)
    todo = asked.select("query", "code", "bytes", F.lit(codes.first_probe(n, k)).alias("probe"), F.lit(-1).alias("done"))
    todo = materialize(todo.withColumn("radius", covers(F.col("probe"))), "ann-todo")
    found = spark.createDataFrame([], "query long, entry long, score double, place int")
    near_blocks = F.expr(f"filter(sequence(0, {(1 << block_bits) - 1}), b -> bit_count(b ^ own) <= probe)")
    cell = ["part", "block", "piece", "share"]
    while not todo.isEmpty():
        visits = _cells(todo, block_bits).withColumnRenamed("block", "own").withColumn("block", F.explode(near_blocks)).drop("own")
        visits = visits.join(F.broadcast(pieces), ["part", "block"])
        shares = visits.groupBy("part", "block").agg(F.ceil(F.count("*") / CELL_QUERIES).cast("int").alias("shares"))
        shares = materialize(shares, "ann-shares")  # no more rows than cells
        visits = visits.join(F.broadcast(shares), ["part", "block"]).withColumn("share", F.pmod(F.xxhash64("query"), "shares").cast("int"))
        visits = visits.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces", "shares")
        held = index.join(F.broadcast(shares), ["part", "block"]).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("pieces", "shares")
        made = visits.groupBy(*cell).cogroup(held.groupBy(*cell)).applyInArrow(_search(keep, dim), "query long, entry array<long>, score array<double>")
        made = made.select("query", F.explode(F.arrays_zip("entry", "score")).alias("x")).select("query", "x.entry", "x.score")
        before, found = found, materialize(_best(found.drop("place").union(made), "query", "entry", keep), "ann-found")
        # the k-th neighbour besides the query itself tells how far nearer ones may lie
        worst = found.where(F.col("place") == keep).select("query", codes.radius(F.col("score")).alias("needed"))
        rest = todo.join(worst, "query", "left").withColumn("needed", F.coalesce("needed", 2 * F.col("radius") + 1))
        rest = rest.where((F.col("needed") > F.col("radius")) & (F.col("radius") < BITS))
        rest = rest.select("query", "code", "bytes", F.least(F.floor(F.col("needed") / PARTS).cast("int"), F.lit(WIDTH)).alias("probe"), F.col("radius").alias("done"))
        rest = materialize(rest.withColumn("radius", covers(F.col("probe"))), "ann-todo")
        forget(todo, shares, *([before] if hasattr(before, "_scratch") else []))
        todo = rest

    hits = found.drop("place").join(entries.select("entry", "ids"), "entry").select(F.col("query").alias("first"), "score", F.explode("ids").alias("vec_id"))
    best = _best(hits, "first", "vec_id", keep).drop("place")
    rows = ids.withColumnRenamed("vec_id", "query_id").join(asked.select("print", F.col("query").alias("first")), "print").join(best, "first")
    return _best(rows.where("vec_id <> query_id").select("query_id", "vec_id", "score"), "query_id", "vec_id", k).select("query_id", F.col("place").alias("rank"), "vec_id", "score")
