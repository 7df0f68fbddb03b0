"""Logistic regression on one-hot categoricals with more values than the driver should hold weights for.

Every vector of the optimiser is cut into slices that stay on the executors: weights, gradient and L-BFGS history. The
driver sees products of vectors alone. Rows are packed once, with the list of the weights that a partition needs; an
evaluation sends these to the partition and the sums of its gradient back to the slices. The steps are those of Spark's
own fit without regularisation: features scaled by their deviation and centred, memory of ten, strong Wolfe line search.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.columns import named, sigmoid
from packetloom.operators.encode import index_name
from packetloom.operators.frequency_index import FrequencyIndex
from packetloom.operators.lookup import HEAVY_SHARE, lookup
from packetloom.session import forget, materialize, scratch_path

# Tasks get this module's code with the closure, so executors need not have the
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows packed together, and weights in a slice, at most about.
PART_ROWS, SLICE_SLOTS = 250_000, 100_000
#: Bytes of a record on its way from packing to the store: longer ones are costly to convert.
PIECE = 1 << 20
#: Pairs of steps that the optimiser remembers, and steps after which their lineage is cut.
MEMORY, CUT = 10, 10


def _pack(ids: int, nums: int, k: int):
    """Of a partition: distinct feature ids by slice, each row's places among them, numerics and labels; in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        columns = [np.concatenate(c) for c in zip(*held, strict=True)] if held else [np.zeros(0)] * (ids + nums + 1)
        feature = np.array(columns[:ids], np.int64).reshape(ids, -1)
        x = np.array(columns[ids : ids + nums], np.float64).reshape(nums, -1)
        y = columns[-1].astype(np.float64)
        if np.isnan(x).any():
            raise ValueError("null or NaN among the features: fill first")
        if not np.isin(y, (0.0, 1.0)).all():
            raise ValueError("labels must be 0 or 1")
        known = np.unique(feature[feature >= 0])
        known = known[np.lexsort((known // k, known % k))]
        rank = known % k * (int(known.max(initial=0)) // k + 1) + known // k  # ascending, as known is ordered
        own = feature % k * (int(known.max(initial=0)) // k + 1) + feature // k
        place = np.where(feature >= 0, np.searchsorted(rank, own), len(known)).astype(np.int32)
        cuts = np.searchsorted(known % k, np.arange(k + 1))
        data = cloudpickle.dumps([known // k, cuts, place, x, y])
        for i in range(0, len(data), PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([data[i : i + PIECE]], pa.binary())], ["packed"])

    return run


def _one(values: Iterator) -> Iterator[list]:
    """All of a partition as one element."""
    yield list(values)


def _routes(packed: RDD, k: int) -> RDD:
    """For each slice the places that each partition of rows needs, as one element (slice, {partition: places})."""

    def needs(p: int, values: Iterator) -> Iterator[tuple[int, tuple[int, np.ndarray]]]:
        for known, cuts, *_ in values:
            for v in range(k):
                if cuts[v] < cuts[v + 1]:
                    yield v, (p, known[cuts[v] : cuts[v + 1]].astype(np.int32))

    grouped = packed.mapPartitionsWithIndex(needs).partitionBy(k, int)
    return grouped.mapPartitionsWithIndex(lambda v, values: [(v, dict(value for _, value in values))])


def _to_slices(packed: RDD, k: int, results: RDD) -> RDD:
    """Sums by feature (last of a result) to the slices; the rest, which is small, to one of them."""

    def send(p: int, values: Iterator) -> Iterator[tuple[int, tuple]]:
        for small, sums, cuts in values:
            yield p % k, (p, None, small)
            for v in range(k):
                if cuts[v] < cuts[v + 1]:
                    yield v, (p, sums[cuts[v] : cuts[v + 1]], None)

    return results.mapPartitionsWithIndex(send).partitionBy(k, int).mapPartitions(_one)


def _added(size: int, routes: dict[int, np.ndarray], messages: list) -> tuple[np.ndarray, list]:
    total, small = np.zeros(size), []
    for p, sums, rest in sorted((m for _, m in messages), key=lambda m: (m[0], m[1] is None)):
        if sums is None:
            small.append(rest)
        else:
            total[routes[p]] += sums
    return total, small


class _Fit:
    """The slices of all vectors, and the objective over the packed rows."""

    def __init__(self, df: DataFrame, label: str, sizes: dict[str, int], widths: dict[str, int], nums: Sequence[str]) -> None:
        self.spark, self.context = df.sparkSession, df.sparkSession.sparkContext
        self.nums, self.slots = list(nums), sum(widths.values())
        stats = df.agg(
            F.count("*"), F.sum(named(label)),
            *[f(named(c).cast("double")) for c in nums for f in (F.avg, F.stddev_samp)],
        ).first()
        if not stats[0]:
            raise ValueError("no rows to fit")
        self.n, self.positive = stats[0], float(stats[1] or 0.0)
        if not 0 <= self.positive <= self.n:
            raise ValueError("labels must be 0 or 1")
        self.num_mean, self.num_sd = np.array(stats[2::2], float), np.array(stats[3::2], float)
        self.k = k = int(max(self.context.defaultParallelism, -(-self.n // PART_ROWS), -(-self.slots // SLICE_SLOTS)))
        starts = dict(zip(widths, np.cumsum([0, *widths.values()]).tolist(), strict=False))
        ids = [F.when(named(index_name(c)) < w, named(index_name(c)) + starts[c]).otherwise(-1).cast("long") for c, w in widths.items()]
        # rows of a seldom value of the column with most of them lie together; ranks go by frequency, so frequent ones come first
        most = max(widths, key=widths.get)
        at, spread = named(index_name(most)), F.xxhash64(*[named(c) for c in df.columns])
        part = F.pmod(F.when((at < 1 / HEAVY_SHARE) | (at >= sizes[most]), spread).otherwise(at.cast("long")), F.lit(k)).cast("int")
        rows = df.select(
            *[c.alias(f"i{j}") for j, c in enumerate(ids)], *[named(c).cast("double").alias(f"x{j}") for j, c in enumerate(nums)],
            named(label).cast("double").alias("y"), part.alias("part"),
        )
        rows = rows.repartitionById(k, "part").drop("part")
        packed = rows.mapInArrow(_pack(len(ids), len(self.nums), k), "packed binary").rdd
        self.packed = packed.mapPartitions(lambda rows: [cloudpickle.loads(b"".join(r[0] for r in rows))]).persist(StorageLevel.MEMORY_AND_DISK)
        self.routes = _routes(self.packed, k).persist(StorageLevel.MEMORY_AND_DISK)
        self.kept: list[RDD] = [self.packed, self.routes]
        self.written: list[str] = []

    def start(self) -> RDD:
        """Slices (slice, scale, centre, weights, gradient, steps, gradient steps) with all weights zero."""
        n, k, slots = self.n, self.k, self.slots

        def count(part):
            known, cuts, place, *_ = part
            return (), np.bincount(place.ravel(), minlength=len(known) + 1)[:-1].astype(float), cuts

        def made(pair):
            messages, (v, routes) = pair
            size = len(range(v, slots, k))
            counts, _ = _added(size, routes, messages)
            sd = np.sqrt(np.maximum(counts - counts * counts / n, 0.0) / max(n - 1, 1))
            scale = np.divide(1.0, sd, out=np.zeros(size), where=sd > 0)
            return v, scale, counts / n * scale, np.zeros(size), np.zeros(size), [], []

        return _to_slices(self.packed, k, self.packed.map(count)).zip(self.routes).map(made)

    def keep(self, state: RDD, cut: bool) -> RDD:
        """Store the slices; with ``cut`` in the scratch folder, so that they don't depend on all steps before."""
        if cut:
            path = scratch_path(self.spark, "slices")
            state.flatMap(_pieces).saveAsPickleFile(path, 1)
            self.written.append(path)
            pairs = self.context.pickleFile(path, self.k).map(lambda r: (r[0], r[1:])).partitionBy(self.k, int)
            state = pairs.mapPartitionsWithIndex(_joined)
        state = state.persist(StorageLevel.MEMORY_AND_DISK)
        self.kept.append(state)
        return state

    def drop(self, rdd: RDD) -> None:
        rdd.unpersist()
        self.kept.remove(rdd)

    def close(self) -> None:
        for rdd in list(self.kept):
            self.drop(rdd)
        for path in self.written:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def evaluate(self, state: RDD, mix: np.ndarray, t: float, numeric: np.ndarray, const: float):
        """Loss at the weights plus ``t`` times the mix of kept vectors, and the raw gradient's slices.

        Returns summed loss, numeric gradient, summed error, products of the gradient with the mix, and the slices.
        """
        k = self.k

        def send(pair):
            (v, scale, _, weights, *vectors), (_, routes) = pair
            found = (weights + t * _mixed(vectors, mix)) * scale
            return [(p, (v, found[places])) for p, places in routes.items()]

        def work(pair):
            messages, (known, cuts, place, x, y) = pair
            parts = [w for _, (_, w) in sorted(messages, key=lambda m: m[1][0])]
            found = np.concatenate([*parts, [0.0]])
            margin = numeric @ x + const
            for column in place:
                margin += found[column]
            small = np.exp(-np.abs(margin))
            error = np.where(margin >= 0, 1.0, small) / (1.0 + small) - y
            loss = float((np.maximum(margin, 0.0) + np.log1p(small) - y * margin).sum())
            sums = np.zeros(len(known) + 1)
            for column in place:
                sums += np.bincount(column, error, minlength=len(sums))
            return (loss, float(error.sum()), x @ error), sums[:-1], cuts

        def gathered(pair):
            (messages, (v, routes)), (_, scale, _, weights, *vectors) = pair
            total, small = _added(len(weights), routes, messages)
            total *= scale
            return total, small, float(total @ _mixed(vectors, mix))

        sent = state.zip(self.routes).flatMap(send).partitionBy(k, int).mapPartitions(_one)
        raw = _to_slices(self.packed, k, sent.zip(self.packed).map(work)).zip(self.routes).zip(state).map(gathered)
        raw = raw.persist(StorageLevel.MEMORY_AND_DISK)
        self.kept.append(raw)
        found = raw.map(lambda r: (r[1], r[2])).collect()
        small = [s for part, _ in found for s in part]
        return sum(s[0] for s in small), np.sum([s[2] for s in small], axis=0), sum(s[1] for s in small), sum(d for _, d in found), raw

    def moved(self, state: RDD, raw: RDD, mix: np.ndarray, t: float, error: float, first: bool) -> RDD:
        """The slices after a step, with the gradient there and what both moved by."""
        n = self.n

        def step(pair):
            (v, scale, centre, weights, gradient, steps, deltas), (total, *_) = pair
            by = t * _mixed((gradient, steps, deltas), mix)
            new = (total - error * centre) / n
            if first:
                return v, scale, centre, weights + by, new, [], []
            return v, scale, centre, weights + by, new, [by, *steps][:MEMORY], [new - gradient, *deltas][:MEMORY]

        return state.zip(raw).map(step)

    @staticmethod
    def products(state: RDD) -> np.ndarray:
        """All products of gradient, steps, gradient steps and centre, summed over the slices."""

        def gram(s):
            vectors = np.vstack([s[4], *s[5], *s[6], s[2]])
            return vectors @ vectors.T

        return np.sum(state.map(gram).collect(), axis=0)


def _pieces(s) -> list[tuple[int, int, int, bytes]]:
    """The vectors of a slice, in records of bounded length."""
    v, scale, centre, weights, gradient, steps, deltas = s
    vectors, n = [scale, centre, weights, gradient, *steps, *deltas], PIECE // 64  # written ten at a time
    return [(v, j, i, a[i : i + n].tobytes()) for j, a in enumerate(vectors) for i in range(0, max(len(a), 1), n)]


def _joined(v: int, values: Iterator) -> Iterator[tuple]:
    """The slice that ``_pieces`` took apart."""
    vectors: dict[int, list[bytes]] = {}
    for _, (j, _, data) in sorted(values, key=lambda r: r[1][:2]):
        vectors.setdefault(j, []).append(data)
    found = [np.frombuffer(b"".join(vectors[j])) for j in range(len(vectors))]
    h = (len(found) - 4) // 2
    yield v, *found[:4], found[4 : 4 + h], found[4 + h :]


def _mixed(vectors: Sequence, mix: np.ndarray) -> np.ndarray:
    gradient, steps, deltas = vectors
    out = mix[0] * gradient
    for a, v in zip(mix[1:], [*steps, *deltas], strict=True):
        out += a * v
    return out


def _direction(products: np.ndarray, h: int) -> np.ndarray:
    """The two loops of L-BFGS on products alone: the descent direction as a mix of gradient, steps and gradient steps."""
    mix = np.zeros(1 + 2 * h)
    mix[0] = 1.0
    steps, deltas = [1 + i for i in range(h)], [1 + h + i for i in range(h)]
    used, alphas = products[: 1 + 2 * h, : 1 + 2 * h], []
    for s, y in zip(steps, deltas, strict=True):
        alphas.append(float(used[s] @ mix) / used[s, y])
        mix[y] -= alphas[-1]
    if h:
        mix *= used[steps[0], deltas[0]] / used[deltas[0], deltas[0]]
    for s, y, alpha in reversed(list(zip(steps, deltas, alphas, strict=True))):
        mix[s] += alpha - float(used[y] @ mix) / used[s, y]
    return -mix


class SearchFailed(Exception):
    """No step along a direction meets the conditions."""


def wolfe_step(phi: Callable[[float], tuple[float, float]], start: tuple[float, float], t: float) -> float:
    """A step that meets the strong Wolfe conditions; ``phi`` gives value and slope, ``start`` those at zero."""
    value, slope = start
    if slope > 0:
        raise SearchFailed(f"no descent: {slope}")
    low = (0.0, value, slope)

    def between(a, b):
        (at, av, ad), (bt, bv, bd) = (a, b) if a[0] <= b[0] else (b, a)
        d1 = ad + bd - 3 * (av - bv) / (at - bt)
        d2 = np.sqrt(d1 * d1 - ad * bd)
        new = bt - (bt - at) * (bd + d2 - d1) / (bd - ad + 2 * d2)
        return min(max(new, at + 0.1 * (bt - at)), at + 0.9 * (bt - at))

    def zoom(low, high):
        for _ in range(10):
            t = between(low, high)
            now = (t, *phi(t))
            if now[1] > value + 1e-4 * t * slope or now[1] >= low[1]:
                high = now
                continue
            if abs(now[2]) <= 0.9 * abs(slope):
                return t
            if now[2] * (high[0] - low[0]) >= 0:
                high = low
            low = now
        raise SearchFailed("zoom")

    for i in range(10):
        now = (t, *phi(t))
        if not np.isfinite(now[1]):
            t /= 2
            continue
        if now[1] > value + 1e-4 * t * slope or (now[1] >= low[1] and i > 0):
            return zoom(low, now)
        if abs(now[2]) <= 0.9 * abs(slope):
            return t
        if now[2] >= 0:
            return zoom(now, low)
        low, t = now, t * 1.5
    raise SearchFailed("no bracket")


@dataclass
class SlicedModel:
    """A frequency index, a table of weights (``name``, ``index``, ``weight``, ``n``) by category, and the few other weights.

    ``unseen`` has those of null and unseen values, for the columns where they have one.
    """

    index: FrequencyIndex
    weights: DataFrame
    numeric: dict[str, float]
    unseen: dict[str, float]
    intercept: float
    threshold: float = 0.5

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with index columns, ``rawPrediction``, ``probability`` and ``prediction``; an index without a weight adds nothing."""
        columns, found = df.columns, self.index.transform(df)
        shown = found.columns
        margin = F.lit(float(self.intercept))
        for c, w in self.numeric.items():
            value = named(c).cast("double")
            fault = F.raise_error(F.lit(f"null or NaN in {c}: fill first")).cast("double")
            margin = margin + F.when(value.isNull() | F.isnan(value), fault).otherwise(value) * F.lit(float(w))
        for i, c in enumerate(self.index.tables):
            own = self.weights.where(F.col("name") == c).select(F.col("index").cast("string").alias(index_name(c)), "n", F.col("weight").alias(f"__weight{i}"))
            # unseen values share an index: as nulls they don't meet in one task
            seen = named(index_name(c)) < self.index.sizes[c]
            keyed = found.withColumn("__index", F.when(seen, named(index_name(c))))
            found = lookup(keyed, "__index", own.withColumnRenamed(index_name(c), "__index"), "n", self.index.rows, [f"__weight{i}"]).drop("__index")
            margin = margin + F.when(seen, F.coalesce(F.col(f"__weight{i}"), F.lit(0.0))).otherwise(F.lit(float(self.unseen.get(c, 0.0))))
        found = found.withColumn("__margin", margin).withColumn("__p", sigmoid(F.col("__margin")))
        return found.select(
            *[named(c) for c in columns], *[named(c) for c in shown if c not in columns],
            array_to_vector(F.array(-F.col("__margin"), F.col("__margin"))).alias("rawPrediction"),
            array_to_vector(F.array(1 - F.col("__p"), F.col("__p"))).alias("probability"),
            F.when(F.col("__p") > self.threshold, 1.0).otherwise(0.0).alias("prediction"),
        )

    def save(self, spark: SparkSession, path: str) -> None:
        self.index.save(spark, f"{path}/index")
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        row = (list(self.numeric), list(self.numeric.values()), list(self.unseen), list(self.unseen.values()), float(self.intercept), self.threshold)
        schema = "names array<string>, weights array<double>, unseen array<string>, others array<double>, intercept double, threshold double"
        spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/rest")

    @staticmethod
    def load(spark: SparkSession, path: str) -> SlicedModel:
        row = spark.read.parquet(f"{path}/rest").first()
        numeric, unseen = (dict(zip(row[a], row[b], strict=True)) for a, b in (("names", "weights"), ("unseen", "others")))
        weights = spark.read.parquet(f"{path}/weights")
        return SlicedModel(FrequencyIndex.load(spark, f"{path}/index"), weights, numeric, unseen, row["intercept"], row["threshold"])


def fit_sliced(
    train: DataFrame, label: str, index: FrequencyIndex, widths: dict[str, int], nums: Sequence[str],
    max_iter: int = 100, tol: float = 1e-6, threshold: float = 0.5,
) -> SlicedModel:
    """Fit without regularisation and with an intercept; ``widths`` has each indexed column's number of slots."""
    indexed = materialize(index.transform(train), "indexed")
    fit = _Fit(indexed, label, index.sizes, widths, nums)
    try:
        state, numeric, intercept = _optimise(fit, max_iter, tol)
        weights = _weights(fit, state, index, widths)
        others = [(c, weights.where((F.col("name") == c) & (F.col("index") == size)).first()) for c, size in index.sizes.items()]
        unseen = {c: row["weight"] for c, row in others if row}
        return SlicedModel(index, weights, dict(zip(nums, numeric.tolist(), strict=True)), unseen, intercept, threshold)
    finally:
        fit.close()
        forget(indexed)


def _optimise(fit: _Fit, max_iter: int, tol: float) -> tuple[RDD, np.ndarray, float]:
    """Slices of the fitted weights, the numerics' weights and the intercept, both for features as they come."""
    scale = np.divide(1.0, fit.num_sd, out=np.zeros(len(fit.nums)), where=fit.num_sd > 0)
    centre, q, n = fit.num_mean * scale, len(fit.nums), fit.n
    state = fit.keep(fit.start(), False)
    if fit.positive in (0.0, float(n)):
        return state, np.zeros(q), float("inf") if fit.positive else float("-inf")
    # the driver's own slice: numerics and intercept; at the start the intercept alone is set
    x, shift = np.zeros(q + 1), 0.0
    x[q] = np.log(fit.positive / (n - fit.positive))

    def evaluate(state, mix, t, x, shift):
        """``shift`` is the weights' product with all categories' centres."""
        const = x[q] - float(x[:q] @ centre) - shift
        loss, of_numeric, error, along, raw = fit.evaluate(state, mix, t, x[:q] * scale, const)
        return loss / n, np.append(of_numeric * scale - error * centre, error) / n, error, along / n, raw

    def settled(state, raw, mix, t, error, first, cut):
        new = fit.keep(fit.moved(state, raw, mix, t, error, first), cut)
        products = fit.products(new)
        fit.drop(state)
        fit.drop(raw)
        return new, products

    value, g, error, _, raw = evaluate(state, np.zeros(1), 0.0, x, 0.0)
    state, products = settled(state, raw, np.zeros(1), 0.0, error, True, False)
    steps, deltas, initial, values, failed = [], [], value, [float("inf")], False
    iteration = 0
    while True:
        own = np.array([g, *steps, *deltas])
        used = products[:-1, :-1] + own @ own.T
        if iteration >= max_iter or (len(values) >= 2 and abs(value - max(values)) <= tol * initial) or np.sqrt(used[0, 0]) <= max(tol * value, 1e-8):
            break
        mix = _direction(used, len(steps))
        ahead, ahead_shift = mix @ own, float(mix @ products[:-1, -1])
        length, slope = np.sqrt(mix @ used @ mix), float(mix @ used[0])
        tried: list = []

        def phi(t, state=state, mix=mix, ahead=ahead, ahead_shift=ahead_shift, tried=tried):
            if tried:
                fit.drop(tried.pop()[-1])
            value, g, error, along, raw = evaluate(state, mix, t, x + t * ahead, shift + t * ahead_shift)
            tried.append((value, g, error, raw))
            return value, along - error * ahead_shift / n + float(g @ ahead)

        try:
            t = wolfe_step(phi, (value, slope), 1.0 / length if iteration == 0 else 1.0)
            if t * np.sqrt(used[0, 0]) < 1e-10:
                raise SearchFailed("step too short")
        except SearchFailed:
            for *_, raw in tried:
                fit.drop(raw)
            if failed:
                break
            failed = True  # once more from the gradient alone
            state, products, steps, deltas = _forgetful(fit, state), products[[0, -1]][:, [0, -1]], [], []
            continue
        failed, iteration = False, iteration + 1
        new_value, new_g, error, raw = tried[0]
        state, products = settled(state, raw, mix, t, error, False, iteration % CUT == 0)
        steps, deltas = [t * ahead, *steps][:MEMORY], [new_g - g, *deltas][:MEMORY]
        x, shift, g, value = x + t * ahead, shift + t * ahead_shift, new_g, new_value
        values = [*values, value][-20:]
    return state, x[:q] * scale, float(x[q] - x[:q] @ centre - shift)


def _forgetful(fit: _Fit, state: RDD) -> RDD:
    new = fit.keep(state.map(lambda s: (*s[:5], [], [])), False)
    new.count()
    fit.drop(state)
    return new


def _weights(fit: _Fit, state: RDD, index: FrequencyIndex, widths: dict[str, int]) -> DataFrame:
    """The stored table of weights by column and index, with the number of rows that have it."""
    k, starts = fit.k, np.cumsum([0, *widths.values()])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for v, at, data in zip(*(batch[c].to_pylist() for c in ("v", "at", "weights")), strict=True):
                weight = np.frombuffer(data)
                feature = v + k * (at + np.arange(len(weight)))
                column = np.searchsorted(starts, feature, side="right") - 1
                found = [pa.array(column.astype(np.int32)), pa.array((feature - starts[column]).astype(float)), pa.array(weight)]
                yield pa.RecordBatch.from_arrays(found, ["column", "index", "weight"])

    def pieces(s):
        found = s[3] * s[1]
        return [(s[0], i, found[i : i + PIECE // 8].tobytes()) for i in range(0, len(found), PIECE // 8)]

    raw = fit.spark.createDataFrame(state.flatMap(pieces), "v int, at long, weights binary")
    raw = raw.mapInArrow(listed, "column int, index double, weight double")
    names = F.array(*[F.lit(c) for c in widths])
    raw = raw.select(names[F.col("column")].alias("name"), "index", "weight")
    counts = None
    for c, table in index.tables.items():
        own = table.select(F.lit(c).alias("name"), "index", "n")
        counts = own if counts is None else counts.unionByName(own)
    joined = raw.join(counts, ["name", "index"], "left").fillna(0, ["n"])
    return materialize(joined, "weights")
