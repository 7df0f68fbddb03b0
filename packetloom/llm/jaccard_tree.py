"""Similarity join on word shingles with signature trees.

A document's set is its distinct 5-word shingles as 64-bit hashes. Equal sets are one class. Sets of
different classes can only reach the threshold if they share one of their smallest hashes (the prefix),
so blocks of sets that share a prefix hash hold every link. Inside a block a signature tree is traversed
against itself: nodes hold the OR of their members' bitmaps and the range of their sizes, and a pair of
nodes is dropped when even its largest possible overlap is too small.

Two steps keep large groups of near copies linear. First every set goes to the block of its smallest
hash under a few orders, where found links merge sets at once and pairs already joined are passed over.
Then all prefix blocks that still hold two components are searched for the links between components.
"""

from __future__ import annotations

from base64 import b64encode
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import WordHashes, blocks, heavy_light_join, map_blocks, materialize, mixed, pack, run_starts, unpack, windows
from packetloom.llm.components import connected_components
from packetloom.session import forget

#: Words in a shingle; similarity in hundredths.
WIDTH, PERCENT = 5, 80
#: Orders under which sets meet in the first step.
ORDERS = 2
#: Hashes in a block of the first step, members in a block of the second; larger blocks are cut.
BLOCK_HASHES, BLOCK_MEMBERS = 400_000, 4_000
#: Buckets that hashes share, for each partition; blocks have twice as many.
BUCKETS = 4
#: A set's prefix holds one in so many of its hashes beyond the short one, to tell sets that share only a passage.
SPARE = 10
#: Prefix hashes that a task packs at once, low bytes of a hash that blocks go by: equal ones of different hashes only make more candidates.
PACKED_HASHES, HASH_BYTES = 300_000, 5
#: Members of a leaf, children of a node.
LEAF, FANOUT = 16, 8
#: Ids up to which a semi join with the documents is a broadcast.
FEW_IDS = 200_000

_SALT = np.uint64(0xA24BAED4963EE407)


def shingles(text: bytes, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; with fewer words the one of all words; empty without words."""
    words = hashes.of(text.lower().split())
    if not len(words):
        return np.empty(0, np.uint64)
    if len(words) < WIDTH:
        return mixed(windows(words, len(words)) + np.uint64(len(words)))
    return np.unique(windows(words, WIDTH))


def needed(a: int | np.ndarray, b: int | np.ndarray) -> np.ndarray:
    """Least overlap of linked sets of these sizes: 100 i >= PERCENT (a + b - i)."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def bitmap(ordered: np.ndarray) -> bytes:
    """The set's bits: a power of two of them, at least four a hash up to 2^16."""
    width = 1 << min(16, max(6, int(4 * len(ordered) - 1).bit_length()))
    bits = np.zeros(width, np.uint8)
    bits[(ordered & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def short_prefix(n: int | np.ndarray) -> int | np.ndarray:
    """Smallest hashes of which linked sets share one. With ``k`` more they share ``k + 1``."""
    return n + PERCENT * -n // 100 + 1


def sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``n`` (set size), ``print`` (the set's 128-bit hash; null if empty), ``least`` (smallest hash
    under each order), ``prefix`` (``HASH_BYTES`` a hash, smallest hash first) and ``bits`` of each document."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(block: pa.RecordBatch) -> dict:
        hashes, made = WordHashes(), []
        for x in block.column("text").to_pylist():
            own = shingles(x or b"", hashes)
            n = len(own)
            if not n:
                made.append((0, None, [], b"", b""))
                continue
            prefix = own[: short_prefix(n) + n // SPARE].view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES]
            least = [int(mixed(own ^ _SALT * np.uint64(k)).min().astype(np.int64)) for k in range(ORDERS)]
            made.append((n, b64encode(xxhash.xxh3_128_digest(own.tobytes())).decode().rstrip("="), least, prefix.tobytes(), bitmap(own)))
        return {"doc_id": block.column("doc_id")} | dict(zip(("n", "print", "least", "prefix", "bits"), map(list, zip(*made, strict=True)), strict=True))

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return map_blocks(rows, "text", f"doc_id {kind}, n long, print string, least array<long>, prefix binary, bits binary", work)


def sets_of(docs: DataFrame, ids: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, ``set`` (the hashes as bytes) of the documents in ``ids`` (one row an id), and its other columns.

    A few ids are broadcast, many joined by shuffle.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    few = ids.count() <= FEW_IDS
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    rows = rows.join(F.broadcast(ids) if few else ids, "doc_id")
    others = [(c, t) for c, t in ids.dtypes if c != "doc_id"]

    def work(block: pa.RecordBatch) -> dict:
        hashes = WordHashes()
        made = {"doc_id": block.column("doc_id"), "set": [shingles(x or b"", hashes).tobytes() for x in block.column("text").to_pylist()]}
        return made | {c: block.column(c) for c, _ in others}

    return map_blocks(rows, "text", ", ".join([f"doc_id {kind}, set binary", *(f"{c} {t}" for c, t in others)]), work)


class Tree:
    """A signature tree over sets, in levels from the leaves up."""

    def __init__(self, bits: list[bytes], sizes: np.ndarray, group: np.ndarray) -> None:
        width = min(map(len, bits))
        matrix = np.empty((len(bits), width // 8), np.uint64)
        for i, b in enumerate(bits):  # longer bitmaps are folded onto the shortest
            matrix[i] = np.bitwise_or.reduce(np.frombuffer(b, np.uint64).reshape(-1, width // 8), axis=0)
        self.order = np.lexsort((matrix[:, 0], sizes, group))
        matrix, sizes, group = matrix[self.order], sizes[self.order], group[self.order]
        counts = np.bitwise_count(matrix).sum(axis=1).astype(np.int64)
        #: bits, least and most size, least bit count, least and most group of each node; level 0 are the sets
        self.levels = [(matrix, sizes, sizes, counts, group, group)]
        step = LEAF
        while len(self.levels[-1][0]) > 1:
            m, low, high, count, g0, g1 = self.levels[-1]
            at = np.arange(0, len(m), step)
            self.levels.append((np.bitwise_or.reduceat(m, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.minimum.reduceat(count, at), np.minimum.reduceat(g0, at), np.maximum.reduceat(g1, at)))
            step = FANOUT

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which node pairs can hold a link between groups, and the bits they share.

        A set of n hashes linked with one of k lacks at most n - needed(n, k) of them, so its bitmap has at
        most as many bits outside the other's. For nodes: the largest n, the smallest k, the smallest
        bitmap, and the bits that both ORs have.
        """
        m, low, high, count, g0, g1 = self.levels[level]
        shared = np.bitwise_count(m[a] & m[b]).sum(axis=1).astype(np.int64)
        fits = (count[a] - shared <= high[a] - needed(high[a], low[b])) & (count[b] - shared <= high[b] - needed(high[b], low[a]))
        fits &= (100 * high[a] >= PERCENT * low[b]) & (100 * high[b] >= PERCENT * low[a])
        return fits & ~((g0[a] == g1[a]) & (g0[b] == g1[b]) & (g0[a] == g0[b])), shared

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Index pairs of sets that may link, with their shared bits; node pairs are taken from a stack in slices."""
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        most = max(1_000, 2_000_000 // self.levels[0][0].shape[1])
        while stack:
            level, a, b = stack.pop()
            if len(a) > most:
                stack.append((level, a[most:], b[most:]))
                a, b = a[:most], b[:most]
            fits, shared = self._possible(level, a, b)
            if level == 0:
                fits &= a < b
                if fits.any():
                    yield self.order[a[fits]], self.order[b[fits]], shared[fits]
                continue
            a, b = a[fits], b[fits]
            step, below = (LEAF if level == 1 else FANOUT), len(self.levels[level - 1][0])
            part = max(1, most // (step * step))
            for i in range(0, len(a), part):
                x = (a[i : i + part, None, None] * step + np.arange(step)[None, :, None] + np.zeros((1, 1, step), np.int64)).ravel()
                y = (b[i : i + part, None, None] * step + np.arange(step)[None, None, :] + np.zeros((1, step, 1), np.int64)).ravel()
                ok = (x < below) & (y < below) & (x <= y)
                if ok.any():
                    stack.append((level - 1, x[ok], y[ok]))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum()) >= int(needed(len(a), len(b)))


def merged(sets: list[np.ndarray]) -> np.ndarray:
    """The component of each set, as the least index in it, by tree pairs checked exactly; the likeliest pairs come first."""
    root = np.arange(len(sets))
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    if len(sets) == 2:
        return np.zeros(2, np.int64) if linked(*sets) else root
    for a, b, shared in Tree([bitmap(x) for x in sets], sizes, root).pairs():
        at = np.argsort(shared / (sizes[a] + sizes[b]))[::-1]
        a, b, step = a[at], b[at], 64
        while len(a):
            open_ = root[a] != root[b]
            a, b = a[open_], b[open_]
            for i, j in zip(a[:step].tolist(), b[:step].tolist(), strict=True):
                if root[i] != root[j] and linked(sets[i], sets[j]):
                    low, high = sorted((root[i], root[j]))
                    root[root == high] = low
            a, b = a[step:], b[step:]
    return root


def _first_links(table: pa.Table) -> pa.Table:
    """Of one block: each set that isn't its component's first, with that first one."""
    ids, sets = table.column("doc_id").to_numpy(), [np.frombuffer(x, np.uint64) for x in table.column("set").to_pylist()]
    root = merged(sets)
    at = np.flatnonzero(root != np.arange(len(root)))
    return pa.table({"a": pa.array(ids[at], table.schema.field("doc_id").type), "b": pa.array(ids[root[at]], table.schema.field("doc_id").type)})


def _may_link(bits: list[bytes], n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The tree's bound for single pairs, taken together by the widths of their bitmaps."""
    size = np.fromiter(map(len, bits), np.int64, len(bits))
    out = np.zeros(len(a), bool)
    for x in np.unique(size):
        for y in np.unique(size):
            at = np.flatnonzero((size[a] == x) & (size[b] == y))
            if not len(at):
                continue
            own, rows = [], []
            for side, width in ((a[at], x), (b[at], y)):
                found, where = np.unique(side, return_inverse=True)
                m = np.frombuffer(b"".join(bits[i] for i in found), np.uint64).reshape(len(found), -1, min(x, y) // 8)
                own.append(np.bitwise_or.reduce(m, axis=1))
                rows.append(where)
            count = [np.bitwise_count(m).sum(axis=1).astype(np.int64)[r] for m, r in zip(own, rows, strict=True)]
            shared = np.bitwise_count(own[0][rows[0]] & own[1][rows[1]]).sum(axis=1).astype(np.int64)
            spare = [n[s[at]] - needed(n[a[at]], n[b[at]]) for s in (a, b)]
            out[at] = (count[0] - shared <= spare[0]) & (count[1] - shared <= spare[1])
    return out


def _near_pairs(table: pa.Table) -> pa.Table:
    """Of a bucket of small blocks: the pairs of different components that meet in one, with sizes within reach."""
    block, ids, n, group = (table.column(c).to_numpy() for c in ("hash", "doc_id", "n", "component"))
    order = np.argsort(block, kind="stable")
    most = np.diff(np.append(np.flatnonzero(run_starts(block[order])), len(order))).max()  # an id has a row for each of its texts
    found = [np.empty((2, 0), ids.dtype)]
    for step in range(1, most):
        a, b = order[:-step], order[step:]
        fits = (block[a] == block[b]) & (group[a] != group[b]) & (100 * n[a] >= PERCENT * n[b]) & (100 * n[b] >= PERCENT * n[a])
        a, b = ids[a[fits]], ids[b[fits]]
        found.append(np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1))
    pairs = np.unique(np.concatenate(found, axis=1), axis=1)
    kind = table.schema.field("doc_id").type
    return pa.table({"a": pa.array(pairs[0], kind), "b": pa.array(pairs[1], kind)})


def _not_ruled_out(pairs: DataFrame, several: DataFrame) -> DataFrame:
    """The pairs that a text of each may link by the tree's bound; bitmaps come once a pair, however many hashes it shares."""
    side = lambda i, n, bits: several.select(F.col("doc_id").alias(i), F.col("n").alias(n), F.col("bits").alias(bits))
    rows = pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b").select("a", "b", "n", "m", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "x"):
            bits = batch.column("x").to_pylist() + batch.column("y").to_pylist()
            at = np.arange(len(batch))
            ok = _may_link(bits, np.concatenate([batch.column("n").to_numpy(), batch.column("m").to_numpy()]), at, at + len(batch))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(run, pairs.schema)


def _candidates(table: pa.Table) -> pa.Table:
    """Of a bucket of blocks: pairs of different components that can't be ruled out.

    Bands and cells of a leaf's size are compared inside at once; larger ones get a tree. Visitors aren't
    paired among themselves, nor members of one part in a block of two parts.
    """
    block, ids, n, group, own, part = (table.column(c).to_numpy() for c in ("block", "doc_id", "n", "component", "own", "part"))
    bits = table.column("bits").to_pylist()
    order = np.argsort(block, kind="stable")
    starts = np.flatnonzero(run_starts(block[order]))
    sizes = np.diff(np.append(starts, len(order)))
    found = []
    small = order[np.repeat(sizes <= LEAF, sizes)]
    for step in range(1, min(LEAF, len(small))):
        a, b = small[:-step], small[step:]
        fits = (block[a] == block[b]) & (group[a] != group[b]) & (own[a] | own[b])
        fits &= (100 * n[a] >= PERCENT * n[b]) & (100 * n[b] >= PERCENT * n[a])
        found.append((a[fits], b[fits]))
    if found:
        a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        pair = np.unique(np.stack([np.maximum(ids[a], ids[b]), np.minimum(ids[a], ids[b]), a, b]), axis=1) if len(a) else np.empty((4, 0), np.int64)
        pair = pair[:, np.append(True, (pair[:2, 1:] != pair[:2, :-1]).any(axis=0))[: pair.shape[1]]]
        ok = _may_link(bits, n, pair[2], pair[3])
        found = [(pair[2][ok], pair[3][ok])]
    for start, size in zip(starts[sizes > LEAF].tolist(), sizes[sizes > LEAF].tolist(), strict=True):
        at = order[start : start + size]
        alone = part[at].min() == part[at].max()
        for x, y, _ in Tree([bits[i] for i in at], n[at], group[at]).pairs():
            x, y = at[x], at[y]
            k = (own[x] | own[y]) & (alone | (part[x] != part[y]))
            found.append((x[k], y[k]))
    a, b = (np.concatenate([ids[f[i]] for f in found]) if found else np.empty(0, ids.dtype) for i in (0, 1))
    kind = table.schema.field("doc_id").type
    pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
    return pa.table({"a": pa.array(pairs[0], kind), "b": pa.array(pairs[1], kind)})


def _slices(batches: Iterable[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``most`` hashes each, so that memory is bounded by a slice."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False) // HASH_BYTES
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(batch)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j > i:
                yield batch.slice(i, j - i)


def _packed_prefixes(reps: DataFrame, n_buckets: int) -> DataFrame:
    """Prefix hashes with id and component, packed by bucket of hashes, which is the hash's remainder; ``hashes`` are the quotients."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, "prefix", PACKED_HASHES):
            lists = batch.column("prefix")
            sizes = pc.fill_null(pc.binary_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64) // HASH_BYTES
            if not sizes.sum():
                continue
            hashes = np.zeros((sizes.sum(), 8), np.uint8)
            hashes[:, :HASH_BYTES] = np.frombuffer(b"".join(x or b"" for x in lists.to_pylist()), np.uint8).reshape(-1, HASH_BYTES)
            hashes, bucket = np.divmod(hashes.view(np.int64).ravel(), n_buckets)
            ids, components, n = (np.repeat(batch.column(c).to_numpy().astype(np.int64), sizes) for c in ("doc_id", "component", "n"))
            place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            n = 2 * n + (place < short_prefix(n))
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
            rows = [(k, *(pack(np.ascontiguousarray(x[order[i:j]])) for x in (hashes, ids, ids - components, n))) for k, (i, j) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if j > i]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32() if i == 0 else pa.binary()) for i, x in enumerate(zip(*rows, strict=True))], ["bucket", "hashes", "ids", "above", "n"])

    return reps.select("doc_id", "component", "n", "prefix").mapInArrow(run, "bucket int, hashes binary, ids binary, above binary, n binary")


def _shared_prefixes(kind: str, n_buckets: int):
    """Of a bucket: the members of each hash that have one of another component and a size within reach, with their number."""

    def run(table: pa.Table) -> pa.Table:
        hashes, ids, above, n = (np.concatenate([unpack(x, np.int64) for x in table.column(c).to_pylist()]) for c in ("hashes", "ids", "above", "n"))
        hashes = hashes * n_buckets + table.column("bucket")[0].as_py()
        order = np.lexsort((n, hashes))
        ids, short, n, component = ids[order], n[order] % 2 == 1, n[order] // 2, (ids - above)[order]
        block = np.cumsum(run_starts(hashes[order])) - 1
        place = block * (int(n.max()) * 2 + 2)  # blocks apart, sizes in order
        low = np.searchsorted(place + n, place - (-PERCENT * n // 100))
        high = np.searchsorted(place + n, place + 100 * n // PERCENT, "right")
        changes = np.append(0, np.cumsum(component[1:] != component[:-1]))
        at = np.flatnonzero(changes[high - 1] != changes[low])
        count = np.bincount(block[at[short[at]]], minlength=block[-1] + 1 if len(block) else 0)
        return pa.table({"hash": hashes[order][at], "doc_id": pa.array(ids[at], pa.int64()).cast({"int": pa.int32()}.get(kind, pa.int64())), "members": count[block[at]], "short": short[at]})

    return run


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets link."""
    rows = pairs.join(sets.withColumnsRenamed({"doc_id": "a", "set": "x"}), "a").join(sets.withColumnsRenamed({"doc_id": "b", "set": "y"}), "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(run, pairs.schema)


def set_classes(sketch: DataFrame) -> DataFrame:
    """A row per set: ``print``, ``rep`` (its smallest document id), ``copies``, ``n``."""
    return sketch.where("print is not null and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min("n").alias("n"))


def similarity_links(docs: DataFrame, sketch: DataFrame, classes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Links (``a``, ``b``) between class representatives that join up each component of all links."""
    kind = docs.schema[doc_id].dataType.simpleString()
    is_rep = classes.select("print", F.col("rep").alias("doc_id"))
    # step one: blocks of one smallest hash
    meet = sketch.select("doc_id", "print", "n", "least").join(is_rep, ["print", "doc_id"]).select("doc_id", "n", F.posexplode("least").alias("k", "hash"))
    meet = least = materialize(meet, "jaccard-least")
    keys = meet.groupBy("k", "hash").agg(F.count("*").alias("members"), F.sum("n").alias("hashes")).where("members > 1").drop("members")
    part = F.expr(f"pmod(xxhash64(doc_id), ceil(hashes / {BLOCK_HASHES}))")
    meet = meet.join(keys, ["k", "hash"]).select("doc_id", F.xxhash64("k", "hash", part).alias("block"))
    meet = materialize(meet.groupBy("doc_id").agg(F.collect_set("block").alias("blocks")), "jaccard-meet")
    # a set is made where its text is read and goes to its blocks at once
    sets = sets_of(docs, meet, doc_id, text).withColumn("block", F.explode("blocks")).select("block", "doc_id", "set")
    first = materialize(sets.groupBy("block").applyInArrow(_first_links, f"a {kind}, b {kind}"), "jaccard-first")
    forget(least, meet)
    roots = connected_components(first, "jaccard-first")
    # step two: all prefix blocks that hold two components
    # an id and a 64-bit mark name a row's set; the table that goes to the sketches holds numbers alone
    mark = F.xxhash64("print").alias("mark")
    rooted = classes.select(F.col("rep").alias("doc_id"), mark, "n").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    rooted = materialize(rooted, "jaccard-rooted")
    reps = sketch.select("doc_id", mark, "n", "prefix").join(rooted.drop("n"), ["mark", "doc_id"]).drop("mark")
    n_buckets = BUCKETS * max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    shared = _packed_prefixes(reps, n_buckets).groupBy("bucket").applyInArrow(_shared_prefixes(kind, n_buckets), f"hash long, doc_id {kind}, members long, short boolean")
    shared = materialize(shared, "jaccard-shared")
    # a set that links shares n // SPARE + 1 hashes of its prefix with the other, or as many as that one's smaller prefix has to spare
    several = shared.groupBy("doc_id").agg(F.count("*").alias("hits")).join(rooted, "doc_id")
    several = several.where(F.col("hits") > F.floor(F.ceil(F.col("n") * PERCENT / 100) / SPARE)).drop("hits")
    # bitmaps are read for these sets alone, and each once
    several = materialize(sketch.select("doc_id", mark, "bits").join(several.dropDuplicates(["doc_id", "mark"]), ["doc_id", "mark"]), "jaccard-several")
    # in a block of a leaf's size ids alone pair up; a larger one gets the bitmaps
    few = shared.where(F.col("short") & (F.col("members") <= LEAF)).select("hash", "doc_id").join(several.select("doc_id", "n", "component"), "doc_id")
    few = few.groupBy(F.pmod("hash", F.lit(2 * n_buckets)).alias("bucket")).applyInArrow(_near_pairs, f"a {kind}, b {kind}")
    few = _not_ruled_out(materialize(few.distinct(), "jaccard-near"), several)
    member = shared.where(F.col("short") & (F.col("members") > LEAF)).drop("short").join(several.drop("mark"), "doc_id")
    # links need sizes within a factor of 1.25: in a block of many, a band of sizes meets itself and the next
    band = F.floor(F.log("n") / F.log(F.lit(100 / PERCENT)) + 1e-9).cast("int")
    at = F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band - 1).alias("band"), F.lit(False).alias("own")))
    # a block with too many members is cut into parts, and each pair of parts is a block
    parts = F.ceil(F.col("members") / BLOCK_MEMBERS).cast("int")
    part = F.pmod(F.xxhash64("doc_id"), parts).cast("int")
    cells = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(F.least(i, part).alias("i"), F.greatest(i, part).alias("j")))
    member = member.withColumn("part", part).withColumn("at", F.explode(at)).withColumn("cell", F.explode(cells))
    member = member.select("doc_id", "n", "component", "bits", "part", "at.own", F.xxhash64("hash", "at.band", "cell.i", "cell.j").alias("block"))
    large = member.groupBy(F.pmod("block", F.lit(2 * n_buckets)).alias("bucket"))
    pairs = materialize(large.applyInArrow(_candidates, f"a {kind}, b {kind}").union(few).distinct(), "jaccard-pairs")
    forget(shared, several, rooted)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    more = materialize(sets_of(docs, ids, doc_id, text), "jaccard-more-sets")
    return first.union(_checked(pairs, more))


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``doc_id``, ``n_shingles``, ``component_id`` (the smallest id reachable by links).

    Null and texts without words have no shingles and are linked with nothing. Repeated ids are one
    document with several texts, each row keeping its own size. A row without id links with nothing and has
    a null component. Other columns are not read; an empty table gives none.
    """
    sketch = materialize(sketches(docs, doc_id, text), "jaccard-sketch")
    classes = materialize(set_classes(sketch), "jaccard-classes")
    links = similarity_links(docs, sketch, classes, doc_id, text)
    same = sketch.where("print is not null").groupBy("doc_id").agg(F.min("print").alias("x"), F.max("print").alias("y")).where("x <> y and doc_id is not null")
    same = sketch.select("doc_id", "print").join(same.select("doc_id"), "doc_id").join(classes, "print").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = connected_components(links.union(same), "jaccard")
    classes = classes.join(found, F.col("rep") == F.col("node"), "left").select("print", "copies", F.coalesce("component", "rep").alias("component_id"))
    rows = heavy_light_join(sketch.select("doc_id", "n", "print"), classes, "print", "copies", sketch.count(), ["component_id"])
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the document with the smallest id stays.

    Of rows that repeat an id one stays, the first by text; rows without id and texts without words all
    stay. All columns stay. Ids to drop are broadcast if they are few, else joined by shuffle.
    """
    found = jaccard_components(docs, doc_id, text)
    drop = materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias(doc_id)).distinct(), "jaccard-drop")
    left = docs.join(F.broadcast(drop) if drop.count() <= FEW_IDS else drop, doc_id, "left_anti")
    again = materialize(docs.where(F.col(doc_id).isNotNull()).groupBy(doc_id).count().where("count > 1").select(doc_id), "jaccard-again")
    n = again.count()
    if not n:
        return left.select(*docs.columns)
    again = F.broadcast(again) if n <= FEW_IDS else again
    first = Window.partitionBy(doc_id).orderBy(text, *(c for c in docs.columns if c not in (doc_id, text)))
    once = left.join(again, doc_id, "left_semi").withColumn("__first", F.row_number().over(first)).where("__first = 1")
    return left.join(again, doc_id, "left_anti").select(*docs.columns).union(once.select(*docs.columns))
