"""The trie of all prefixes of conversations, with totals over its subtrees by tree contraction.

A turn becomes a digest, so that texts are read once and never shuffled. A prefix's key is the sum of
position-tagged digests of its turns: sums can be taken in slices of a conversation and added up, and a
parent's key is the sum without the last turn. One grouping by key gives the nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import heavy_light_join, materialize
from packetloom.llm.contraction import subtree_totals
from packetloom.session import forget

#: A conversation takes its first turns from the one whose id is the last multiple of this.
FAMILY = 100
#: Fewer than this many turns are taken over.
LEADS = 6
#: Turns whose sums are taken together.
SLICE = 4096
#: Ids that are joined to one piece of text before they are hashed.
IDS = 8192

NO_IDS = hashlib.sha256(b"").hexdigest()


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``digest`` (of role and text, null as empty), ``chars`` of the rows with an id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place``, their number (from 1) within ``group`` by ``order``, nulls first.

    Rows are dealt by ranges of group and order, so a group with a third of all rows lies in many ranges.
    Each range numbers its own, and a group's later ranges start where the earlier ones end; only groups
    cut by a border have such starts, at most one a range, and these are broadcast.
    """
    keys = [group, *order]
    spread = materialize(rows.repartitionByRange(*keys, F.xxhash64(F.monotonically_increasing_id())).withColumn("range", F.spark_partition_id()), "trie-ranges")
    sizes = spread.groupBy(group, "range").agg(F.count("*").alias("size"))
    before = Window.partitionBy(group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("start", F.sum("size").over(before)).where("start is not null").drop("size")
    local = F.row_number().over(Window.partitionBy(group, "range").orderBy(*order))
    made = spread.withColumn("local", local).join(F.broadcast(starts), [group, "range"], "left")
    return made.withColumn("place", F.col("local") + F.coalesce("start", F.lit(0))).drop("local", "start", "range")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (``conv_id``, ``place`` from 1, ``digest``, ``chars``, ``length``) and (``conv_id``, ``length``).

    Conversation c takes the first h = crc32(c) % 6 turns of c - c % 100 and then its own beyond the h-th.
    """
    turns = materialize(ranked(turn_rows(conversations), "conv_id", ["turn", "digest"]), "trie-turns")
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    convs = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % LEADS).withColumn("base", F.expr(f"conv_id - conv_id % {FAMILY}"))
    lead = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = convs.join(lead, "base", "left").withColumn("lead", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = materialize(convs.withColumn("length", F.col("lead") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).select("conv_id", "base", "own", "h", "lead", "length"), "trie-conversations")
    first = turns.where(f"place < {LEADS} and conv_id % {FAMILY} = 0").select(F.col("conv_id").alias("base"), "place", "digest", "chars")
    taken = first.join(convs.select("conv_id", "base", "lead", "length"), "base").where("place <= lead").select("conv_id", "place", "digest", "chars", "length")
    total = turns.count()
    own = heavy_light_join(turns, convs, "conv_id", "own", total, ["h", "lead", "length"]).where("place > h")
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("lead")).alias("place"), "digest", "chars", "length")
    return taken.union(own), convs.select("conv_id", "length")


def _halves(text: Column) -> list[Column]:
    """The two 64-bit halves of a hexadecimal md5 as decimals, whose sums stay exact for 10^18 turns."""
    return [F.conv(F.substring(text, at, 16), 16, 10).cast("decimal(20,0)") for at in (1, 17)]


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` with ``key`` and ``above``: the keys of the prefix that ends with the turn and of the one before it.

    Sums run in slices of ``SLICE`` turns; a slice starts from the sums of the slices before it, of which
    a conversation has one for every ``SLICE`` turns.
    """
    x, y = _halves(F.md5(F.concat_ws(":", F.col("place").cast("string"), "digest").cast("binary")))
    turns = materialize(turns.withColumn("x", x).withColumn("y", y).withColumn("slice", F.expr(f"(place - 1) div {SLICE}")), "trie-sums")
    whole = turns.where(f"length > {SLICE}").groupBy("conv_id", "slice").agg(F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select("conv_id", "slice", *(F.sum(s).over(before).cast("decimal(38,0)").alias(s) for s in ("sx", "sy"))).where("slice > 0")
    run = Window.partitionBy("conv_id", "slice").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    sums = turns.select("*", *(F.sum(s).over(run).cast("decimal(38,0)").alias(f"run_{s}") for s in "xy")).join(starts, ["conv_id", "slice"], "left")
    x, y = (F.col(f"run_{s}") + F.coalesce(f"s{s}", F.lit(0)) for s in "xy")
    key = lambda a, b: F.md5(F.concat_ws(":", a.cast("decimal(38,0)").cast("string"), b.cast("decimal(38,0)").cast("string")).cast("binary"))
    return sums.select("conv_id", "place", "chars", "length", key(x, y).alias("key"), F.when(F.col("place") > 1, key(x - F.col("x"), y - F.col("y"))).alias("above"))


def joined_digests(rows: DataFrame, group: str, number: str) -> DataFrame:
    """``group`` and ``digest``: SHA-256 of the group's distinct numbers in ascending order, joined by commas.

    SHA-256 has to read a group's text from front to back. Ranges of the sorted numbers are first joined
    to pieces of text, side by side; then one task reads a group's pieces in order and keeps only the
    state of the hash, so its memory doesn't grow with the group and it reads one row for each ``IDS``.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids = None, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["group", "first", "text"])

        for batch in batches:
            for k, i in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if ids and (k != key or len(ids) >= IDS):
                    yield made()
                    ids = []
                key = k
                ids.append(i)
        if ids:
            yield made()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = None
        for batch in batches:
            keys, found = [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if k == key:
                    state.update(b"," + text.encode())
                    continue
                if state is not None:
                    keys.append(key)
                    found.append(state.hexdigest())
                key, state = k, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(found, pa.string())], ["group", "digest"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], ["group", "digest"])

    rows = rows.select(F.col(group).alias("group"), F.col(number).alias("number"))
    parts = rows.repartitionByRange("group", "number").sortWithinPartitions("group", "number").mapInArrow(pieces, "group string, first long, text string")
    return parts.repartition("group").sortWithinPartitions("group", "first").mapInArrow(digests, "group string, digest string").withColumnRenamed("group", group)


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row a node of the trie of all rebuilt conversations, the textless root included.

    Columns: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (sum over the subtree of (members - 1) times the code
    points of a node's last text), ``ends_sha256``. Needs ``conv_id``, ``turn``, ``role``, ``text``; other
    columns aren't read. Rows without ``conv_id`` are no conversation's. A null role or text is empty, a
    null turn comes first, equal turns are ordered by a digest of role and text, and a repeated row is a
    turn of its own. An empty table has no nodes. A conversation whose turns are all replaced by those of
    a missing one ends in the root.
    """
    turns, convs = rebuilt(conversations)
    steps = materialize(prefixes(turns), "trie-prefixes")
    nodes = steps.groupBy("key", "above").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("place").alias("depth"), F.min("chars").alias("chars"))
    root = F.lit("root")
    nodes = nodes.select("key", F.coalesce("above", root).alias("above"), "n_convs", "conv_id", "depth", "chars")
    top = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    top = top.select(root.alias("key"), F.lit(None).cast("string").alias("above"), "n_convs", "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("chars"))
    nodes = materialize(nodes.union(top).withColumn("node", F.monotonically_increasing_id()), "trie-nodes")

    # a node's children are summed before they meet; their parent comes to them without a hot task
    counts = nodes.where("above is not null").groupBy(F.col("above").alias("key")).agg(F.count("*").alias("n_children"))
    parents = nodes.join(counts, "key").select(F.col("key").alias("above"), "n_children", F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    below = heavy_light_join(nodes, materialize(parents, "trie-parents"), "above", "n_children", nodes.count(), ["parent", "parent_conv_id"])
    nodes = materialize(below.join(counts, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie-tree")
    own = nodes.select("node", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    totals = subtree_totals(own, ["n_leaves", "saved_tokens"], "trie")

    ends = steps.where("place = length").select("key", "conv_id").union(convs.where("length = 0").select(root.alias("key"), "conv_id"))
    digests = joined_digests(ends, "key", "conv_id").withColumnRenamed("digest", "ends_sha256")
    made = nodes.join(totals, "node").join(digests, "key", "left")
    return made.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"))
