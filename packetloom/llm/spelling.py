"""Spelling variants: words one code point apart, found through pairs of trie nodes.

The words are the sorted leaves of a forward trie, the reversed words those of a second one. Every node
has a number, so the pair (node of the part before a place, node of the part after it) names a word with
that place skipped, or a place between two code points, by two integers. Words that share a pair with the
same place skipped differ by one replaced code point; a skipped place that meets another word's gap is an
inserted or deleted one. Both are joins on equal integers and give exact neighbours.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import blocks, heavy_light_join, materialize, run_starts
from packetloom.session import forget

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One in so many runs of a document loses a code point.
DROP = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A word's form is at least so many times as frequent.
FORM_RATIO = 2
#: Distinct words that a task holds before it passes on their counts.
HELD = 300_000
#: Numbers of one range of sorted words lie this far from the next one's.
RANGE_BITS = 44


def words_of(doc_id: object, text: bytes) -> Iterator[tuple[str, int]]:
    """The words of a document with their counts; a null id counts as empty."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run, n in Counter(RUN.findall(text.lower().decode("utf-8", "replace"))).items():  # bytes have only A-Z to lower
        h = zlib.crc32(run.encode(), start)
        if h % DROP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= LEAST_LENGTH:
            yield run, n


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word``, ``n`` of all words that occur often enough; counts are summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        made = lambda: pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
        for block in blocks(batches, "text"):
            for i, x in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist(), strict=True):
                for word, n in words_of(i, x or b""):
                    counts[word] += n
                if len(counts) >= HELD:
                    yield made()
                    counts.clear()
        if counts:
            yield made()

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(f"n >= {LEAST_COUNT}")


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(i for i in range(n) if a[i] != b[i])


def border_nodes(ends: list[tuple[int, str, str]]) -> dict[int, tuple[list[int], list[int]]]:
    """For each range (number, first word, last word): the numbers of the nodes that it shares with the range
    before and with the one after, by depth. A node that lies in several ranges has one number, below zero."""
    shared: list[list[int]] = [[]]
    before, nodes, last = "", [], 0
    for (_, _, end), (_, start, _) in zip(ends, ends[1:], strict=False):
        both = start[: _common(end, start)]
        nodes = nodes[: _common(before, both) + 1] if nodes else []
        while len(nodes) <= len(both):
            last -= 1
            nodes.append(last)
        shared.append(list(nodes))
        before = both
    shared.append([])
    return {r: (shared[i], shared[i + 1]) for i, (r, _, _) in enumerate(ends)}


def trie_paths(words: DataFrame, word: str, keep: list[str]) -> DataFrame:
    """``keep``, ``order`` (a number that ascends with the word) and ``path``: the numbers of the word's trie
    nodes from the root on.

    Words are sorted in ranges. A range numbers the nodes that begin in it one after the other, by comparing
    each word with the one before; a stack holds the numbers along the current word. The nodes on the path
    to a border between ranges belong to both sides and are numbered beforehand from the ranges' first and
    last words, two words a range, which are all that the driver sees.
    """
    spread = materialize(words.select(F.col(word).alias("__word"), *keep).repartitionByRange("__word").withColumn("__range", F.spark_partition_id()), "spelling-ranges")
    ends = sorted(tuple(r) for r in spread.groupBy("__range").agg(F.min("__word"), F.max("__word")).collect())
    borders, last_of = border_nodes(ends), {r: last for r, _, last in ends}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, before, stack, made, seen = None, "", [], 0, 0
        for batch in batches:
            paths, orders = [], []
            for r, x in zip(batch.column("__range").to_pylist(), batch.column("__word").to_pylist(), strict=True):
                if r != own:
                    own, before, made, seen = r, x, 0, 0
                    left, right = borders[r]
                    stack = list(left)
                del stack[min(_common(before, x) + 1, len(stack)) :]
                to_end = _common(x, last_of[r])
                while len(stack) <= len(x):
                    depth = len(stack)
                    if depth <= to_end and depth < len(right):
                        stack.append(right[depth])
                    else:
                        stack.append((r << RANGE_BITS) + made)
                        made += 1
                paths.append(list(stack))
                orders.append((r << RANGE_BITS) + seen)
                seen, before = seen + 1, x
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), pa.array(orders, pa.int64()), pa.array(paths, pa.list_(pa.int64()))], [*keep, "order", "path"])

    kinds = {f.name: f.dataType.simpleString() for f in spread.schema}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keep), "order long", "path array<long>"])
    return spread.repartition("__range").sortWithinPartitions("__range", "__word").mapInArrow(run, schema)


def _node_pairs(rows: DataFrame) -> DataFrame:
    """``p``, ``q``, ``id``, ``n``, ``kind``: the pairs of each word for every gap (kind 0) and every skipped place
    (2 for the first of equal neighbours, else 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            front, back = batch.column("front"), batch.column("back")
            size = np.diff(front.offsets.to_numpy())
            p, q = front.flatten().to_numpy(), back.flatten().to_numpy()
            ids, n = (np.repeat(batch.column(c).to_numpy(), size) for c in ("id", "n"))
            begin = np.repeat(np.cumsum(size) - size, size)
            place = np.arange(len(p)) - begin
            mirror = begin + np.repeat(size, size) - 1 - place  # the suffix after the gap
            code = np.concatenate([np.append(np.frombuffer(w.encode("utf-32-le"), np.uint32), 0) for w in batch.column("word").to_pylist()])
            first = np.append(True, code[1:] != code[:-1]) | (place == 0)
            inside = place < np.repeat(size, size) - 1
            columns = (
                np.concatenate([p, p[inside]]),
                np.concatenate([q[mirror], q[mirror[inside] - 1]]),
                np.concatenate([ids, ids[inside]]),
                np.concatenate([n, n[inside]]),
                np.concatenate([np.zeros(len(p), np.int8), 1 + first[inside].astype(np.int8)]),
            )
            for at in range(0, len(columns[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], ["p", "q", "id", "n", "kind"])

    return rows.select("id", "n", "word", "front", "back").mapInArrow(run, "p long, q long, id long, n long, kind byte")


def _group_nears(p: np.ndarray, q: np.ndarray, ids: np.ndarray, n: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of rows sorted by pair: ``id``, the near words in its group, and the best one's ``n`` and ``id``."""
    group = np.cumsum(run_starts(p) | run_starts(q)) - 1
    several = np.bincount(group)[group] > 1
    group, ids, n, kind = group[several], ids[several], n[several], kind[several]
    if not len(group):
        return (np.empty(0, np.int64),) * 4
    order = np.lexsort((ids, -n, kind == 0, group))
    group, ids, n, kind = np.cumsum(run_starts(group[order])) - 1, ids[order], n[order], kind[order]
    start = np.flatnonzero(run_starts(group))
    skips, firsts = (np.bincount(group[at], minlength=len(start)) for at in (kind > 0, kind == 2))
    gap, longer = np.full(len(start), -1), np.full(len(start), -1)
    gap[group[kind == 0]] = np.flatnonzero(kind == 0)
    at = np.flatnonzero(kind == 2)[::-1]
    longer[group[at]] = at  # the last to be written is the group's best
    place = np.arange(len(group))
    is_gap, meets = kind == 0, (kind == 2) & (gap[group] >= 0)
    near = np.where(is_gap, firsts[group], skips[group] - 1 + meets)
    best = np.where(place == start[group], np.minimum(start[group] + 1, len(group) - 1), start[group])  # of the replaced ones
    alone = skips[group] < 2
    shorter = np.where(meets, gap[group], best)
    better = meets & (alone | (n[shorter] > n[best]) | ((n[shorter] == n[best]) & (ids[shorter] < ids[best])))
    best = np.where(is_gap, longer[group], np.where(better, shorter, best))
    found = near > 0
    return ids[found], near[found], n[best[found]], ids[best[found]]


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``id``, ``n_near`` and ``best`` (n, -id of the most frequent near word) for the words that have one.

    ``vocabulary`` has ``id``, ``n``, ``word``, ``front``, ``back``. A pair with a skipped place has at most
    one word for each letter, and one word at most has it as a gap, so groups are small whatever the words.
    No pairs of words are listed: a member's near words in its group are counted, and the best is the
    group's first or, for that one, its second. Two words meet in one group only: a replaced code
    point has one place, and of equal neighbours only the first is skipped against a gap. Tasks
    read their sorted groups batch by batch.
    """
    columns = ["p", "q", "id", "n", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in columns]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            last = int(np.flatnonzero(run_starts(rows[0]) | run_starts(rows[1]))[-1])  # its group may go on
            held = [x[last:].copy() for x in rows]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _group_nears(*(x[:last] for x in rows))], ["id", "near", "best_n", "best_id"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in _group_nears(*held)], ["id", "near", "best_n", "best_id"])

    rows = _node_pairs(vocabulary).repartition("p", "q").sortWithinPartitions("p", "q").mapInArrow(run, "id long, near long, best_n long, best_id long")
    return rows.groupBy("id").agg(F.sum("near").alias("n_near"), F.max(F.struct(F.col("best_n").alias("n"), (-F.col("best_id")).alias("minus"))).alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """``id``, ``root``: the last of the forms that follow from ``id`` (``links``: ``id``, ``form``; no circles).

    Every round doubles the length of the step, so the rounds are logarithmic in the longest chain.
    """
    now = materialize(links.select("id", F.col("form").alias("up")), "spelling-links")
    while True:
        asked = now.groupBy("up").agg(F.count("*").alias("asked"))
        next_up = materialize(now.select(F.col("id").alias("up"), F.col("up").alias("next")).join(asked, "up"), "spelling-next")
        if next_up.isEmpty():
            return now.withColumnRenamed("up", "root")
        step = heavy_light_join(now, next_up, "up", "asked", now.count(), ["next"])
        later = materialize(step.select("id", F.coalesce("next", "up").alias("up")), "spelling-links")
        forget(now, next_up)
        now = later


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Words are the runs of Latin letters of all texts with A-Z lowered, one code point deleted from those
    that the checksum of id and run picks, of at least five code points and three occurrences. ``form`` is the
    most frequent near word (ties: the smallest) if it is at least twice as frequent as the word.
    Null texts have no words; a repeated row counts again; a null id counts as an empty one; other columns
    aren't read; an empty table gives no rows.
    """
    counts = materialize(word_counts(docs, doc_id, text), "spelling-counts")
    front = materialize(trie_paths(counts, "word", ["word", "n"]).withColumnsRenamed({"order": "id", "path": "front"}), "spelling-front")
    back = trie_paths(front.select("id", F.reverse("word").alias("drow")), "drow", ["id"]).select("id", F.col("path").alias("back"))
    vocabulary = materialize(front.join(back, "id"), "spelling-vocabulary")
    near = near_words(vocabulary).withColumn("form", -F.col("best.minus")).withColumn("form_n", F.col("best.n"))
    words = vocabulary.select("id", "word", "n").join(near, "id", "left")
    is_form = F.col("form_n") >= FORM_RATIO * F.col("n")
    words = words.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n"))
    words = materialize(words, "spelling-words")
    forget(vocabulary, front)
    ends = materialize(roots(words.where("form is not null").select("id", "form")), "spelling-roots")
    names = words.select(F.col("id").alias("form"), F.col("word").alias("name"))
    pairs = words.where("form is not null").select("id", "form").join(ends, "id")
    for column, name in (("form", "form_word"), ("root", "root_word")):
        asked = pairs.groupBy(column).agg(F.count("*").alias("asked"))
        known = materialize(names.withColumnsRenamed({"form": column, "name": name}).join(asked, column), "spelling-names")
        pairs = materialize(heavy_light_join(pairs, known, column, "asked", pairs.count(), [name]), "spelling-named")
    made = words.drop("form").join(pairs.select("id", "form_word", "root_word"), "id", "left")
    return made.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n")
