"""Components against brute force, with blocks small enough to be cut; the tree against all pairs."""

import random
import re

import numpy as np
import pytest

from packetloom.llm import jaccard_tree
from packetloom.llm.components import connected_components
from packetloom.llm.jaccard_tree import Tree, bitmap, jaccard_components, linked, merged, needed


def plain_set(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [(i, plain_set(t)) for i, t in rows]
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and i != j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


def edited(words, n, rng):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    new = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    out, passage = [], new(40)
    for size, copies in ((60, 90), (200, 40), (700, 12), (12, 10), (6, 8)):
        base = new(size)
        out += [edited(base, rng.randint(0, max(1, size // 40)), rng) for _ in range(copies)]
    out += [new(rng.randint(5, 80)) + passage + new(rng.randint(0, 60)) for _ in range(80)]
    out += [new(rng.randint(1, 90)) for _ in range(80)] + [["One", "two"], ["one", "TWO"], ["two", "one"], ["a"], ["É"], ["é"]]
    out += out[:25]
    texts = [(i, " ".join(w)) for i, w in enumerate(out)] + [(9001, None), (9002, ""), (9003, " \n"), (None, " ".join(out[0])), (7, " ".join(out[7]))]
    rng.shuffle(texts)
    return texts


def run(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id long, text string, component long, n string").repartition(5)
    return sorted(map(tuple, jaccard_components(docs).collect()), key=str)


def test_components(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_cut_blocks_and_the_second_step_alone(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard_tree, "BLOCK_MEMBERS", 7)
    monkeypatch.setattr(jaccard_tree, "BLOCK_HASHES", 1)  # no two sets meet in the first step
    monkeypatch.setattr(jaccard_tree, "FEW_IDS", 0)
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tree_keeps_every_link():
    rng = np.random.default_rng(4)
    sets = []
    for size in (3, 40, 300, 1500):
        base = rng.integers(0, 2**64, size, dtype=np.uint64)
        for _ in range(60):
            kept = base[rng.random(size) > rng.choice([0.0, 0.02, 0.08, 0.3])]
            sets.append(np.unique(np.concatenate([kept, rng.integers(0, 2**64, rng.integers(1, 2 + size // 20), dtype=np.uint64)])))
    sizes = np.array([len(x) for x in sets])
    group = rng.integers(0, 150, len(sets))
    want = {(i, j) for j in range(len(sets)) for i in range(j) if linked(sets[i], sets[j])}
    pairs = [(i, j) for a, b, _ in Tree([bitmap(x) for x in sets], sizes, group).pairs() for i, j in zip(a.tolist(), b.tolist(), strict=True)]
    got = {(min(p), max(p)) for p in pairs}
    assert len(pairs) == len(got) and {p for p in want if group[p[0]] != group[p[1]]} <= got
    assert len(got) < len(sets) ** 2 / 6  # and drops most
    root = merged(sets)
    for i, j in want:
        assert root[i] == root[j]


def test_needed_is_exact():
    for a in range(1, 40):
        for b in range(1, 40):
            least = next((i for i in range(min(a, b) + 1) if 100 * i >= 80 * (a + b - i)), None)
            assert least is None or least == needed(a, b)


def test_long_chains(spark):
    rng = random.Random(5)
    nodes = list(range(400))
    rng.shuffle(nodes)
    chain = list(zip(nodes[:250], nodes[1:251], strict=True)) + [(nodes[260], x) for x in nodes[261:330]] + [(5, 5), (None, 3), chain_end := (nodes[340], nodes[341]), chain_end]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    for part in (nodes[:251], nodes[260:330], nodes[340:342]):
        assert {got[n] for n in part} == {min(part)}
    assert len(got) == 251 + 70 + 2


def test_any_text_of_an_id_can_link_in_a_small_block(spark, monkeypatch):
    """Pairs are taken by id, so the bound is tried for each text; before, the first text of a repeated id stood for all."""
    monkeypatch.setattr(jaccard_tree, "BLOCK_HASHES", 1)
    rng = random.Random(8)
    rows = []
    for i in range(0, 120, 2):
        base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        near = [*base[:-2], "y", "z"]
        half = [*base[:42], *(f"v{rng.randrange(10**6)}" for _ in range(18))]  # shares hashes, doesn't link
        rows += [(i, " ".join(half)), (i, " ".join(near)), (i + 1, " ".join(base))]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows)


def test_what_travels(spark, rows):
    """A hash goes by its low bytes; a set goes to its blocks from the task that reads its text, without a shuffle in between."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_tree.sketches(docs, "doc_id", "text")
    assert dict(got.dtypes)["prefix"] == "binary"
    for r in got.where("n > 0").collect():
        n_hashes = jaccard_tree.short_prefix(r.n) + r.n // jaccard_tree.SPARE
        assert len(r.prefix) == jaccard_tree.HASH_BYTES * min(r.n, n_hashes)
    ids = spark.createDataFrame([(i, [i, -i]) for i in range(5)], "doc_id long, blocks array<long>")
    sets = jaccard_tree.sets_of(docs, ids, "doc_id", "text")
    assert {(r.doc_id, tuple(r.blocks)) for r in sets.collect()} == {(i, (i, -i)) for i in range(5)}
    assert "hashpartitioning" not in sets._jdf.queryExecution().executedPlan().toString()


def test_bitmaps_once_a_pair(spark):
    """Small blocks give each pair once, whatever number of hashes it shares."""
    import pyarrow as pa

    few = pa.table({"hash": [5, 5, 9, 9, 9, 7, 7], "doc_id": [1, 2, 2, 1, 3, 4, 1], "n": [10, 10, 10, 10, 10, 10, 30], "component": [1, 2, 2, 1, 1, 4, 1]})
    assert sorted(zip(*jaccard_tree._near_pairs(few).to_pydict().values(), strict=True)) == [(2, 1), (3, 2)]
