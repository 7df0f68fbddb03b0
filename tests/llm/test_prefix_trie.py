"""Subtree totals against a recursion; the trie against one built turn by turn."""

import hashlib
import math
import random
import zlib

import pytest

from packetloom.llm import prefix_trie as module
from packetloom.llm.contraction import subtree_totals
from packetloom.llm.prefix_trie import joined_digests, prefix_trie, ranked

SCHEMA = "conv_id long, turn long, role string, text string, node string, key int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "n", 1) for r in rows], SCHEMA).repartition(parts)


class Node:
    def __init__(self, parent, depth, text):
        self.parent, self.depth, self.text, self.kids, self.members, self.ends = parent, depth, text, {}, [], []


def brute(rows):
    turns = {}
    for conv, turn, role, text in rows:
        role, text = role or "", text or ""
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    root = Node(None, 0, "")
    nodes = [root]
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        node = root
        node.members.append(c)
        for turn in turns.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]:
            if turn not in node.kids:
                nodes.append(node.kids.setdefault(turn, Node(node, node.depth + 1, turn[1])))
            node = node.kids[turn]
            node.members.append(c)
        node.ends.append(c)
    out = []
    for n in reversed(nodes):
        n.leaves = sum(k.leaves for k in n.kids.values()) or 1
        n.saved = sum(k.saved for k in n.kids.values()) + (len(n.members) - 1) * len(n.text)
        digest = hashlib.sha256(",".join(map(str, sorted(n.ends))).encode()).hexdigest()
        if turns:
            out.append((min(n.members), n.depth, min(n.parent.members) if n.parent else None, len(n.members), len(n.kids), n.leaves, n.saved, digest))
    return sorted(out, key=str)


def run(spark, rows, parts=3):
    return sorted(map(tuple, prefix_trie(frame(spark, rows, parts)).collect()), key=str)


def test_trie_of_nulls_ties_repeats_and_missing_families(spark, monkeypatch):
    monkeypatch.setattr(module, "SLICE", 7)
    monkeypatch.setattr(module, "IDS", 4)
    rng = random.Random(5)
    texts = ["", None, "hi", "é😀", "a longer turn"]
    rows = []
    for c in [*range(0, 12), *range(100, 125), *range(705, 725), -3]:  # 700 is missing
        rows += [(c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(texts)) for t in range(rng.randint(1, 8))]
    rows += [(200, t, "user", f"turn {t % 3}") for t in range(90)]  # a long one that others share
    rows += [(c, t, "user", f"turn {t % 3}") for c in range(201, 215) for t in range(rng.randint(1, 40))]
    rows += [(3, 1, "user", "hi")] * 3 + [(None, 0, "user", "lost")]
    assert run(spark, rows) == brute(rows)


def test_empty_and_single(spark):
    assert run(spark, []) == []
    rows = [(1, 0, None, None)]  # its first turns would come from 0, which isn't there
    assert run(spark, rows) == brute(rows)


def test_ranks_across_borders(spark):
    df = spark.createDataFrame([(1, None if i % 50 == 0 else i // 2) for i in range(400)] + [(2, i) for i in range(5)], "g int, o int").repartition(4)
    got = [(r["g"], r["place"]) for r in ranked(df, "g", ["o"]).collect()]
    assert sorted(got) == [(1, i + 1) for i in range(400)] + [(2, i + 1) for i in range(5)]


def test_digest_of_a_group_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(module, "IDS", 10)
    ids = list(range(0, 995, 3))
    df = spark.createDataFrame([("a", i) for i in ids] + [("b", 7)], "g string, n long").repartition(5)
    want = {"a": ids, "b": [7]}
    want = {k: hashlib.sha256(",".join(map(str, v)).encode()).hexdigest() for k, v in want.items()}
    assert {r["g"]: r["digest"] for r in joined_digests(df, "g", "n").collect()} == want


@pytest.mark.parametrize("shape", ["chain", "star", "mixed"])
def test_subtree_totals(spark, shape):
    rng = random.Random(shape)
    n = 120
    parent = {0: None}
    for v in range(1, n):
        parent[v] = {"chain": v - 1, "star": 0, "mixed": v - 1 if rng.random() < 0.7 else rng.randrange(v)}[shape]
    parent[n] = 10**6  # hangs from no node, so it's a root
    value = {v: rng.randint(-5, 9) for v in parent}
    total = dict(value)
    for v in sorted(parent, reverse=True):
        if parent[v] in total:
            total[parent[v]] += total[v]
    df = spark.createDataFrame([(v, p, value[v], 1) for v, p in parent.items()], "node long, parent long, x long, y long")
    got = {r["node"]: r["x"] for r in subtree_totals(df, ["x", "y"]).collect()}
    assert got == total


def test_no_nodes(spark):
    assert subtree_totals(spark.createDataFrame([], "node long, parent long, x long"), ["x"]).collect() == []
