"""Removed words against brute force over all windows."""

import random
import re

import numpy as np
import pytest

from packetloom.llm.common import WordHashes
from packetloom.llm.seed_extend import LENGTH, anchors, maximal, remove_repeats


def brute(rows):
    split = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    owner = {}
    for i, words in split:
        for k in range(len(words) - LENGTH + 1):
            w = tuple(words[k : k + LENGTH])
            if i is not None:
                owner[w] = min(owner.get(w, i), i)
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - LENGTH + 1):
            if i is not None and owner[tuple(words[k : k + LENGTH])] < i:
                gone.update(range(k, k + LENGTH))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    new = lambda n, v=400: [f"w{rng.randrange(v)}" for _ in range(n)]
    passages = [new(n) for n in (12, 13, 14, 30, 120)]
    out = []
    for _ in range(150):
        text = new(rng.randint(0, 60))
        for p in rng.sample(passages, rng.randint(0, 3)):
            a = rng.randint(0, 3)
            text += p[a:] + new(rng.randint(0, 30))
        out.append(text)
    out += [["a"] * n for n in (12, 13, 20, 400)] + [["a", "b"] * 30, new(500, 2), new(500, 2), new(12), new(13)] + out[:20]
    rows = [(i * 3 - 60, rng.choice([" ", "\n", " \t "]).join(w)) for i, w in enumerate(out)]
    rows += [(5001, None), (5002, ""), (None, rows[3][1]), rows[30], (5003, "é \x1c ü x " * 9), (5004, "é \x1c ü x " * 9)]
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int").repartition(6)
    made = remove_repeats(docs).collect()
    assert sorted(((r.doc_id, r.n_words, sum(b - a for a, b in r.repeats), r.kept) for r in made), key=str) == brute(rows)
    assert all(b - a >= LENGTH for r in made for a, b in r.repeats)
    assert remove_repeats(docs.limit(0)).count() == 0


def test_every_window_has_one_anchor():
    rng, hashes = random.Random(2), WordHashes()
    for n in (0, 5, 12, 13, 14, 40, 300):
        words = hashes.of([b"w%d" % rng.randrange(50) for _ in range(n)])
        seeds, starts, counts, prints = anchors(words)
        assert counts.sum() == len(prints) == max(0, n - LENGTH + 1)
        assert np.array_equal(starts, np.cumsum(counts) - counts) and len(seeds) <= max(1, n)


def test_maximal_ranges():
    assert maximal([], []) == []
    assert maximal([4, 0, 30], [2, 4, 1]) == [(0, 18), (30, 43)]
    assert maximal([0, 13], [1, 1]) == [(0, 26)]
