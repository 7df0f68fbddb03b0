"""Counts against plain Python, shrinkage, and documents of odd hosts."""

import random
import re
from collections import Counter

import pytest

from packetloom.llm.common import WordHashes
from packetloom.llm.host_rules import host_rules, text_counts


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    triples = list(zip(words, words[1:], words[2:], strict=False))
    count = Counter(triples)
    covered = {i + k for i, t in enumerate(triples) if count[t] > 1 for k in range(3)}
    lines = text.split("\n")
    again = sum(line in lines[:i] and bool(re.search("[^\x20\x09-\x0d]", line)) for i, line in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), again, len(covered)


def test_counts():
    rng, hashes = random.Random(1), WordHashes()
    texts = ["", " \n\n ", "a b a b a b a", "ü\nü\n\n\nü \x1c x", "a\x85b c d"]
    texts += ["".join(rng.choice("abü#%| \n\t") for _ in range(rng.randint(1, 400))) for _ in range(300)]
    for text in texts:
        assert text_counts(text.encode(), hashes) == plain(text), text


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    good = lambda: " ".join(f"w{rng.randrange(9999)}" for _ in range(60))
    out = [(i, good(), "good") for i in range(80)] + [(100 + i, "short text", "good") for i in range(4)]
    out += [(200 + i, "short", "bad") for i in range(60)] + [(260, good(), "bad")]
    out += [(300, good(), "lone"), (301, "short", "once"), (302, good(), None), (303, None, None), (None, good(), "good"), (0, out[0][1], "good")]
    return out + [(400 + i, good(), f"h{i}") for i in range(30)]


def test_host_verdicts_reach_documents(spark, rows):
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, source string, kept boolean").repartition(5)
    got = host_rules(docs).collect()
    assert len(got) == len(rows)
    kept = {(r.doc_id, r.host): r.kept for r in got}
    assert all(kept[i, "good"] for i in range(80)) and kept[None, "good"] and kept[300, "lone"] and kept[302, None]
    assert not kept[260, "bad"]  # a good document of a host that fails
    once = next(r for r in got if r.doc_id == 301)
    assert once.base_failed and not once.host_failed  # one document isn't enough to condemn a host
    assert not kept[303, None] and host_rules(docs.limit(0)).count() == 0
