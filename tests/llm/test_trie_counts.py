"""Counts against a plain dynamic programme per word; shared prefixes are computed once."""

import random

import public_tokenizers
import pytest

from packetloom.llm.queries import QUERIES
from packetloom.llm.trie_counts import MARK, Counter, token_counts, vocabulary

PATH = public_tokenizers.path("piece_bpe_32k.model")


def plain(scores, byte, word):
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        n = len(word[end - 1].encode())
        options = [(best[end - 1][0] + n * byte, best[end - 1][1] - n)]
        options += [(best[s][0] + scores[word[s:end]], best[s][1] - 1) for s in range(end) if word[s:end] in scores]
        best.append(max(options))
    return -best[-1][1], best[-1][0]


@pytest.fixture(scope="module")
def scores():
    return vocabulary(PATH)


def test_equals_a_plain_programme(scores):
    rng, counter = random.Random(1), Counter(scores)
    words = {"".join(rng.choice("abcdeinrstü語😀.") for _ in range(rng.randint(1, 14))) for _ in range(2000)} | {"internationalisation", "inter", "internal", "x" * 500}
    got = counter.walk(MARK + w for w in words)
    assert got == {MARK + w: plain(scores, counter.byte, MARK + w) for w in words}
    assert counter.nodes == len({(MARK + w)[:i] for w in words for i in range(1, len(w) + 2)})  # one per trie node


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, " \n", 1), (4, "a b a", 1), (4, "a b a", 1), (None, "word", 1), (5, "y" * 100_000, 1)], "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_pretokens): r.n_tokens for r in token_counts(docs, PATH).collect()}
    assert [got[k, 0] for k in (1, 2, 3)] == [0, 0, 0] and got[4, 3] == 3 and got[5, 1] > 0 and (None, 1) in got
    assert token_counts(docs, PATH).count() == 7 and token_counts(docs.limit(0), PATH).count() == 0


def test_query(spark, small, scores):
    counter = Counter(scores)
    want = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        words = [w.decode() for w in r.text.encode().split()]
        want[r.doc_id] = (len(words), sum(plain(scores, counter.byte, MARK + w)[0] for w in words))
    assert {r.doc_id: (r.n_pretokens, r.n_tokens) for r in QUERIES["op3_trie_token_counts"](spark, small).collect()} == want
