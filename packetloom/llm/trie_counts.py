"""Token counts under a unigram vocabulary, with dynamic programming shared over a trie of pre-tokens.

The distinct pre-tokens of a block are inserted in a trie. A node's forward score, the best log-probability
of its prefix and the number of pieces in it, depends on the prefix alone, so it is computed once for all
pre-tokens below; terminal nodes give the pre-tokens' counts. The trie is walked in sorted order, so that
only the path to the current node is held.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import map_blocks

#: Stands before each pre-token in the vocabulary.
MARK = "▁"
#: Pre-tokens whose counts a worker remembers; then it forgets them all.
REMEMBERED = 300_000


def vocabulary(path: str) -> dict[str, float]:
    """Pieces of a public vocabulary file with the log of their Zipf share by rank, 1 / (rank H); no model is trained."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    return {p: -math.log(r + 1) - total for r, p in enumerate(pieces)}


class Counter:
    """Counts and log-probabilities of pre-tokens. A letter outside the vocabulary is one piece for each of its bytes."""

    def __init__(self, scores: dict[str, float]) -> None:
        #: every ending of a piece, with its score if it is a piece itself
        self.endings = {p[i:]: scores.get(p[i:]) for p in scores for i in range(len(p))}
        self.byte = min(scores.values(), default=0.0) - 1
        self.known: dict[str, tuple[int, float]] = {}
        self.nodes = 0

    def walk(self, words: Iterable[str]) -> dict[str, tuple[int, float]]:
        """Of each marked word: pieces on its best path (of equal paths the shortest) and the path's score."""
        out: dict[str, tuple[int, float]] = {}
        path: list[tuple[float, int]] = [(0.0, 0)]  # by depth: score and minus the pieces of the best split
        last, endings = "", self.endings
        for word in sorted(set(words)):
            shared = 0
            for a, b in zip(last, word, strict=False):
                if a != b:
                    break
                shared += 1
            del path[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                n = len(word[end - 1].encode())
                score, pieces = path[end - 1]
                best = (score + n * self.byte, pieces - n)
                for start in range(end - 1, -1, -1):
                    part = word[start:end]
                    if part not in endings:
                        break  # no piece ends so, nor in anything longer
                    if (own := endings[part]) is not None:
                        score, pieces = path[start]
                        if (found := (score + own, pieces - 1)) > best:
                            best = found
                path.append(best)
            self.nodes += len(word) - shared
            out[word] = (-path[-1][1], path[-1][0])
            last = word
        return out

    def texts(self, texts: list[list[str]]) -> list[tuple[int, int, float]]:
        """Of each text: pre-tokens, pieces, log-probability."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = {w for words in texts for w in words if w not in known}
        known |= {w[1:]: c for w, c in self.walk(MARK + w for w in new).items()}
        made = []
        for words in texts:
            found = [known[w] for w in words]
            made.append((len(words), sum(c for c, _ in found), math.fsum(s for _, s in found)))
        return made


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``doc_id``, ``n_pretokens`` (runs without white space), ``n_tokens``, ``log_probability``.

    Null and empty texts count 0. Rows are independent: repeated rows and ids stay, other columns are not
    read, an empty table gives none. The vocabulary (a fixed size) is read on the driver and broadcast.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    counters: list[Counter] = []

    def work(block: pa.RecordBatch) -> dict:
        if not counters:
            counters.append(Counter(shared.value))
        made = counters[0].texts([[w.decode("utf-8", "replace") for w in (x or b"").split()] for x in block.column("text").to_pylist()])
        return {"doc_id": block.column("doc_id")} | dict(zip(("n_pretokens", "n_tokens", "log_probability"), map(list, zip(*made, strict=True)), strict=True))

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return map_blocks(rows, "text", f"doc_id {kind}, n_pretokens long, n_tokens long, log_probability double", work)
