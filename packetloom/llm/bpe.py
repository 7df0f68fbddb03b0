"""Byte-level BPE: merges applied over an index from each pair to its places, ranks ascending."""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import map_blocks

#: Fixed value: the pattern that splits text before the merges of byte-level vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: The same split for texts without code points above U+024F: letters, numbers and spaces of that range spelt out.
LAST_LATIN = "\u024f"
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN_PATTERN = f" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: Pre-tokens whose ids a worker remembers; then it forgets them all.
REMEMBERED = 100_000
#: Bytes of text that are split and merged at once.
BLOCK = 1_000_000
#: Places of a pair from which on they are merged as an array.
FEW = 64
#: The rank of a pair that doesn't merge.
NONE = np.int32(2**31 - 1)


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: itself, or the next free one from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairIndex:
    """From each active rank to the places where its pair stands, or stood when they were added."""

    def __init__(self, rank: np.ndarray) -> None:
        self.single: dict[int, list[int]] = {}
        self.arrays: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        at = np.flatnonzero(rank != NONE)
        self.add_many(at, rank[at])

    def add(self, rank: int, place: int) -> None:
        if rank in self.single:
            self.single[rank].append(place)
            return
        if rank not in self.arrays:
            heapq.heappush(self.active, rank)
        self.single[rank] = [place]

    def add_many(self, places: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for r, s, e in zip(ranks[[0, *cuts.tolist()]].tolist() if len(ranks) else (), [0, *cuts.tolist()], [*cuts.tolist(), len(ranks)], strict=False):
            if e - s < FEW:
                for place in places[s:e].tolist():
                    self.add(r, place)
                continue
            if r not in self.single and r not in self.arrays:
                heapq.heappush(self.active, r)
            self.arrays.setdefault(r, []).append(places[s:e])

    def pop(self) -> tuple[int, np.ndarray | list[int]]:
        """The lowest active rank and its places in ascending order, as an array if there are many."""
        r = heapq.heappop(self.active)
        single, arrays = self.single.pop(r, []), self.arrays.pop(r, [])
        if arrays or len(single) >= FEW:
            return r, np.unique(np.concatenate([*arrays, np.array(single, np.int64)]))
        return r, sorted(single)


class Codec:
    """A vocabulary file's tables. ``special`` strings are cut out of the text before it is split."""

    def __init__(self, source: str) -> None:
        given = json.loads(source)
        vocab, self.known = given["model"]["vocab"], {}
        letters = byte_letters()
        special = {x["content"]: x["id"] for x in given["added_tokens"]}
        self.bytes_of = {i: b"".join(bytes([letters[c]]) if c in letters else c.encode() for c in piece) for piece, i in vocab.items()}
        self.bytes_of |= {i: piece.encode() for piece, i in special.items()}
        self.first = np.zeros(256, np.int32)
        for letter, b in letters.items():
            self.first[b] = vocab[letter]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in given["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        self.pairs = [(vocab[a], vocab[b]) for a, b in pairs]
        self.rank = {x: r for r, x in enumerate(self.pairs)}
        self.rank_of = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.rank_of]
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.special = special
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        every, latin, beyond = regex.compile(PATTERN).findall, re.compile(LATIN_PATTERN).findall, re.compile(f"[^\0-{LAST_LATIN}]").search
        self.split = lambda text: (every if beyond(text) else latin)(text)

    def pre_tokens(self, text: str) -> list[str]:
        if self.cut is None or not any(x in text for x in self.special):
            return self.split(text)
        return [x for part in self.cut.split(text) for x in ([part] if part in self.special else self.split(part))]

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as the bytes of 32-bit numbers.

        All words lie in one row of symbols, parted by -1. The index maps each mergeable pair, named by its
        rank, to the positions of its left symbols. The active pair of lowest rank in the whole row is
        merged at all its positions from left to right, and only the lists of the pairs beside a merge
        change. A merge makes a piece that only higher ranks use, so ascending ranks give what each
        word alone would. Long lists of positions are worked off as arrays, short ones one by one.
        """
        row = self.first[np.frombuffer(b"\0".join([*words, b""]), np.uint8)]
        row[np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1] = -1
        rank = np.full(len(row), NONE, np.int32)
        self._look_up(row, rank, np.arange(len(row) - 1))
        index = PairIndex(rank)
        # the same memory as an array and, for single places, as a sequence of plain numbers
        symbols, after, before = (array("i", x.astype(np.int32).tobytes()) for x in (row, np.arange(1, len(row) + 1), np.arange(-1, len(row) - 1)))
        row, nexts, lasts = (np.frombuffer(x, np.int32) for x in (symbols, after, before))
        while index.active:
            r, places = index.pop()
            a, b, new = *self.pairs[r], int(self.merged[r])
            if isinstance(places, np.ndarray):
                i = places[(row[places] == a) & (row[nexts[places]] == b)]
                if a == b:  # of a run like aaaa every second one
                    k = np.arange(len(i))
                    fresh = np.append(True, i[1:] != nexts[i[:-1]])[: len(i)]
                    i = i[(k - np.maximum.accumulate(np.where(fresh, k, 0))) % 2 == 0]
                j = nexts[i]
                k = nexts[j]
                row[i], row[j], nexts[i], lasts[k] = new, -2, k, i
                index.add_many(*self._ranked(row, nexts, np.concatenate([i, lasts[i]])))
                continue
            for i in places:
                j = after[i]
                if symbols[i] != a or symbols[j] != b:
                    continue
                symbols[i], symbols[j] = new, -2
                k = after[i] = after[j]
                before[k] = i
                left = before[i]
                x, y = symbols[left], symbols[k]  # -1 at a word's ends; before the first word comes the last place
                if x >= 0 and (near := self.rank.get((x, new))) is not None:
                    index.add(near, left)
                if y >= 0 and (near := self.rank.get((new, y))) is not None:
                    index.add(near, i)
        data = row[row != -2]
        ends = np.flatnonzero(data < 0)
        data = data.tobytes()
        return [data[4 * s : 4 * e] for s, e in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=True)]

    def _ranked(self, row: np.ndarray, nexts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the places that start a mergeable pair, once each, and the pairs' ranks."""
        at = np.unique(at[at >= 0])
        at = at[row[at] >= 0]
        a, b = row[at].astype(np.int64), row[nexts[at]].astype(np.int64)
        keys = np.where(b < 0, -1, a << 20 | b)
        found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[found] == keys
        return at[hit], self.rank_of[found[hit]]

    def _look_up(self, row: np.ndarray, rank: np.ndarray, at: np.ndarray) -> None:
        a, b = row[at].astype(np.int64), row[at + 1].astype(np.int64)
        keys = np.where((a < 0) | (b < 0), -1, a << 20 | b)
        found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        rank[at] = np.where(self.keys[found] == keys, self.rank_of[found], NONE)

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        """Ids of each text; those of a pre-token are remembered as the bytes of 32-bit numbers."""
        pieces = [self.pre_tokens(text) for text in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if new := [x for x in set(chain.from_iterable(pieces)) if x not in self.known]:
            plain = [x for x in new if x not in self.special]
            for x, ids in zip(plain, self.merge_all([x.encode() for x in plain]), strict=True):
                self.known[x] = ids
            self.known |= {x: np.int32(self.special[x]).tobytes() for x in new if x in self.special}
        return [np.frombuffer(b"".join(map(self.known.__getitem__, x)), np.int32) for x in pieces]

    def decode(self, ids: np.ndarray | list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")


_codecs: dict[int, Codec] = {}


def _codec(source: str) -> Codec:
    """The tables, made once a worker."""
    key = hash(source)
    if key not in _codecs:
        _codecs[key] = Codec(source)
    return _codecs[key]


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))


def bpe_encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """One row a document: its id, ``ids`` and, if asked for, ``decoded``, the text made again from the ids.

    ``path`` is the vocabulary file; only the driver reads it, its bytes (a fixed size) are broadcast.
    Null and empty texts have no ids and decode to the empty text. Rows are independent, so repeated rows
    and ids stay as they are; columns besides id and text are not read.
    """
    with open(path, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(block: pa.RecordBatch) -> dict:
        codec = _codec(source.value)
        ids = codec.encode(x or "" for x in block.column("text").to_pylist())
        return {"doc_id": block.column("doc_id"), "ids": _lists(ids)} | ({"decoded": [codec.decode(x) for x in ids]} if decoded else {})

    return map_blocks(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded, work, BLOCK)


def bpe_decode(encoded: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row a document: its id and the ``text`` of its ids; no ids or null give the empty text."""
    with open(path, encoding="utf-8") as f:
        source = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        codec = _codec(source.value)
        for batch in batches:
            made = [codec.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.string())], ["doc_id", "text"])

    kind = encoded.schema[doc_id].dataType.simpleString()
    return encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, f"doc_id {kind}, text string")
