"""Order MinHash against a direct version, its edit sensitivity, and the pairing of successors."""

import hashlib
import random

import numpy as np

from packetloom.llm.order_minhash import K, ROWS, TUPLE, edited_likeness, fingerprints, k_mers, likeness, order_minhash
from packetloom.llm.queries import QUERIES

STEP, M64 = 0xD6E8FEB86659FD93, 2**64


def mix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % M64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % M64
    return x ^ (x >> 31)


def direct(text):
    hashes = [int(x) for x in k_mers(text)]
    if not hashes:
        return [0] * ROWS
    seen, pairs = {}, []
    for place, h in enumerate(hashes):
        c = seen[h] = seen.get(h, -1) + 1
        pairs.append((mix((h + c * STEP) % M64) if c else h, place))
    out = []
    for r in range(ROWS):
        start = r * (M64 // ROWS)
        least = sorted(pairs, key=lambda p: (p[0] - start) % M64)[:TUPLE]
        in_text = [hashes[p] for p in sorted(p for _, p in least)]
        x = in_text[0]
        for y in in_text[1:]:
            x = mix((x * 0x9E3779B97F4A7C15 + y) % M64)
        out.append(mix(x) >> 32)
    return out


def test_equals_the_direct_version():
    rng = random.Random(1)
    texts = ["", "a", "ab", "abcdefg", "abcdefgh", "abcdefghi", "aaaaaaaaaaaaaaaaaaaaaaaa", "héllo wörld 😀 again"]
    texts += ["".join(rng.choice("ab c") for _ in range(rng.randint(1, 300))) for _ in range(40)]
    for text in texts:
        assert order_minhash(text).tolist() == direct(text), text


def test_k_mers_tell_windows_apart():
    rng = random.Random(2)
    text = "".join(rng.choice("abc") for _ in range(4000))
    hashes, windows = k_mers(text), [text[i : i + K] for i in range(len(text) - K + 1)]
    assert len(hashes) == len(windows)
    assert len(set(hashes.tolist())) == len(set(windows)) == len(set(zip(hashes.tolist(), windows, strict=True)))


def test_likeness_falls_with_edits_and_sees_order():
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(600)]
    base = order_minhash(" ".join(words))
    near = [likeness(base, order_minhash(" ".join([*words[: 600 - n], *(f"x{rng.randrange(10**6)}" for _ in range(n))])), False, False) for n in (0, 30, 150, 400, 600)]
    assert near[0] == 1 and all(a > b for a, b in zip(near, near[1:], strict=False))
    blocks = [words[i : i + 20] for i in range(0, 600, 20)]
    shuffled = [w for b in reversed(blocks) for w in b]  # nearly the same k-mers in another order
    assert likeness(base, order_minhash(" ".join(shuffled)), False, False) < 0.8


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for i, (key, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        a, e, b = (np.array(direct(x)) for x in (text, edited, after))
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), "".join(f"{x:08x}" for x in a), "".join(f"{x:08x}" for x in e), likeness(a, e, not text, not edited), likeness(a, b, not text, not after)))
    return sorted(out, key=str)


def test_successors_over_partitions_ties_and_nulls(spark):
    rng = random.Random(4)
    rows = [(i * 7 - 90, "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 60)))) for i in range(120)]
    rows += [(None, "no id here at all"), (5, None), (13, ""), (rows[50][0], "same id"), rows[60], rows[60]]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, head string").repartition(7)
    got = sorted((tuple(r) for r in edited_likeness(docs).collect()), key=str)
    assert got == expected(rows)
    one = docs.where("doc_id = 29")
    assert edited_likeness(one).count() == 1 and edited_likeness(docs.limit(0)).count() == 0
    prints = {(r.doc_id, r.fingerprint) for r in fingerprints(docs).collect()}
    assert prints == {(r[0], r[3]) for r in got}


def test_query(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    made = QUERIES["op9_order_minhash"](spark, small).collect()
    got = sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in made), key=str)
    order = sorted(rows, key=lambda r: -r[0])
    want = []
    for i, (key, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        a, e, b = (order_minhash(x) for x in (text, edited, after))
        want.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), likeness(a, e, not text, not edited), likeness(a, b, not text, not after)))
    assert got == sorted(want, key=str)
    assert sum(r[3] > r[4] for r in got) > 0.95 * len(got)
