"""Words, near words and roots against pairs compared one by one; tries over many ranges."""

import random
import zlib
from collections import Counter

import pytest

from packetloom.llm.spelling import border_nodes, spelling_variants, trie_paths, words_of


def words(rows):
    counts = Counter()
    for i, text in rows:
        run = ""
        for ch in (text or "") + " ":
            if "a" <= ch.lower() <= "z" and ch.isascii() or "À" <= ch <= "ÿ":
                run += ch.lower() if ch.isascii() else ch
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % 97 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= 5:
                    counts[run] += 1
            run = ""
    return {w: n for w, n in counts.items() if n >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    count = words(rows)
    near = {w: [v for v in count if v != w and one_apart(w, v)] for w in count}
    best = {w: min(vs, key=lambda v: (-count[v], v)) if vs else None for w, vs in near.items()}
    form = {w: v if v and count[v] >= 2 * count[w] else None for w, v in best.items()}
    out = []
    for w in count:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None))
    return sorted(out)


def run(spark, rows, parts=4):
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, id int").repartition(parts)
    return sorted(map(tuple, spelling_variants(df).collect()))


def test_against_pairs(spark):
    rng = random.Random(2)
    base = ["aaaaa", "abcde", "banana", "ßtraße", "élève", "zzzzzz", "×××÷÷", "llanos", "aabbcc"]
    texts = []
    for i in range(90):
        line = []
        for _ in range(30):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abnéÿ") + w[at:], w[:at] + rng.choice("abz") + w[at + 1 :]])
            line.append(rng.choice([w, w.upper() if w.isascii() else w]))
        texts.append((i // 2 if i % 7 else None, rng.choice([" ", "-", "\n1", "…"]).join(line)))
    texts += [(900, None), (901, ""), (902, "12 34"), (903, "x" * 6000 + " " + "x" * 6001)] + [(904, "x" * 6000)] * 4 + [(905, "x" * 6001)] * 4 + texts[:10]
    got = run(spark, texts)
    assert got == brute(texts)
    assert any(r[1] and r[2] != r[1] for r in got) and max(r[4] for r in got) > 3


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [(1, None), (2, "one two")]) == []


def test_deleted_code_point():
    i = next(i for i in range(10_000) if zlib.crc32(f"{i}:élèves".encode()) % 97 == 0)
    at = zlib.crc32(f"{i}:élèves".encode()) % 6
    assert list(words_of(i, "Élèves élèves".encode())) != list(words_of(i, "élèves élèves".encode()))  # É isn't lowered
    assert list(words_of(i, "élèves élèves".encode())) == [("élèves"[:at] + "élèves"[at + 1 :], 2)]


@pytest.mark.parametrize("parts", ["1", "7"])
def test_numbers_name_prefixes(spark, parts):
    """Equal prefixes have one number and different ones two, over all ranges; the order is the words'."""
    rng = random.Random(1)
    vocabulary = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(1, 9))) for _ in range(300)} | {"é", "éa", "ab😀"})
    df = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        rows = trie_paths(df.selectExpr("word", "word as w"), "word", ["w"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    number = {}
    for r in rows:
        assert len(r["path"]) == len(r["w"]) + 1
        for d, node in enumerate(r["path"]):
            assert number.setdefault(r["w"][:d], node) == node
    assert len(set(number.values())) == len(number)
    assert [r["w"] for r in sorted(rows, key=lambda r: r["order"])] == vocabulary


def test_border_nodes_span_ranges():
    made = border_nodes([(0, "a", "abca"), (2, "abcb", "abcb"), (5, "abcc", "abd"), (6, "b", "c")])
    assert made[0][1] == made[2][0] and made[2][0][:4] == made[2][1][:4] == made[5][0][:4]
    assert made[5][1] == made[6][0] and made[6][0][0] == made[0][1][0] and len(made[6][0]) == 1
