"""Targets against a direct reshare loop, words near targets, odd rows."""

import random

import pytest

from packetloom.llm.mixture import mix_sources, source_targets


def direct_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), sum(sizes.values())
    while free:
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
        free -= over
    return target


def test_targets(spark):
    rng = random.Random(1)
    for case in range(6):
        sizes = {f"s{i}": rng.choice([0, 1, 5, 100, 3000, 50_000]) for i in range(1 + 3 * case)}
        if case % 2:
            sizes[None] = 700
        made = source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long"), (1, 2, 3), 3)
        got = {r.source: r.target for r in made.collect()}
        assert got == pytest.approx(direct_targets(sizes)), sizes


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)) + rng.choice(["", " %%% ###"]), rng.choice(["a", "a", "a", "b", "é", None]), "x") for i in range(900)]
    rows += [(1000, None, "a", "x"), (1001, "", "empty", "x"), (None, "w w w", "b", "x"), rows[5], rows[5], (2000, "w " * 4000, "long", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string").repartition(6)


def test_words_come_near_the_targets(docs):
    made = mix_sources(docs).collect()
    assert len(made) == docs.count() and sorted(map(str, made)) == sorted(map(str, mix_sources(docs.repartition(3)).collect()))
    by = {}
    for r in made:
        by.setdefault(r.source, []).append(r)
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 3
    for source, rows in by.items():
        assert sum(r["size"] for r in rows) == rows[0].source_size
        if source != "long":
            assert abs(sum(r.taken for r in rows) - rows[0].target) <= 3, source
        assert max(r.copies for r in rows) - min(r.copies for r in rows) <= 1  # whole epochs first
    assert mix_sources(docs.limit(0)).count() == 0


def test_quality_weighs(spark):
    rows = [(i, "w " * 20 + ("# " * 10 if i % 2 else ""), "b" if i < 800 else "a") for i in range(2000)]
    made = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1, 5)).collect()
    bad = [r.copies for r in made if r.source == "a" and r.doc_id % 2]
    good = [r.copies for r in made if r.source == "a" and not r.doc_id % 2]
    assert sum(good) / len(good) > 1.2 * sum(bad) / len(bad)
