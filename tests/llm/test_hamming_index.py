"""All codes within a radius are found; recall and scores against brute force; copies, odd rows, cut cells."""

import numpy as np
import pytest

from packetloom.llm import hamming_index as module
from packetloom.llm.hamming_index import cosines, fit, nearest, unit_rows

SCHEMA = "vec_id long, embedding array<float>, score string, entry int"


def frame(spark, rows, parts=3, schema=SCHEMA):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "s", 1) for i, v in rows], schema).repartition(parts)


def brute(rows, k, queries):
    x = np.array([np.array(v, np.float32) for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    out = {}
    for q in queries:
        at = int(np.flatnonzero(ids == q)[0])
        score = cosines(x, np.broadcast_to(x[at], x.shape))
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def run(spark, df, k=5, every=10):
    got = {}
    for r in nearest(df, df.where(f"vec_id % {every} = 0"), k).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got.setdefault(r["query_id"], [])) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


def test_recall_in_clusters_and_cut_cells(spark, monkeypatch):
    monkeypatch.setattr(module, "CELL_VECTORS", 150)
    monkeypatch.setattr(module, "CELL_QUERIES", 20)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(12, 24))
    rows = [(i, centres[i % 12] + 0.4 * rng.normal(size=24)) for i in range(900)]
    got, want = run(spark, frame(spark, rows)), brute(rows, 5, range(0, 900, 10))
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]
    assert np.mean(hits) >= 0.95
    exact = {(q, i): s for q in want for i, s in want[q]}
    assert all(exact.get((q, i), s) == s for q in got for i, s in got[q])


def test_everything_is_found_at_the_last_radius(spark, monkeypatch):
    """With a radius that holds every code the result is the exact one, ties by id."""
    monkeypatch.setattr(module, "SPARE", 50)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6)) for i in range(120)]
    rows += [(200 + i, rows[0][1]) for i in range(40)]  # copies of a query
    got, want = run(spark, frame(spark, rows)), brute(rows, 5, [*range(0, 120, 10), 200, 210, 220, 230])
    assert got == want


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=4)) for i in range(1, 31)]
    odd = [(40, None), (50, []), (60, [0, 0, 0, 0]), (70, [1, None, 0, 0]), (80, [1, np.nan, 0, 0]), (90, [1, np.inf, 0, 0]), (100, [1, 2, 3]), (None, [1, 1, 1, 1])]
    got = run(spark, frame(spark, good + odd + good[:10]))
    assert set(got) == {10, 20, 30} and all(len(v) == 5 and {i for i, _ in v} <= set(range(1, 31)) for v in got.values())
    few = run(spark, frame(spark, good[9:11]))
    assert [i for i, _ in few[10]] == [11]
    assert run(spark, frame(spark, [])) == {} and run(spark, frame(spark, odd[:-2])) == {}


def test_doubles_and_large_values(spark):
    rows = [(10, [1e300, 0.0]), (11, [1e-300, 1e-301]), (12, [-1.0, 0.0])]
    got = run(spark, frame(spark, rows, schema=SCHEMA.replace("float", "double")))
    assert [i for i, _ in got[10]] == [11, 12]
    assert [s for _, s in got[10]] == pytest.approx([1 / np.sqrt(1.01), -1.0])


def test_codes_keep_near_vectors_near():
    rng = np.random.default_rng(3)
    x = unit_rows(rng.normal(size=(500, 80)))
    codes = fit(x, 5)
    y = unit_rows(x[:50] + 0.02 * rng.normal(size=(50, 80)))
    near = np.bitwise_count(codes.encode(x[:50]) ^ codes.encode(y)).mean()
    far = np.bitwise_count(codes.encode(x[:50]) ^ codes.encode(x[50:100])).mean()
    assert near < 12 < 28 < far < 36


def test_index_cells_answer_every_code_within_the_radius():
    """Pigeonhole: a code within the radius is found once over the four parts, one beyond it never."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    code = rng.integers(0, 2**63, 300, dtype=np.int64)
    code[1:150] = code[0] ^ np.array([sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 30), replace=False)) for _ in range(149)], np.int64)
    vectors = rng.normal(size=(300, 3)).astype(np.float32)
    entries = pa.table({"entry": np.arange(300), "code": code, "bytes": pa.array([v.tobytes() for v in vectors], pa.binary())})
    for probe in (0, 2, 5):
        radius, found = 4 * (probe + 1) - 1, []
        for part in range(4):
            query = pa.table({"query": [7], "code": code[:1], "bytes": pa.array([vectors[0].tobytes()], pa.binary()), "probe": [probe], "radius": [radius], "done": [-1], "part": [part]})
            found += [e for row in module._search(1000, 3)(query, entries).column("entry").to_pylist() for e in row]
        distance = np.bitwise_count(code.view(np.uint64) ^ code.view(np.uint64)[0])
        assert sorted(found) == np.flatnonzero(distance <= radius).tolist()
