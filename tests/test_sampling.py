import hashlib
from collections import Counter

import numpy as np
import pytest

from packetloom.operators import sampling, select


def test_hash_split_ignores_partitioning_and_is_complete(spark):
    df = spark.range(2000)
    train, test = sampling.split(df, "id", 0.7)
    again, _ = sampling.split(df.repartition(7), "id", 0.7)
    kept = {r[0] for r in train.collect()}
    assert kept == {r[0] for r in again.collect()}
    assert kept | {r[0] for r in test.collect()} == set(range(2000))
    assert 1300 < len(kept) < 1500


def test_split_keeps_rows_with_null_key(spark):
    df = spark.createDataFrame([(None, 1), (3, 2)], "k int, x int")
    train, test = sampling.split(df, "k")
    assert train.count() + test.count() == 2


def test_random_split_option(spark):
    train, test = sampling.split(spark.range(100), "id", 0.5, method="random")
    assert train.count() + test.count() == 100
    with pytest.raises(ValueError):
        sampling.split(spark.range(1), "id", method="other")


def test_sample_size_rounds_half_up(spark):
    assert sampling.sample_size(5, 0.5) == 3
    df = spark.createDataFrame([(i, None if i % 2 else float(i)) for i in range(5)], "id int, x double")
    rows = sampling.sample_exact(df, "id", 0.5).collect()
    assert len(rows) == 3 and all(r["x"] is not None for r in rows)
    smallest = sorted(range(5), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[:3]
    assert {r["id"] for r in rows} == set(smallest)


def test_large_selection_equals_top_n(spark, monkeypatch):
    df = spark.range(3000).selectExpr("id", "(id * 7919) % 1000 as v")
    expected = {(r["id"], r["v"]) for r in select.smallest(df, "v", 1234, ["id"]).collect()}
    monkeypatch.setattr(select, "SMALL_LIMIT", 10)
    monkeypatch.setattr(select, "LISTABLE", 50)
    monkeypatch.setattr(select, "SPLITS", 16)
    assert {(r["id"], r["v"]) for r in select.smallest(df, "v", 1234, ["id"]).collect()} == expected
    assert select.smallest(df, "v", 5000, ["id"]).count() == 3000
    assert select.smallest(df, "v", 0).count() == 0


def test_selection_with_hot_and_missing_order_values(spark, monkeypatch):
    monkeypatch.setattr(select, "SMALL_LIMIT", 5)
    monkeypatch.setattr(select, "LISTABLE", 20)
    df = spark.range(900).selectExpr("id", "case when id % 3 = 0 then 7 when id % 30 = 1 then null else id end as v")
    values = sorted((r["v"] is not None, r["v"] or 0) for r in df.collect())
    for n in (3, 20, 31, 100, 250, 400, 900):
        got = select.smallest(df, "v", n).collect()
        assert len({r["id"] for r in got}) == n
        assert sorted((r["v"] is not None, r["v"] or 0) for r in got) == values[:n]
    same = spark.range(50).selectExpr("1 as v")
    assert select.smallest(same, "v", 20).count() == 20


def test_selection_puts_nan_last(spark, monkeypatch):
    monkeypatch.setattr(select, "SMALL_LIMIT", 5)
    df = spark.range(60).selectExpr("id", "case when id % 3 = 0 then double('nan') else double(id) end as v")
    for n in (10, 40, 43, 50, 60, 70):
        got = [r["v"] for r in select.smallest(df, "v", n).collect()]
        assert len(got) == min(n, 60) and sum(v != v for v in got) == max(min(n, 60) - 40, 0)


def test_ties_are_taken_in_order_at_any_number(spark, monkeypatch):
    df = spark.range(400).selectExpr("id % 200 as k", "7 as v", "cast(id % 200 as string) as name").repartition(5)
    for limit in (1_000, 5):
        monkeypatch.setattr(select, "SMALL_LIMIT", limit)
        for n in (4, 150, 399):
            assert sorted(r["k"] for r in select.smallest(df, "v", n, ["k"]).collect()) == [i // 2 for i in range(n)]
            names = sorted(str(i // 2) for i in range(400))[:n]
            assert sorted(r["name"] for r in sampling.limit_rows(df, n, "name").collect()) == names
            assert sorted(r["k"] for r in sampling.limit_rows(df, n, "v", ["k"]).collect()) == [i // 2 for i in range(n)]
    assert select.first_rows(spark.range(3000).selectExpr("1 as v"), 2000, ["v"]).count() == 2000


def test_quantiles_of_wide_ranges_and_many_columns(spark, monkeypatch):
    monkeypatch.setattr(select, "LISTABLE", 50)
    wide = spark.range(2001).selectExpr("(id - 1000) * 1.7e305 as v", "if(id % 2 = 0, 5e-324, -5e-324) * id as tiny")
    got = select.quantiles(wide, ["v", "tiny"], [0.0, 0.25, 0.5, 1.0])
    assert got["v"] == [-1000 * 1.7e305, -500 * 1.7e305, 0.0, 1000 * 1.7e305]
    assert got["tiny"][0] == -1999 * 5e-324 and got["tiny"][-1] == 2000 * 5e-324
    many = spark.range(2000).selectExpr(*[f"double((id + {37 * i}) % 2000) as c{i}" for i in range(30)])
    assert all(x[1] == 999.5 for x in select.quantiles(many, many.columns, [0.25, 0.5, 0.75]).values())


def test_limit_rows(spark):
    df = spark.range(100).selectExpr("id", "cast(id as string) as name")
    assert [r[0] for r in sampling.limit_rows(df, 3, "id").collect()] == [0, 1, 2]
    assert {r[1] for r in sampling.limit_rows(df, 3, "name").collect()} == {"0", "1", "10"}


def test_folds_match_a_plain_ranking(spark):
    rows = [(i, "ab"[i % 3 == 0]) for i in range(500)] + [(1000 + i, None) for i in range(7)]
    df = spark.createDataFrame(rows, "id int, y string")
    for slices in (None, 4, 65_536):
        got = {r["id"]: r["fold"] for r in sampling.stratified_folds(df, "id", "y", k=10, slices=slices).collect()}
        expected = {}
        for label in ("a", "b", None):
            ids = [i for i, y in rows if y == label]
            ids.sort(key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))
            expected |= {i: n % 10 for n, i in enumerate(ids)}
        assert got == expected
    sizes = Counter((y, got[i]) for i, y in rows)
    assert max(n for (y, _), n in sizes.items() if y == "a") - min(n for (y, _), n in sizes.items() if y == "a") <= 1


def test_hash_folds_need_no_shuffle(spark):
    df = sampling.stratified_folds(spark.range(10).withColumnRenamed("id", "k"), "k", "k", exact=False)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["uniform", "skewed", "hot", "huge", "infinite"])
def test_order_statistics_against_sorting(spark, monkeypatch, kind):
    rng = np.random.default_rng(5)
    values = {
        "uniform": rng.random(3000),
        "skewed": np.exp(rng.normal(0, 12, 3000)),
        "hot": np.concatenate([np.full(1500, 0.25), rng.random(1500)]),
        "huge": rng.normal(0, 1, 3000) * 1e300,
        "infinite": np.concatenate([[np.inf] * 5, [-np.inf] * 7, rng.random(2000)]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
    monkeypatch.setattr(select, "LISTABLE", 20)
    monkeypatch.setattr(select, "SPLITS", 32)
    ranks = [0, 3, 700, 701, 1500, len(values) - 1, len(values)]
    expected = [*np.sort(values)[ranks[:-1]].tolist(), None]
    assert select.order_statistics(df, "x", ranks) == expected


def test_order_statistics_on_wide_integers(spark, monkeypatch):
    values = [-(2**63), -5, 0, 7, 2**63 - 1, 12, 13, 14, 99]
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    monkeypatch.setattr(select, "LISTABLE", 1)
    monkeypatch.setattr(select, "SPLITS", 4)
    assert select.order_statistics(df, "x", list(range(9))) == sorted(values)


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 10)], "x double")
    assert select.quantiles(df, "x", [0.0, 0.25, 0.5, 1.0])["x"] == pytest.approx([1.0, 1.75, 2.5, 10.0])
    assert select.quantiles(df.filter("x < 0"), "x", [0.5]) == {"x": [None]}


def test_quantiles_of_several_columns_share_their_passes(spark, monkeypatch):
    rng = np.random.default_rng(9)
    data = np.stack([rng.random(2000), rng.integers(0, 3, 2000), np.exp(rng.normal(0, 5, 2000))], axis=1)
    df = spark.createDataFrame([tuple(map(float, row)) for row in data], ["a", "b", "c"])
    monkeypatch.setattr(select, "LISTABLE", 30)
    monkeypatch.setattr(select, "SPLITS", 64)
    got = select.quantiles(df, ["a", "b", "c"], [0.25, 0.5, 0.9])
    for i, name in enumerate("abc"):
        assert got[name] == pytest.approx(np.quantile(data[:, i], [0.25, 0.5, 0.9]).tolist(), rel=1e-12)
