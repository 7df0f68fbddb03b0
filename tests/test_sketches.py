"""Stored sketches by day: moments equal the exact ones, quantiles lie within the stated rank error."""

import numpy as np
import pytest

from packetloom.operators import sketches, stats


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    values = [(int(i % 6), float(v), None if i % 10 else float(i)) for i, v in enumerate(rng.lognormal(0, 2, 20_000))]
    return spark.createDataFrame(values + [(1, float("nan"), None), (2, float("inf"), None), (3, None, None)], "day int, v double, w double").repartition(5).persist()


def test_merged_days_describe_the_whole(spark, rows, tmp_path):
    for day in range(6):  # a day at a time, as they arrive
        sketches.sketch_columns(rows.where(f"day = {day}"), ["v", "w"], ["day"]).write.mode("append").parquet(str(tmp_path / "s"))
    stored = spark.read.parquet(str(tmp_path / "s"))
    got = {r["column"]: r for r in sketches.describe_sketches(stored).collect()}
    exact = {r["column"]: r for r in stats.describe(rows.where("v is null or (v < double('infinity') and not isnan(v))"), ["v", "w"]).collect()}
    values = np.sort([r["v"] for r in rows.collect() if r["v"] is not None and np.isfinite(r["v"])])
    for c in ("v", "w"):
        for field in ("count", "mean", "std", "min", "max"):
            assert got[c][field] == pytest.approx(exact[c][field], rel=1e-9)
    for q, field in ((0.25, "p25"), (0.5, "p50"), (0.75, "p75")):
        assert abs(np.searchsorted(values, got["v"][field]) / len(values) - q) <= sketches.rank_error()
    threshold = sketches.sketch_threshold(stored, "v", 0.95)
    assert abs(np.searchsorted(values, threshold) / len(values) - 0.95) <= sketches.rank_error()
    by_day = sketches.describe_sketches(stored, ["day"])
    assert by_day.count() == 9 and by_day.columns[0] == "day"


def test_nothing_to_sketch(spark, rows):
    empty = sketches.sketch_columns(rows.limit(0), ["v"])
    assert sketches.describe_sketches(empty).collect() == [] and sketches.sketch_threshold(empty, "v") is None
    one = sketches.describe_sketches(sketches.sketch_columns(spark.createDataFrame([(2.0,)], "v double"))).first()
    assert (one["count"], one["mean"], one["std"], one["p50"]) == (1, 2.0, None, 2.0)
