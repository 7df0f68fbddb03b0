"""The fit by slices against Spark's own: weights, scores, odd rows; what the driver gets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.operators import ids, sliced_logistic
from packetloom.operators.sliced_logistic import SearchFailed, SlicedModel, wolfe_step
from packetloom.sources.models import load_model, save_model


@pytest.fixture(scope="module")
def rows(spark):
    """A hot address, many seldom ones and nulls; labels that lean on addresses and numbers."""
    rng = np.random.default_rng(7)
    hot = rng.random(1500) < 0.3
    a = np.where(hot, 0, rng.integers(1, 120, 1500))
    x, z, lean = rng.normal(2, 3, 1500), rng.random(1500) * 1e3, rng.normal(0, 1, 120)
    y = rng.random(1500) < 1 / (1 + np.exp(-(lean[a] + 0.3 * x - 0.8)))
    data = [(i, None if i % 50 == 0 else f"a{a[i]}", f"b{i * 7 % 9}", float(x[i]), float(z[i]), 1.0, int(y[i])) for i in range(1500)]
    return spark.createDataFrame(data, "id long, a string, b string, x double, z double, one double, y int").repartition(5).persist()


def fits(rows, monkeypatch, **settings):
    """Spark's own fit and the one by slices."""
    own = ids.fit_ids(rows, "y", ["a", "b"], ["x", "z", "one"], "keep", "table", order=["a", "x", "b", "z", "one"], **settings)
    monkeypatch.setattr(ids, "MOST_SLOTS", 50)
    monkeypatch.setattr(sliced_logistic, "SLICE_SLOTS", 13)
    monkeypatch.setattr(sliced_logistic, "PIECE", 256)
    return own, ids.fit_ids(rows, "y", ["a", "b"], ["x", "z", "one"], "keep", "table", order=["a", "x", "b", "z", "one"], **settings)


def scores(model, df):
    return {r["id"]: (r["score"], r["prediction"]) for r in ids.probability_of_one(ids.score(model, df)).select("id", "score", "prediction").collect()}


@pytest.mark.parametrize("steps", [3, 25])
def test_equals_the_fit_on_the_driver(spark, rows, monkeypatch, tmp_path, steps):
    own, sliced = fits(rows, monkeypatch, maxIter=steps)
    assert isinstance(sliced, SlicedModel) and not isinstance(own, SlicedModel)
    new = spark.createDataFrame([(5000 + i, a, "b1", 1.0, 10.0, 1.0, 0) for i, a in enumerate(["a3", "never", None])], rows.schema)
    more = rows.unionByName(new)
    one, two = scores(own, more), scores(sliced, more)
    assert one.keys() == two.keys()
    assert max(abs(one[i][0] - two[i][0]) for i in one) < 1e-6
    assert all(one[i][1] == two[i][1] for i in one if abs(one[i][0] - 0.5) > 1e-6)
    assert sliced.numeric["one"] == 0.0 and sliced.unseen.keys() == {"a"}
    save_model(sliced, str(tmp_path / "m"), spark)
    assert scores(load_model(str(tmp_path / "m"), SlicedModel, spark), more) == two


def test_the_driver_gets_products_alone(rows, monkeypatch):
    """Results of jobs don't grow with the addresses: from the slices come numbers, one record a slice."""
    seen = []
    plain = sliced_logistic._Fit.evaluate

    def evaluate(self, *args):
        out = plain(self, *args)
        seen.append((self.slots, [np.size(v) for v in out[:4]]))
        return out

    monkeypatch.setattr(sliced_logistic._Fit, "evaluate", evaluate)
    _, sliced = fits(rows, monkeypatch, maxIter=2)
    assert seen and all(slots > 100 and sizes == [1, 3, 1, 1] for slots, sizes in seen)
    assert sum(np.size(v) for v in (*sliced.numeric.values(), *sliced.unseen.values(), sliced.intercept)) == 5


def test_regularised_fits_and_few_slots_stay_with_sparks_own(rows, monkeypatch):
    own, other = fits(rows, monkeypatch, maxIter=2, regParam=0.1)
    assert not isinstance(own, SlicedModel) and not isinstance(other, SlicedModel)


def test_one_class_and_faulty_rows(spark, rows, monkeypatch):
    monkeypatch.setattr(ids, "MOST_SLOTS", -1)
    ones = ids.fit_ids(rows.withColumn("y", F.lit(1)), "y", ["a"], ["x"], "keep", "table")
    assert ones.intercept == float("inf") and {r["prediction"] for r in ones.transform(rows).select("prediction").collect()} == {1.0}
    for faulty in (rows.withColumn("x", F.when(F.col("id") != 7, F.col("x"))), rows.withColumn("y", F.col("y") + 1)):
        with pytest.raises(Exception, match="fill first|labels must be 0 or 1"):
            ids.fit_ids(faulty, "y", ["a"], ["x"], "keep", "table")
    with pytest.raises(ValueError, match="no rows"):
        ids.fit_ids(rows.limit(0), "y", ["a"], ["x"], "keep", "table")
    model = ids.fit_ids(rows, "y", ["a"], ["x"], "keep", "table", maxIter=1)
    with pytest.raises(Exception, match="fill first"):
        model.transform(rows.withColumn("x", F.lit(None).cast("double"))).select("prediction").collect()


def test_step_meets_the_wolfe_conditions():
    def f(t):
        return (t - 3) ** 4 - 5 * t, 4 * (t - 3) ** 3 - 5

    t = wolfe_step(f, f(0.0), 1.0)
    assert f(t)[0] <= f(0)[0] + 1e-4 * t * f(0)[1] and abs(f(t)[1]) <= 0.9 * abs(f(0)[1])
    t = wolfe_step(f, f(0.0), 9.0)
    assert f(t)[0] <= f(0)[0] + 1e-4 * t * f(0)[1] and abs(f(t)[1]) <= 0.9 * abs(f(0)[1])
    with pytest.raises(SearchFailed):
        wolfe_step(f, (0.0, 1.0), 1.0)
