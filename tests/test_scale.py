import pytest

from packetloom.operators import scale


def test_constant_column_becomes_zero(spark):
    df = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "x double")
    assert [r[0] for r in scale.minmax(df, ["x"]).collect()] == [0.0, 0.0, 0.0]
    assert [r[0] for r in scale.standardize(df, ["x"]).collect()] == [0.0, 0.0, 0.0]


def test_minmax_spans_unit_interval_and_keeps_raw_with_suffix(spark):
    df = spark.createDataFrame([(1,), (3,), (2,)], "` a` int")
    out = scale.minmax(df, [" a"], suffix="_s")
    assert [tuple(r) for r in out.collect()] == [(1, 0.0), (3, 1.0), (2, 0.5)]


def test_null_stays_null(spark):
    df = spark.createDataFrame([(None,), (1.0,), (2.0,)], "x double")
    assert [r[0] for r in scale.minmax(df, ["x"]).collect()] == [None, 0.0, 1.0]


def test_saved_bounds_leave_the_unit_interval_unless_clamped(spark):
    df = spark.createDataFrame([(-1.0,), (3.0,)], "x double")
    bounds = {"x": (0.0, 2.0)}
    assert [r[0] for r in scale.minmax(df, ["x"], bounds).collect()] == [-0.5, 1.5]
    assert [r[0] for r in scale.minmax(df, ["x"], bounds, clamp=True).collect()] == [0.0, 1.0]


def test_standardize_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    assert [r[0] for r in scale.standardize(df, ["x"]).collect()] == pytest.approx([-1.0, 1.0])


def test_empty_frame(spark):
    df = spark.createDataFrame([], "x double")
    assert scale.minmax(df, ["x"]).collect() == []
    assert scale.standardize(df, ["x"]).collect() == []


def test_bounds_take_one_pass(spark):
    df = spark.range(10).selectExpr("id as a", "id * 2 as b")
    assert scale.fit_bounds(df, ["a", "b"]) == {"a": (0.0, 9.0), "b": (0.0, 18.0)}


def test_non_finite_values_leave_the_others_alone(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (2.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (None,)], "v double")
    assert [r[0] for r in scale.minmax(df, ["v"]).collect()] == [0.0, 1.0, 0.5, None, None, None, None]
    got = [r[0] for r in scale.standardize(df, ["v"]).collect()]
    assert got[2] == 0.0 and got[3:] == [None] * 4 and got[0] == -got[1]
