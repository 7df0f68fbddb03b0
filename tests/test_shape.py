import math

from pyspark.sql import functions as F

from packetloom.operators import shape


def test_null_and_unknown_labels_are_malicious(spark):
    df = spark.createDataFrame([("BENIGN",), (None,), ("DDoS",)], "label_unreg string")
    assert [r[0] for r in shape.binary_label(df, benign="BENIGN").collect()] == [0, 1, 1]


def test_label_column_is_dropped_on_request_only(spark):
    df = spark.createDataFrame([("normal", 1)], "label_unreg string, x int")
    assert shape.binary_label(df).columns == ["x", "label"]
    assert shape.binary_label(df, drop=False).columns == ["label_unreg", "x", "label"]


def test_sentinel_rows_go_and_null_labels_stay(spark):
    df = spark.createDataFrame([("BENIGN",), ("0",), (None,)], "` Label` string")
    assert [r[0] for r in shape.drop_unlabelled(df, " Label").collect()] == ["BENIGN", None]


def test_fill_zero_covers_nan_and_leaves_strings(spark):
    df = spark.createDataFrame(
        [(None, None, None), (float("nan"), 2, "a")], "x double, n int, ` Label` string"
    )
    filled = shape.fill_zero(df)
    assert [tuple(r) for r in filled.collect()] == [(0.0, 0, None), (0.0, 2, "a")]
    assert filled.dtypes == df.dtypes


def test_fill_zero_on_chosen_columns(spark):
    df = spark.createDataFrame([(None, None)], "x double, y double")
    assert tuple(shape.fill_zero(df, ["x"]).first()) == (0.0, None)


def test_shape_ignores_missing_and_keeps_spec_order(spark):
    df = spark.createDataFrame([(1, 2.0, "a")], "` Source Port` int, `Flow Bytes/s` double, extra string")
    spec = {
        "Flow Bytes/s": {"col_name": "rate", "transform": "`Flow Bytes/s` * 10"},
        "absent": {"col_name": "nothing"},
        " Source Port": "",
    }
    plain = shape.shape(df, spec)
    assert plain.columns == ["Flow Bytes/s", " Source Port"]
    assert tuple(plain.first()) == (20.0, 1)
    assert shape.shape(df, spec, rename=True).columns == ["rate", " Source Port"]


def test_select_features_with_awkward_names(spark):
    df = spark.createDataFrame([("BENIGN", 1, 2)], "` Label` string, `a.b` int, c int")
    assert shape.select_features(df, " Label", ["a.b"]).columns == ["label_unreg", "a.b"]


def test_filter_rows(spark):
    df = spark.createDataFrame([("abstract", 12), ("abstract", 3), ("dom", 12)], "hostname string, hour int")
    assert shape.filter_rows(df, "hostname = 'abstract' AND hour = 12").count() == 1


def test_flag_is_strict_and_never_null(spark):
    df = spark.createDataFrame([(0.5,), (0.50001,), (None,), (math.nan,)], "s double")
    assert [r[1] for r in shape.flag(df, "s", 0.5).collect()] == [0, 1, 0, 0]


def test_with_score_keeps_rows(spark):
    df = spark.createDataFrame([(1, "x")], "k int, label string")
    assert tuple(shape.with_score(df, "s", F.lit(0.25)).first()) == (1, "x", 0.25)
