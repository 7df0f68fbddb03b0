"""The shape of physical plans: what is read, and how often rows are shuffled."""

import re

from pyspark.sql import functions as F

from packetloom.operators import evaluate, sampling, scale, stats, threshold
from packetloom.plans.queries import QUERIES


def plan(df):
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("Initial Plan")[0]


def columns_read(text):
    return [set(re.findall(r"(\w+):", part)) for part in re.findall(r"ReadSchema: struct<([^>]*)>", text)]


def events(spark, small):
    return spark.read.parquet(f"{small}/events.parquet").withColumn("truth", F.expr("int(event_type = 'error')"))


def test_sweep_reads_two_columns_once(spark, small):
    text = plan(threshold.threshold_sweep(events(spark, small), "truth", "value"))
    assert columns_read(text) == [{"event_type", "value"}]
    assert "partial_count" in text
    assert text.count("UDF") + text.count("bucketizer") == 1


def test_confusion_reads_rows_once_and_counts_before_the_shuffle(spark, small):
    text = plan(evaluate.confusion(events(spark, small), "truth", "truth"))
    assert columns_read(text) == [{"event_type"}]
    assert "partial_count" in text and "Cartesian" not in text and "NestedLoop" not in text


def test_scaling_is_a_projection(spark, small):
    text = plan(scale.minmax(events(spark, small).select("event_id", "value"), ["value"]))
    assert "Exchange" not in text and "Join" not in text and columns_read(text) == [{"event_id", "value"}]


def test_splits_are_filters(spark, small):
    train, test = sampling.split(events(spark, small), "event_id")
    assert "Exchange" not in plan(train) and "Exchange" not in plan(test)


def test_folds_shuffle_the_rows_once(spark, small):
    text = plan(sampling.stratified_folds(events(spark, small), "event_id", "event_type", slices=8))
    rows_moved = [line for line in text.splitlines() if "Exchange hashpartitioning(__g" in line]
    assert len(rows_moved) == 3  # the rows, and two exchanges of the slice counts
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_large_sample_is_a_filter(spark, small, monkeypatch):
    from packetloom.operators import select

    monkeypatch.setattr(select, "SMALL_LIMIT", 5)
    text = plan(sampling.sample_exact(events(spark, small), "event_id", 0.5))
    assert "Exchange" not in text and "TakeOrdered" not in text


def test_statistics_come_from_one_scan(spark, small):
    text = plan(stats.covariance(events(spark, small), ["value", "user_id", "truth"]))
    assert columns_read(text) == [{"user_id", "event_type", "value"}]


def test_predicates_reach_the_scan(spark, small):
    text = plan(spark.read.parquet(f"{small}/events.parquet").filter("user_id = 3").select("value"))
    assert "EqualTo(user_id,3)" in text


def test_every_query_is_callable_and_named_plainly():
    assert len(QUERIES) > 60
    assert all(re.fullmatch(r"[a-z][a-z0-9_]*", name) for name in QUERIES)
