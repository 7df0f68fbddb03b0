import math
import random

import pytest

from packetloom.operators import evaluate, stats, threshold


def frame(spark, rows):
    return spark.createDataFrame(rows, "y int, s double")


def naive(rows, x):
    tn = sum(1 for y, s in rows if not y and not (s is not None and s > x))
    fp = sum(1 for y, s in rows if not y and s is not None and s > x)
    fn = sum(1 for y, s in rows if y and not (s is not None and s > x))
    tp = sum(1 for y, s in rows if y and s is not None and s > x)
    n = tn + fp + fn + tp
    accuracy, inverse = (tp + tn) / n, fn / n
    percent_fn = (100 - 100 * inverse) / 100
    out = {
        "tn": tn, "fp": fp, "fn": fn, "tp": tp, "total": n, "accuracy": accuracy, "fn_inverse": inverse,
        "percent_fn": percent_fn, "fn_to_accuracy": (accuracy + percent_fn) / 2,
        "weighted_fn_to_accuracy": (percent_fn * 2 + accuracy) / 3,
        "percent_detected": tp / (tp + fn) if tp + fn else None,
    }
    if tp + fn:
        out["weighted_detection_to_accuracy"] = (out["percent_detected"] + accuracy) / 2
        out["lambda"] = (out["weighted_detection_to_accuracy"] + out["weighted_fn_to_accuracy"]) / 2
    else:
        out["weighted_detection_to_accuracy"] = out["lambda"] = None
    return out


def test_confusion_classes(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (0, 1)], "y int, p int")
    assert [tuple(r) for r in evaluate.confusion(df, "y", "p", predicted_only=False).collect()] == [(0.0, 0.0, 2)]
    assert [tuple(r) for r in evaluate.confusion(df, "y", "p").collect()] == [(0.0, 0.0, 2), (0.0, 1.0, 1)]


def test_confusion_fills_absent_pairs(spark):
    df = spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "y int, p int")
    got = {(r[0], r[1]): r[2] for r in evaluate.confusion(df, "y", "p").collect()}
    assert len(got) == 9 and got[(0.0, 1.0)] == 1 and got[(2.0, 2.0)] == 0


def test_single_class_gives_four_counts(spark):
    row = evaluate.detection_stats(frame(spark, [(0, 0.1), (0, 0.2)]), "y", "s", 0.5).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (2, 0, 0, 0)
    assert row["percent_detected"] is None and row["lambda"] is None and row["accuracy"] == 1.0


def test_empty_frame_reports_nulls(spark):
    empty = frame(spark, [])
    row = evaluate.detection_stats(empty, "y", "s", 0.5).first()
    assert row["total"] == 0 and row["accuracy"] is None
    assert evaluate.mean_threshold_report(empty, "y", "s").first()["threshold"] is None
    assert threshold.threshold_sweep(empty, "y", "s").count() == 100
    best = threshold.best_threshold(threshold.threshold_sweep(empty, "y", "s")).first()
    assert (best["threshold"], best["value"]) == (0.0, 0.0)
    assert threshold.evaluate(empty, "y", "s").first()["threshold"] == 0.0


def test_grid_is_the_running_difference():
    grid = threshold.threshold_grid()
    assert len(grid) == 100 and grid[0] == 1.0
    assert grid[50] == 0.49999999999999956 and grid[-1] == 0.009999999999999247
    assert threshold.threshold_grid(0.0, 1.0, 0.25) == []


def test_every_row_counts(spark):
    df = spark.createDataFrame([(1, 1), (None, 1), (0, None), (None, None), (0, 0)], "y int, p int")
    row = evaluate.binary_counts(df, "y", "p").first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (2, 0, 1, 2)
    cells = {(r["actual"], r["predicted"]): r["n"] for r in evaluate.confusion(df.selectExpr("y", "coalesce(p, 7) as p"), "y", "p").collect()}
    assert sum(cells.values()) == 5 and cells[0.0, 7.0] == 1
    assert {p for _, p in ((r["actual"], r["predicted"]) for r in evaluate.confusion(df, "y", "p", predicted_only=False).collect())} == {0.0, 1.0}
    assert evaluate.multiclass_accuracy(df, "y", "p").first()[0] == 0.4


def test_sweep_equals_recounting_at_every_threshold(spark):
    rng = random.Random(3)
    grid = threshold.threshold_grid()
    rows = [(rng.randint(0, 1), rng.random()) for _ in range(400)]
    rows += [(1, x) for x in grid[::7]] + [(0, 1.0), (1, 0.0), (0, 0.0), (1, None), (0, None)]
    got = threshold.threshold_sweep(frame(spark, rows), "y", "s").collect()
    assert len(got) == 100
    for row in got:
        expected = naive(rows, row["threshold"])
        assert {k: row[k] for k in expected} == expected


def test_score_on_a_grid_point_is_not_flagged(spark):
    sweep = threshold.threshold_sweep(frame(spark, [(1, 1.0)]), "y", "s")
    assert sweep.filter("threshold = 1.0").first()["tp"] == 0
    assert sweep.filter("threshold < 1.0").agg({"tp": "min"}).first()[0] == 1


def test_nan_scores_are_never_flagged(spark):
    sweep = threshold.threshold_sweep(frame(spark, [(1, math.nan), (0, None)]), "y", "s")
    assert sweep.agg({"tp": "max"}).first()[0] == 0


@pytest.mark.parametrize("objective", sorted(threshold.OBJECTIVES))
def test_best_threshold_against_a_scan(spark, objective):
    rng = random.Random(11)
    rows = [(int(rng.random() < 0.3), round(rng.random(), 2)) for _ in range(300)]
    best, best_x = 0.0, 0.0
    for x in threshold.threshold_grid():
        value = naive(rows, x)[threshold.OBJECTIVES[objective]]
        if value is not None and value > best:
            best, best_x = value, x
    df = frame(spark, rows)
    row = threshold.best_threshold(threshold.threshold_sweep(df, "y", "s"), objective).first()
    assert (row["threshold"], row["value"]) == (best_x, best)
    report = threshold.evaluate(df, "y", "s", objective).first()
    assert (report["threshold"], report["value"]) == (best_x, best)
    assert report["tp"] == naive(rows, best_x)["tp"]


def test_ties_go_to_the_higher_threshold(spark):
    row = threshold.best_threshold(threshold.threshold_sweep(frame(spark, [(0, 0.0), (1, 1.0)]), "y", "s")).first()
    assert row["threshold"] == threshold.threshold_grid()[1]


def test_unknown_objective_is_refused(spark):
    sweep = threshold.threshold_sweep(frame(spark, [(1, 0.5)]), "y", "s")
    with pytest.raises(ValueError):
        threshold.best_threshold(sweep, "speed")
    with pytest.raises(ValueError):
        threshold.evaluate(frame(spark, [(1, 0.5)]), "y", "s", "speed")


def test_nothing_above_zero(spark):
    sweep = threshold.threshold_sweep(frame(spark, [(0, 0.5)]), "y", "s")
    row = threshold.best_threshold(sweep, "detection").first()
    assert (row["threshold"], row["value"]) == (0.0, 0.0)


def test_mean_threshold_is_strict(spark):
    row = evaluate.mean_threshold_report(frame(spark, [(1, 0.5), (0, 0.5)]), "y", "s").first()
    assert (row["tn"], row["fn"], row["tp"], row["missed_positive_rate"]) == (1, 1, 0, 0.5)


def test_regression_report(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.5)], "y double, p double")
    row = evaluate.regression_report(df, "y", "p").first()
    assert row["rmse"] == pytest.approx(math.sqrt(0.5 / 3))
    mean = 7 / 3
    assert row["r2"] == pytest.approx(1 - 0.5 / sum((v - mean) ** 2 for v in (1, 2, 4)))


def test_train_report_clips(spark):
    row = evaluate.train_report(frame(spark, [(1, 0.0), (0, 0.0), (1, 0.5)]), "y", "s").first()
    expected = -(math.log(1e-7) + math.log(1 - 1e-7) + math.log(0.5)) / 3
    assert row["loss"] == pytest.approx(expected) and row["accuracy"] == pytest.approx(1 / 3)


def test_describe_and_covariance(spark):
    df = spark.createDataFrame([(1.0, 2), (2.0, None), (4.0, 8), (math.nan, 5)], "a double, b int")
    got = {r["column"]: r for r in stats.describe(df).collect()}
    assert got["a"]["count"] == 3 and got["a"]["p50"] == 2.0 and got["a"]["max"] == 4.0
    assert got["b"]["count"] == 3 and got["b"]["mean"] == 5.0 and got["b"]["p25"] == 3.5
    approx = {r["column"]: r for r in stats.describe(df, exact=False).collect()}
    assert approx["a"]["p50"] == 2.0
    cov = {(r[0], r[1]): r[2] for r in stats.covariance(df).collect()}
    assert cov[("a", "b")] == cov[("b", "a")] == pytest.approx(9.0)
    assert cov[("b", "b")] == pytest.approx(9.0)


def test_quantile_threshold(spark):
    df = frame(spark, [(0, i / 100) for i in range(101)])
    assert stats.quantile_threshold(df, "s", 0.95) == pytest.approx(0.95)
    assert stats.quantile_threshold(df, "s", 0.95, exact=False) == pytest.approx(0.95)
