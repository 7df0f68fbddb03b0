import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.functions.columns import logistic_score
from packetloom.operators import anomaly, conv, crossval, encode, evaluate, health, ids, mlp, stack
from packetloom.operators.scale import minmax
from packetloom.plans import formats
from packetloom.plans.detection import train_connections, train_flows
from packetloom.plans.host_health import train_host_health
from packetloom.sources.models import load_model, save_model


def toy(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        cat, x, z = rng.choice("abc"), rng.random(), rng.gauss(0, 1)
        y = int(rng.random() < {"a": 0.2, "b": 0.5, "c": 0.8}[cat] * (0.5 + x / 2))
        rows.append((i, cat, x, z, y))
    return spark.createDataFrame(rows, "id int, cat string, x double, z double, label int").repartition(3)


def test_index_orders_by_frequency_then_name(spark):
    df = spark.createDataFrame([(c,) for c in "bacccd"], "c string")
    model = encode.string_index(["c"]).fit(df)
    assert list(model.labelsArray[0]) == ["c", "a", "b", "d"]


def test_unseen_category_is_an_error_unless_kept(spark):
    train = toy(spark)
    new = spark.createDataFrame([("zzz", 0.5)], "cat string, x double")
    strict = ids.fit_ids(train, "label", ["cat"], ["x"])
    with pytest.raises(Exception, match="Unseen label"):
        ids.score(strict, new).collect()
    kept = ids.fit_ids(train, "label", ["cat"], ["x"], handle_invalid="keep")
    assert ids.score(kept, new).count() == 1
    assert len(ids.score(kept, new).collect()) == 1


def test_null_feature_is_an_error(spark):
    model = ids.fit_ids(toy(spark), "label", [], ["x"])
    with pytest.raises(Exception, match="(?i)null"):
        ids.score(model, spark.createDataFrame([(None,)], "x double")).collect()


def test_saturated_fit_gives_group_means(spark):
    df = toy(spark)
    scored = ids.probability_of_one(ids.score(ids.fit_ids(df, "label", ["cat"], []), df))
    for row in scored.groupBy("cat").agg(F.avg("score").alias("p"), F.avg("label").alias("m")).collect():
        assert row["p"] == pytest.approx(row["m"], abs=1e-5)


def test_many_categories_are_hashed(spark):
    df = toy(spark)
    model = ids.fit_ids(df, "label", ["cat"], ["x"], "keep", "hash", num_hashed=32)
    assert len(model.stages) == 3 and model.stages[-1].numFeatures == 33
    with pytest.raises(ValueError):
        ids.fit_ids(df, "label", ["cat"], ["x"], encoding="hash")
    with pytest.raises(ValueError):
        ids.fit_ids(df, "label", ["cat"], ["x"], encoding="none")


def test_saved_model_scores_the_same(spark, tmp_path):
    df = toy(spark)
    model = ids.fit_ids(df, "label", ["cat"], ["x", "z"])
    save_model(model, str(tmp_path / "m"))
    save_model(model, str(tmp_path / "m"))
    again = load_model(str(tmp_path / "m"))
    first = ids.probability_of_one(ids.score(model, df)).orderBy("id").select("score").collect()
    assert first == ids.probability_of_one(ids.score(again, df)).orderBy("id").select("score").collect()


def test_scoring_is_one_map_stage(spark, small):
    df = spark.read.parquet(f"{small}/lineitem.parquet").selectExpr("l_linestatus as cat", "l_tax as x", "l_linenumber % 2 as label")
    plan = ids.score(ids.fit_ids(df, "label", ["cat"], ["x"]), df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_timed_score(spark):
    df = toy(spark)
    row = ids.timed_score(ids.fit_ids(df, "label", [], ["x"]), df).first()
    assert row["rows"] == 400 and row["seconds"] > 0
    assert row["seconds_per_row"] == pytest.approx(row["seconds"] / 400)


def test_logistic_literal(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    value = df.select(logistic_score(["a", "b"], [0.5, -1.0], 0.25)).first()[0]
    assert value == pytest.approx(1 / (1 + math.exp(-(0.25 + 0.5 - 2.0))))


def connection_rows(spark, n=300):
    rng = random.Random(4)
    columns = [formats.CONNECTION_LABEL, "record_id", *formats.CONNECTION_ORDER]
    rows = []
    for i in range(n):
        bad = rng.random() < 0.4
        row = {c: rng.randint(0, 5) for c in formats.CONNECTION_ORDER}
        row["protocol_type"] = rng.choice(["tcp", "udp"])
        row["service"] = rng.choice(["http", "ftp", "dns"])
        row["flag"] = "S0" if bad and rng.random() < 0.7 else "SF"
        row[formats.CONNECTION_LABEL] = ("smurf" if rng.random() < 0.9 else None) if bad else "normal"
        row["record_id"] = i
        rows.append(tuple(row[c] for c in columns))
    kinds = {c: "string" for c in [formats.CONNECTION_LABEL, *formats.CONNECTION_CATEGORICAL]}
    return spark.createDataFrame(rows, ", ".join(f"`{c}` {kinds.get(c, 'int')}" for c in columns))


def test_connection_records_end_to_end(spark):
    run = train_connections(connection_rows(spark), "record_id")
    assert run.accuracy().first()[0] > 0.6
    assert sum(r["n"] for r in run.confusion().collect()) == run.scored.count()
    inputs = run.model.stages[2].getInputCols()
    assert inputs[:5] == ["duration", "protocol_type_vec", "service_vec", "flag_vec", "src_bytes"]
    assert len(inputs) == 21


def test_flow_records_end_to_end(spark):
    rng = random.Random(8)
    columns = [" Label", "record_id", *formats.FLOW_ORDER]
    rows = []
    for i in range(200):
        bad = rng.random() < 0.5
        row = {c: rng.random() + bad * 0.3 for c in formats.FLOW_ORDER}
        row[" Source IP"], row[" Destination IP"] = f"10.0.0.{i}", f"10.0.1.{rng.randint(0, 9)}"
        row[" Label"], row["record_id"] = "DDoS" if bad else "BENIGN", i
        rows.append(tuple(row[c] for c in columns))
    kinds = {c: "string" for c in [" Label", *formats.FLOW_CATEGORICAL]} | {"record_id": "int"}
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in columns))
    df = df.withColumn("Flow Bytes/s", F.when(F.col("record_id") % 7 == 0, float("inf")).when(F.col("record_id") % 7 == 1, float("nan")).otherwise(F.col("`Flow Bytes/s`")))
    run = train_flows(df, "record_id", encoding="index")  # every source address in the test part is unseen
    assert sum(r["n"] for r in run.confusion().collect()) == run.scored.count() > 0
    hashed = train_flows(df, "record_id", encoding="hash", num_hashed=64)
    assert hashed.accuracy().first()[0] > 0.5


def test_host_health(spark):
    rng = np.random.default_rng(2)
    rows = [(f"h{i % 2}", int(i % 24), *map(float, rng.random(2))) for i in range(200)]
    df = spark.createDataFrame(rows, "hostname string, hour int, memutil double, netutil double")
    df = df.withColumn("load", F.lit(1.0) + F.col("hour") * 0.5 - F.col("memutil") * 2)
    model, scored, report = train_host_health(df, predicate="hostname = 'h1'")
    weights = health.coefficients(model, formats.HOST_FEATURES)
    assert weights["intercept"] == pytest.approx(1.0) and weights["memutil"] == pytest.approx(-2.0)
    assert report.first()["n"] == 100 and report.first()["r2"] == pytest.approx(1.0)
    assert scored.agg(F.max(F.abs("residual"))).first()[0] < 1e-9
    _, _, other = train_host_health(df, label="memutil", features=["hour", "load", "netutil"])
    assert other.first()["r2"] == pytest.approx(1.0)


def test_stack_meets_the_optimality_conditions(spark):
    rng = random.Random(6)
    rows = [(rng.random(), rng.random()) for _ in range(600)]
    rows = [(a, b, int(rng.random() < 1 / (1 + math.exp(-(4 * a - 2))))) for a, b in rows]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    fitted = stack.fit_stack(df, ["a", "b"], "y", max_iter=500)
    logistic = fitted.model.stages[-1]
    w = np.array(logistic.coefficients)
    x = np.array([(r[0], r[1]) for r in minmax(df, ["a", "b"]).collect()])
    y = np.array([r[2] for r in rows])
    error = 1 / (1 + np.exp(-(x @ w + logistic.intercept))) - y
    smooth = (x * error[:, None]).mean(axis=0) + 2 * stack.L2 * w
    assert abs(error.mean()) < 1e-3
    for slope, weight in zip(smooth, w):
        if weight:
            assert slope == pytest.approx(-stack.L1 * np.sign(weight), abs=1e-3)
        else:
            assert abs(slope) <= stack.L1 + 1e-3


def test_uninformative_stack_is_constant(spark):
    df = spark.createDataFrame([(0.0, 1.0, 0), (0.0, 1.0, 1), (1.0, 0.0, 0), (1.0, 0.0, 1)], "a double, b double, y int")
    scored = stack.score_stack(stack.fit_stack(df, ["a", "b"], "y"), df)
    assert [r["combined_score"] for r in scored.collect()] == [0.0] * 4


def test_perceptron_beats_the_constant_model(spark):
    df = toy(spark).withColumn("label", F.expr("int((x + z / 4 > 0.5) <> (id % 10 = 0))"))
    scorer = mlp.fit_mlp(df, ["x", "z"], "label", epochs=20, key="id")
    report = evaluate.train_report(mlp.raw_probability(scorer, df, "p"), "label", "p").first()
    share = df.agg(F.avg("label")).first()[0]
    assert report["loss"] < -(share * math.log(share) + (1 - share) * math.log(1 - share))
    scored = mlp.score_mlp(scorer, df)
    assert scored.columns == [*df.columns, "malicious_score"]
    assert tuple(scored.agg(F.min("malicious_score"), F.max("malicious_score"), F.count("*")).first()) == (0.0, 1.0, 400)


def reference_distance(x, k):
    x = (x - x.min(0)) / (x.max(0) - x.min(0))
    z = x - x.mean(0)
    _, vectors = np.linalg.eigh(np.cov(z.T))
    axes = vectors[:, -k:]
    return np.linalg.norm(z - z @ axes @ axes.T, axis=1)


@pytest.mark.parametrize("width", [3, 20])
def test_linear_reconstruction(spark, width):
    rng = np.random.default_rng(width)
    x = rng.normal(size=(120, width)) @ rng.normal(size=(width, width))
    cols = [f" c{i}/s" for i in range(width)]
    df = spark.createDataFrame([(i, *map(float, row)) for i, row in enumerate(x)], ["id", *cols])
    model = anomaly.fit_anomaly(df, cols, k=2)
    got = [r["d"] for r in model.distance(df, "d").orderBy("id").collect()]
    expected = reference_distance(x, 2)
    assert got == pytest.approx(expected.tolist(), abs=1e-8)
    scored = [r[0] for r in anomaly.anomaly_score(model, df).orderBy("id").select("anomaly_score").collect()]
    assert scored == pytest.approx(((expected - expected.min()) / (expected.max() - expected.min())).tolist(), abs=1e-7)


def test_conv_gradient_matches_differences():
    rng = np.random.default_rng(0)
    x = rng.random((40, 5))
    weights = conv.Weights.start(5, 8, 5, 3)
    flat = weights.flat()
    grad, _ = weights.gradient(x)
    for i in range(0, flat.size, 7):
        up, down = flat.copy(), flat.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        slope = (weights.like(up).gradient(x)[1] - weights.like(down).gradient(x)[1]) / 2e-6
        assert grad[i] == pytest.approx(slope, abs=1e-4)


def test_conv_output_against_a_direct_loop():
    weights = conv.Weights.start(5, 4, 5, 9)
    x = np.random.default_rng(1).random((3, 5))
    for row, rebuilt in zip(x, weights.rebuild(x)):
        padded = np.concatenate([[0, 0], row, [0, 0]])
        responses = [
            [max(0.0, sum(padded[t + d] * weights.conv[d, f] for d in range(5)) + weights.conv_bias[f]) for f in range(4)]
            for t in range(5)
        ]
        pooled = np.max(responses, axis=0)
        assert rebuilt == pytest.approx((pooled @ weights.dense + weights.dense_bias).tolist())


def test_network_has_the_expected_size():
    assert conv.Weights.start(5, conv.FILTERS, conv.WIDTH, 0).flat().size == 2821


def test_conv_training_lowers_the_loss_and_saves(spark, tmp_path):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, *map(float, rng.random(5))) for i in range(300)], ["id", *"abcde"]).repartition(3)
    model = anomaly.fit_anomaly(df, list("abcde"), method="conv1d", key="id", epochs=4, filters=16, batch_rows=100)
    losses = [loss for loss, _ in model.history]
    assert len(losses) == 4 and losses == sorted(losses, reverse=True) and losses[-1] < losses[0]
    assert all(held is not None for _, held in model.history)
    # the partitioning does not matter beyond rounding
    other = anomaly.fit_anomaly(df.coalesce(1), list("abcde"), method="conv1d", key="id", epochs=4, filters=16, batch_rows=100)
    assert other.history[-1][0] == pytest.approx(losses[-1], rel=1e-4)
    save_model(model, str(tmp_path / "conv"), spark)
    again = load_model(str(tmp_path / "conv"), conv.ConvReconstruction, spark)
    first = anomaly.anomaly_score(model, df).orderBy("id").collect()
    assert first == anomaly.anomaly_score(again, df).orderBy("id").collect()
    assert min(r["anomaly_score"] for r in first) == 0.0 and max(r["anomaly_score"] for r in first) == 1.0


def test_unknown_anomaly_method(spark):
    with pytest.raises(ValueError):
        anomaly.fit_anomaly(spark.range(3), ["id"], method="forest")


def test_cross_validation(spark):
    from packetloom.operators.sampling import stratified_folds

    folds = stratified_folds(toy(spark), "id", "label", k=4)
    fit, score = crossval.standardized_mlp(["x", "z"], "label", hidden=3, max_iter=10)
    result = crossval.cross_validate(folds, "fold", 4, fit, score, "label")
    values = [r["accuracy"] for r in result.orderBy("fold").collect()]
    assert len(values) == 4 and all(0.3 < v <= 1 for v in values)
    row = crossval.summarize_folds(result).first()
    assert row["mean_accuracy"] == pytest.approx(np.mean(values)) and row["sd_accuracy"] == pytest.approx(np.std(values))
