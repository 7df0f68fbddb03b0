import random

import pytest
from pyspark.sql import functions as F

from packetloom.plans import ensemble, formats
from packetloom.plans.ensemble import EnsembleFormat, EnsembleModel
from packetloom.streaming.scoring import read_parquet_stream, score_batches, score_stream, write_parquet_stream

LAYOUT = EnsembleFormat()
SCORES = [LAYOUT.anomaly, LAYOUT.malicious, LAYOUT.combined]


@pytest.fixture(scope="module")
def flows(spark, tmp_path_factory):
    rng = random.Random(12)
    rows = []
    for i in range(300):
        bad = rng.random() < 0.4
        values = [rng.random() + (0.5 if bad else 0.0) for _ in formats.ENSEMBLE_FEATURES]
        if i % 50 == 0:
            values[1] = None
        label = ("0" if i % 20 == 0 else None if i % 33 == 0 else "DDoS") if bad else "BENIGN"
        rows.append((i, *values, label))
    columns = ["id", *formats.ENSEMBLE_FEATURES, " Label"]
    kinds = {"id": "int", " Label": "string"}
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` {kinds.get(c, 'double')}" for c in columns))
    path = str(tmp_path_factory.mktemp("flows") / "in")
    df.repartition(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def model(flows):
    return ensemble.ensemble_fit(flows, max_iter=30)


def test_scores_span_the_unit_interval_and_rows_ride_along(flows, model):
    scored = ensemble.ensemble_score(model, flows)
    assert scored.columns == [*flows.columns, *SCORES]
    assert {r[0] for r in scored.select("id").collect()} == set(range(300))
    for c in SCORES:
        assert tuple(scored.agg(F.min(c), F.max(c)).first()) == (0.0, 1.0)
    # raw features stay, nulls filled
    assert scored.filter("id = 50").first()[formats.ENSEMBLE_FEATURES[1]] == 0.0


def test_stored_stages_give_the_same_scores(flows, model):
    plain = ensemble.ensemble_score(model, flows).orderBy("id").select(*SCORES).collect()
    kept = ensemble.ensemble_score(model, flows, keep_stages=True).orderBy("id").select(*SCORES).collect()
    for a, b in zip(plain, kept, strict=True):
        assert tuple(a) == pytest.approx(tuple(b), abs=1e-12)


def test_labelled_only_drops_the_sentinel_and_keeps_null_labels(flows, model):
    scored = ensemble.ensemble_score(model, flows, labelled_only=True)
    expected = {r["id"] for r in flows.collect() if r[" Label"] != "0"}
    assert {r["id"] for r in scored.collect()} == expected
    assert tuple(scored.agg(F.min(LAYOUT.malicious), F.max(LAYOUT.malicious)).first()) == (0.0, 1.0)


def test_known_score_ranges_match_a_measured_pass(flows, model):
    from packetloom.operators.mlp import score_mlp

    scored = ensemble.ensemble_score(model, flows)
    direct = score_mlp(model.malicious, scored.select(*flows.columns, LAYOUT.anomaly))
    pairs = scored.select("id", F.col(LAYOUT.malicious).alias("a")).join(
        direct.select("id", F.col(LAYOUT.malicious).alias("b")), "id"
    )
    assert pairs.agg(F.max(F.abs(F.col("a") - F.col("b")))).first()[0] < 1e-12


def test_training_batch_scores_the_same_with_saved_bounds(flows, model):
    labelled = flows.filter("` Label` is null or ` Label` <> '0'")
    saved = ensemble.ensemble_score(model, labelled, bounds="saved")
    assert saved.count() == labelled.count()
    plan = saved._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    with pytest.raises(ValueError):
        ensemble.ensemble_score(model, flows, bounds="other")


def test_reports(flows, model):
    scored = ensemble.ensemble_score(model, flows, labelled_only=True)
    report = ensemble.ensemble_report(scored, LAYOUT).first()
    assert report["total"] == scored.count() and report["accuracy"] > 0.7
    stage = ensemble.stage_report(scored, LAYOUT, LAYOUT.anomaly).first()
    assert stage["tn"] + stage["fp"] + stage["fn"] + stage["tp"] == scored.count()


def test_save_and_load(spark, flows, model, tmp_path):
    model.save(spark, str(tmp_path / "m"))
    model.save(spark, str(tmp_path / "m"))
    again = EnsembleModel.load(spark, str(tmp_path / "m"))
    assert again.layout == model.layout
    for bounds in ("batch", "saved"):
        first = ensemble.ensemble_score(model, flows, bounds=bounds).orderBy("id").collect()
        assert first == ensemble.ensemble_score(again, flows, bounds=bounds).orderBy("id").collect()


def test_conv_ensemble(spark, flows, tmp_path):
    fitted = ensemble.ensemble_fit(flows, method="conv1d", max_iter=10, epochs=3, filters=8)
    fitted.save(spark, str(tmp_path / "m"))
    again = EnsembleModel.load(spark, str(tmp_path / "m"))
    assert ensemble.ensemble_score(again, flows).filter(f"{LAYOUT.combined} between 0 and 1").count() == 300


def test_stream_scores_like_a_batch_with_saved_bounds(spark, flows, model, tmp_path):
    path = flows.inputFiles()[0].rsplit("/", 1)[0]
    stream = read_parquet_stream(spark, path, flows.schema)
    query = write_parquet_stream(score_stream(model, stream), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("id").select("id", *SCORES).collect()
    assert got == ensemble.ensemble_score(model, flows, bounds="saved").orderBy("id").select("id", *SCORES).collect()


def test_stream_batches_scale_by_their_own_ranges(spark, flows, model, tmp_path):
    path = flows.inputFiles()[0].rsplit("/", 1)[0]
    stream = read_parquet_stream(spark, path, flows.schema)
    assert score_batches(model, stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("id").select("id", *SCORES).collect()
    assert got == ensemble.ensemble_score(model, flows, bounds="batch").orderBy("id").select("id", *SCORES).collect()


def test_non_finite_features_count_as_zero(spark, flows):
    feature = LAYOUT.features[0]
    rows = flows.withColumn(feature, F.expr(f"case id % 3 when 0 then double('infinity') when 1 then double('nan') else cast(`{feature}` as double) end"))
    filled = flows.withColumn(feature, F.expr(f"if(id % 3 < 2, 0D, cast(`{feature}` as double))"))
    fitted = ensemble.ensemble_fit(rows, LAYOUT, max_iter=2, key="id")
    one, two = (ensemble.ensemble_score(fitted, d).orderBy("id").select("id", *SCORES).collect() for d in (rows, filled))
    assert one == two and len(one) == 300 and all(r[c] is not None for r in one for c in SCORES)
