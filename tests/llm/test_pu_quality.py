"""The prior, held-out accuracy without any negative label, and odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.llm import pu_quality
from packetloom.llm.common import WordHashes
from packetloom.llm.queries import QUERIES


def test_prior_of_a_known_mixture():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        p = rng.normal(2, 1, 4000)
        u = np.where(rng.random(8000) < share, rng.normal(2, 1, 8000), rng.normal(-2, 1, 8000))
        assert pu_quality.class_prior(p, u) == pytest.approx(share, abs=0.05)


def test_risk_separates_a_mixture():
    rng = np.random.default_rng(2)
    k = pu_quality.N_STATISTICS
    good, bad = rng.normal(1, 1, (6000, k)), rng.normal(-1, 1, (2000, k))
    model = pu_quality.fit(good[:2000], np.concatenate([good[2000:4000], bad[:1000]]))
    assert model.prior == pytest.approx(2 / 3, abs=0.08)
    assert (model.scores(good[4000:]) > 0.5).mean() > 0.97 and (model.scores(bad[1000:]) < 0.5).mean() > 0.97
    assert (pu_quality.fit(good[:0], good).scores(good[:3]) == 0.5).all()


def test_statistics_of_odd_texts():
    hashes = WordHashes()
    assert not pu_quality.statistics(b"", hashes).any() and not pu_quality.statistics(b" \n\t", hashes).any()
    for text in (b"a", b"\xff\xfe x", b"a " * 300_000, "日本 語".encode()):
        assert np.isfinite(pu_quality.statistics(text, hashes)).all()


def test_training_ignores_held_out_and_negative_labels(spark):
    rng = random.Random(3)
    texts = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(50)) for _ in range(80)) if i % 3 else "%%% &&& *** " * 20) for i in range(300)]
    docs = spark.createDataFrame([*texts, (None, "x y"), (900, None), texts[0], texts[1]], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    labels = [(i, int(i % 3 != 0)) for i in range(300)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    model = pu_quality.train(docs, frame([*labels, (None, 1), (5, None)]))
    other = pu_quality.train(docs, frame([(i, 1 - y if held(i) else y) for i, y in labels if y or held(i)]))
    assert np.array_equal(model.table, other.table) and model.prior == other.prior
    scores = pu_quality.score(docs, model)
    assert scores.count() == 304 and scores.where("score is null or score < 0 or score > 1").count() == 0
    kept = pu_quality.accepted(docs.withColumn("score", F.lit("x")), model)
    assert kept.columns == ["doc_id", "text", "score"]
    assert kept.count() == scores.where(f"score >= {pu_quality.ACCEPT}").count()
    assert pu_quality.score(docs.limit(0), model).count() == 0
    assert pu_quality.train(docs, frame(labels).limit(0)).scores(np.zeros((1, pu_quality.N_STATISTICS)))[0] == 0.5


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    made = QUERIES["op1_pu_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = ([r.score for r in made if r.quality == y] for y in (1, 0))
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for r in made)
    assert np.mean([g > b for g in good for b in bad]) > 0.97 and np.mean(np.array(good) >= 0.3) > 0.97
