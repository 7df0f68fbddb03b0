"""The trainer, the ReLU perceptron and joint folds: gradients, equality with plain loops, odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.operators import conv, crossval, evaluate, ids, minibatch, mlp
from packetloom.operators.minibatch import Adam, train
from packetloom.sources.models import load_model, save_model


@pytest.fixture(scope="module")
def rows(spark):
    """A ring that no line can cut out."""
    rng = np.random.default_rng(0)
    data = [(i, float(x), float(z), int(0.15 < x * x + z * z < 0.6), i % 4) for i, (x, z) in enumerate(rng.uniform(-1, 1, (600, 2)))]
    return spark.createDataFrame(data, "id long, x double, z double, label int, fold int").repartition(3).persist()


def test_perceptron_gradient_matches_differences():
    rng = np.random.default_rng(1)
    x, y = rng.random((50, 6)), (rng.random(50) > 0.5).astype(float)
    start = mlp.Perceptron.start(6)
    assert start.flat().size == 81
    flat = start.flat() + 0.1 * rng.normal(size=81)
    grad, loss = start.like(flat).gradient(x, y)
    assert loss == pytest.approx(start.like(flat).loss(x, y))
    for i in range(81):
        step = np.zeros(81)
        step[i] = 1e-6
        slope = (start.like(flat + step).loss(x, y) - start.like(flat - step).loss(x, y)) / 2e-6
        assert grad[i] == pytest.approx(slope, abs=1e-5)


def test_loss_against_plain_formula():
    w = mlp.Perceptron(np.array([[1.0, -1.0]]), np.array([0.0, 0.5]), np.array([2.0, -1.0]), np.array([0.25]))
    p = 1 / (1 + math.exp(-(2 * 0.75 - 1 * 0.0 + 0.25)))
    assert w.loss(np.array([[0.75]]), np.array([1.0])) == pytest.approx(-math.log(p))
    assert w.loss(np.array([[0.75]]), np.array([0.0])) == pytest.approx(-math.log(1 - p))


def test_one_batch_is_one_step_of_adam(spark, rows):
    """One epoch in one batch moves the weights by the gradient of all rows; loss and rows are those of the table."""
    start = mlp.Perceptron.start(2, 4, seed=3)
    (got,), (history,) = train(rows, [F.col("x"), F.col("z")], F.col("label"), [start], "id", batches=1, epochs=1, rate=0.1)
    data = np.array([tuple(r) for r in rows.select("x", "z", "label").collect()])
    grad, loss = start.gradient(data[:, :2].astype(np.float32), data[:, 2])
    assert got.flat() == pytest.approx(Adam(grad.size, 0.1).moved(start.flat(), grad / 600), abs=1e-5)
    assert history == [(pytest.approx(loss / 600, rel=1e-5), None)]


def test_an_epoch_reads_every_row_once(spark, rows):
    class Counter:
        """Counts rows in its only weight."""

        def __init__(self, n=0.0):
            self.n = n

        flat = lambda self: np.array([self.n])
        like = lambda self, flat: Counter(float(flat[0]))
        single = lambda self: self
        loss = lambda self, x, y: float(len(x))
        gradient = lambda self, x, y: (np.zeros(1), float(len(x)))

    odd = rows.union(spark.createDataFrame([(1000, None, 1.0, 1, 0), (1001, 1.0, 1.0, None, 0)], rows.schema))
    _, (history,) = train(odd, [F.col("x"), F.col("z")], F.col("label"), [Counter()], "id", batch_rows=70, epochs=3, held_out=0.2)
    assert [h[0] for h in history] == [1.0, 1.0, 1.0] and history[0][1] == 1.0
    _, folds = train(rows, [F.col("x")], F.col("label"), [Counter(), Counter()], None, batches=3, epochs=1, fold="fold")
    assert [h[0][0] for h in folds] == [1.0, 1.0]


def test_empty_table_leaves_the_weights(spark, rows):
    start = mlp.Perceptron.start(1)
    (got,), history = train(rows.limit(0), [F.col("x")], F.col("label"), [start], "id", epochs=2)
    assert got is start and history == [[]]


def test_partitions_do_not_matter_with_a_key(rows):
    fits = [mlp.fit_mlp(rows.repartition(n), ["x", "z"], "label", epochs=3, key="id").weights.flat() for n in (1, 5)]
    assert fits[0] == pytest.approx(fits[1], abs=1e-5)


def test_perceptron_beats_the_logistic_model(spark, rows, tmp_path):
    scorer = mlp.fit_mlp(rows, ["x", "z"], "label", key="id", held_out=0.2, rate=0.03)
    scored = mlp.raw_probability(scorer, rows, "p", scorer.bounds)
    line = ids.probability_of_one(ids.score(ids.fit_ids(rows, "label", [], ["x", "z"]), rows))
    ours = evaluate.train_report(scored, "label", "p").first()
    theirs = evaluate.train_report(line, "label", "score").first()
    assert ours["loss"] < 0.7 * theirs["loss"] and ours["accuracy"] > theirs["accuracy"]
    assert scorer.history[-1][1] < scorer.history[0][1]
    # scoring in the JVM equals the network in numpy
    x = np.array([[(r["x"] - scorer.bounds["x"][0]) / np.ptp(scorer.bounds["x"]), (r["z"] - scorer.bounds["z"][0]) / np.ptp(scorer.bounds["z"])] for r in scored.collect()])
    assert [r["p"] for r in scored.collect()] == pytest.approx((1 / (1 + np.exp(-scorer.weights.logit(x)))).tolist())
    save_model(scorer, str(tmp_path / "m"), spark)
    again = load_model(str(tmp_path / "m"), mlp.MaliciousScorer, spark)
    assert mlp.score_mlp(again, rows).orderBy("id").collect() == mlp.score_mlp(scorer, rows).orderBy("id").collect()


def test_missing_and_infinite_inputs_count_as_zero(spark, rows):
    odd = spark.createDataFrame([(2000, None, 0.5, 1, 0), (2001, float("nan"), 0.5, 0, 0), (2002, float("inf"), 0.5, 1, 0), (2003, 0.0, 0.5, 1, 0)], rows.schema)
    for fit, score in (
        (lambda d: mlp.fit_mlp(d, ["x", "z"], "label", epochs=2, key="id"), lambda m, d: mlp.raw_probability(m, d, "s", m.bounds)),
        (lambda d: conv.fit_conv1d(d, ["x", "z"], key="id", epochs=2, filters=4, batch_rows=200), lambda m, d: m.distance(d, "s", m.bounds)),
    ):
        model = fit(rows.union(odd))
        assert len({r["s"] for r in score(model, odd).collect()}) == 1


def test_joint_folds_equal_the_loop(spark, rows):
    got = {r["fold"]: r["accuracy"] for r in crossval.cross_validate_perceptron(rows, ["x", "z"], "label", "fold", 4, hidden=5, epochs=12, batches=3, key="id").collect()}
    for i in range(4):
        fit = rows.where(F.col("fold") != i)
        data = np.array([tuple(r) for r in fit.select("x", "z").collect()])
        network = crossval.Standardised(mlp.Perceptron.start(2, 5), data.mean(0), data.std(0))
        (alone,), _ = train(fit, [F.col("x"), F.col("z")], F.col("label"), [network], "id", batches=3, epochs=12, rate=mlp.RATE)
        held = np.array([tuple(r) for r in rows.where(F.col("fold") == i).select("x", "z", "label").collect()])
        assert got[i] == pytest.approx(((alone.logit(held[:, :2]) > 0) == (held[:, 2] > 0.5)).mean(), abs=0.02)


def test_fold_moments(rows):
    data = np.array([tuple(r) for r in rows.select("fold", "x", "z").collect()])
    for i, (mean, sd) in enumerate(crossval.fold_moments(rows, "fold", ["x", "z"], 4)):
        other = data[data[:, 0] != i, 1:]
        assert mean == pytest.approx(other.mean(0)) and sd == pytest.approx(other.std(0))


def test_folds_at_once_equal_each_alone():
    """One wide layer for all folds gives each network's gradient, loss and rows, also with unlike moments."""
    rng = np.random.default_rng(5)
    x, y, fold = rng.normal(3, 2, (700, 4)).astype(np.float32), (rng.random(700) > 0.5).astype(np.float32), rng.integers(0, 5, 700).astype(np.int32)
    networks = [crossval.Standardised(mlp.Perceptron.start(4, 6, seed=j), rng.normal(3, 1, 4), rng.uniform(0.5, 3, 4)) for j in range(5)]
    got = crossval.JointFolds(networks).sums(x, y, fold)
    for j, network in enumerate(networks):
        grad, loss = network.gradient(x[fold != j], y[fold != j])
        assert got[j] == pytest.approx(np.concatenate([grad, [loss, (fold != j).sum()]]), rel=1e-6, abs=1e-6)


def test_work_of_joint_folds_grows_with_their_number():
    """No unit is multiplied with the outer weights of other folds' networks; far outside the sigmoid sums stay finite."""

    def joint(k, scale=1.0):
        starts = [mlp.Perceptron.start(4, 6, seed=j) for j in range(k)]
        return [crossval.Standardised(s.like(s.flat() * scale), np.zeros(4), np.ones(4)) for s in starts]

    def numbers(k):
        return sum(a.size for a in vars(crossval.JointFolds(joint(k))).values() if isinstance(a, np.ndarray))

    assert numbers(20) <= 2 * numbers(10)
    rng = np.random.default_rng(6)
    x, y, fold = rng.normal(size=(50, 4)).astype(np.float32), np.tile([0, 1], 25).astype(np.float32), np.arange(50, dtype=np.int32) % 3
    networks = joint(3, 100.0)
    got = crossval.JointFolds(networks).sums(x, y, fold)
    for j, network in enumerate(networks):
        grad, loss = network.gradient(x[fold != j], y[fold != j])
        assert loss > 1000 and got[j] == pytest.approx(np.concatenate([grad, [loss, (fold != j).sum()]]), rel=1e-6, abs=1e-6)


@pytest.mark.parametrize("settings", [{"batches": 5}, {"batch_rows": 60, "held_out": 0.2}])
def test_a_step_reads_its_own_batch_alone(spark, rows, monkeypatch, settings):
    """A step's tasks are handed the blocks of the batch's lots and no others."""
    seen, others = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    plain = minibatch._sums

    def counted(networks, width, lots, *rest):
        run = plain(networks, width, lots, *rest)

        def through(blocks):
            for block in blocks:
                mine = block[0] < 0 if lots is None else block[0] in lots
                (seen if mine else others).add(1)
                yield block

        return lambda blocks: run(through(blocks))

    monkeypatch.setattr(minibatch, "_sums", counted)
    train(rows, [F.col("x"), F.col("z")], F.col("label"), [mlp.Perceptron.start(2)], "id", epochs=2, **settings)
    assert seen.value > 0 and others.value == 0


def test_small_batches_take_their_steps_where_they_lie(spark, rows, monkeypatch):
    """The weights of a plain loop over the same batches, one job a partition and epoch in place of one a step."""
    monkeypatch.setattr(minibatch, "TOUR_BYTES", 3000)
    context, start = spark.sparkContext, mlp.Perceptron.start(2, 4, seed=3)

    def fit(epochs):
        context.setJobGroup(f"tour{epochs}", "")
        (got,), (history,) = train(rows, [F.col("x"), F.col("z")], F.col("label"), [start], "id", batch_rows=50, epochs=epochs, rate=0.05)
        return got, history, len(context.statusTracker().getJobIdsForGroup(f"tour{epochs}"))

    (got, history, many), (_, _, few) = fit(4), fit(1)
    parts = -(-600 * 12 // 3000)
    assert many - few == 3 * parts
    place = F.pmod(F.xxhash64("id", F.lit(42)), F.lit(1 << 30)) / float(1 << 30)
    data = np.array([tuple(r) for r in rows.select(F.floor(place * 48), "x", "z", "label").collect()])
    network, adam, losses = start, Adam(start.flat().size, 0.05), []
    for epoch in range(4):
        rng, loss = np.random.default_rng((42, epoch)), 0.0
        for part in rng.permutation(parts):
            own = [lot for lot in range(48) if lot // 4 * parts // 12 == part]
            for batch in np.split(rng.permutation(own), len(own) // 4):
                at = np.isin(data[:, 0], batch)
                grad, error = network.gradient(data[at, 1:3].astype(np.float32), data[at, 3])
                network, loss = network.like(adam.moved(network.flat(), grad / at.sum())), loss + error
        losses.append(loss / 600)
    assert got.flat() == pytest.approx(network.flat(), abs=1e-5)
    assert [h[0] for h in history] == pytest.approx(losses, rel=1e-5)


def test_a_filter_learns_from_the_first_of_equal_positions():
    """Rows of equal values give equal responses at several positions; one of them takes the gradient, the first."""
    start = conv.Weights.start(6, 7, 3, 2)
    x = np.vstack([np.zeros((2, 6)), np.full((2, 6), 0.5), np.random.default_rng(4).random((300, 6))])
    start.conv_bias += 0.3
    grad, loss = start.gradient(x)
    hidden, dense = np.zeros(start.conv.shape), np.zeros(start.dense.shape)
    bias, total = np.zeros(7), 0.0
    for row in x:
        windows = np.array([np.concatenate([[0.0], row, [0.0]])[p : p + 3] for p in range(6)])
        response = windows @ start.conv
        first, pooled = response.argmax(axis=0), np.maximum(response.max(axis=0) + start.conv_bias, 0.0)
        error = pooled @ start.dense + start.dense_bias - row
        back = (start.dense @ error) * (pooled > 0)
        for f in range(7):
            hidden[:, f] += back[f] * windows[first[f], :]
        bias += back
        dense += np.outer(pooled, error)
        total += (error**2).sum()
    assert loss == pytest.approx(total) and start.loss(x) == pytest.approx(total)
    parts = start.like(grad / 2)
    assert parts.conv_bias == pytest.approx(bias) and parts.dense == pytest.approx(dense)
    assert parts.conv == pytest.approx(hidden)
