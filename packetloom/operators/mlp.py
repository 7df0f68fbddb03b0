"""Malicious score: a one-hidden-layer perceptron on min-maxed columns."""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark import cloudpickle
from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.columns import fenced, finite_or_zero, named, quoted, sigmoid
from packetloom.operators.encode import assemble
from packetloom.operators.minibatch import train
from packetloom.operators.scale import Bounds, fit_bounds, minmax, minmax_column

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HIDDEN_UNITS = 10
EPOCHS = 100
#: Batches an epoch and Adam's rate: as many steps at every size of the table.
BATCHES, RATE = 4, 0.02


@dataclass
class Perceptron:
    """Inputs → hidden units with ReLU → one sigmoid: a matrix, its bias, a vector and its bias."""

    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    @staticmethod
    def start(n: int, hidden: int = HIDDEN_UNITS, seed: int = 42) -> Perceptron:
        rng = np.random.default_rng(seed)

        def uniform(rows: int, cols: int) -> np.ndarray:
            limit = np.sqrt(6.0 / (rows + cols))
            return rng.uniform(-limit, limit, (rows, cols))

        return Perceptron(uniform(n, hidden), np.zeros(hidden), uniform(hidden, 1)[:, 0], np.zeros(1))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.hidden.ravel(), self.hidden_bias, self.out, self.out_bias])

    def like(self, flat: np.ndarray) -> Perceptron:
        parts, at = [], 0
        for a in (self.hidden, self.hidden_bias, self.out, self.out_bias):
            parts.append(flat[at : at + a.size].reshape(a.shape))
            at += a.size
        return Perceptron(*parts)

    def single(self) -> Perceptron:
        """Rows come in single precision, weights stay in double: there are few of them."""
        return self

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        active = np.maximum(x @ self.hidden + self.hidden_bias, 0.0)
        return active, active @ self.out + self.out_bias[0]

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[1]

    def loss(self, x: np.ndarray, y: np.ndarray) -> float:
        """Summed cross-entropy."""
        z = self._forward(x)[1]
        return float((np.logaddexp(0.0, z) - y * z).sum())

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        active, z = self._forward(x)
        error = np.exp(-np.logaddexp(0.0, -z)) - y
        back = np.outer(error, self.out) * (active > 0)
        parts = Perceptron(x.T @ back, back.sum(axis=0), active.T @ error, error.sum(keepdims=True))
        return parts.flat().astype(np.float64), float((np.logaddexp(0.0, z) - y * z).sum())

    def probability(self, df: DataFrame, cols: Sequence[str], out: str) -> DataFrame:
        """Add the class-1 probability of already scaled columns, as generated arithmetic."""
        units = {
            f"__unit{j}": F.expr(
                f"greatest(0D, {' + '.join([f'{float(b)!r}D', *(f'{quoted(c)} * {float(w)!r}D' for c, w in zip(cols, column, strict=True))])})"
            )
            for j, (column, b) in enumerate(zip(self.hidden.T, self.hidden_bias, strict=True))
        }
        total = " + ".join([f"{float(self.out_bias[0])!r}D", *(f"{u} * {float(w)!r}D" for u, w in zip(units, self.out, strict=True))])
        return fenced(df, units).withColumn(out, sigmoid(F.expr(total))).drop(*units)


@dataclass
class MaliciousScorer:
    """A trained perceptron, the columns it reads, the bounds it was fitted with and the loss by epoch."""

    weights: Perceptron
    cols: list[str]
    bounds: Bounds
    history: list[tuple[float, float | None]] = field(default_factory=list)

    def apply(self, scaled: DataFrame, out: str) -> DataFrame:
        return self.weights.probability(scaled, [c + "__scaled" for c in self.cols], out)

    def save(self, spark: SparkSession, path: str) -> None:
        """One Parquet row of arrays."""
        low, high = ([None if self.bounds[c][i] is None else float(self.bounds[c][i]) for c in self.cols] for i in (0, 1))
        row = (self.cols, low, high, int(self.weights.hidden.shape[1]), self.weights.flat().tolist())
        schema = "cols array<string>, low array<double>, high array<double>, hidden int, flat array<double>"
        spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> MaliciousScorer:
        row = spark.read.parquet(path).first()
        cols = list(row["cols"])
        weights = Perceptron.start(len(cols), row["hidden"]).like(np.array(row["flat"]))
        return MaliciousScorer(weights, cols, {c: pair for c, *pair in zip(cols, row["low"], row["high"], strict=True)})


def classifier_pipeline(stage, cols: Sequence[str], suffix: str = "__scaled") -> Pipeline:
    return Pipeline(stages=[assemble([c + suffix for c in cols], "__features"), stage])


def fit_mlp(
    df: DataFrame,
    cols: Sequence[str],
    label: str,
    hidden: int = HIDDEN_UNITS,
    epochs: int = EPOCHS,
    seed: int = 42,
    bounds: Bounds | None = None,
    key: str | Sequence[str] | None = None,
    batches: int = BATCHES,
    batch_rows: int | None = None,
    rate: float = RATE,
    held_out: float = 0.0,
) -> MaliciousScorer:
    """Fit inputs → ``hidden`` ReLU units → one sigmoid by Adam on mini-batches of cross-entropy.

    Null and non-finite inputs count as 0, as the chain fills them; a null label takes no part. ``key``
    makes the batches the same on every layout of the table.
    """
    cols = list(cols)
    bounds = fit_bounds(df, cols) if bounds is None else bounds
    inputs = [minmax_column(finite_or_zero(named(c)), *bounds[c]) for c in cols]
    (weights,), (history,) = train(
        df, inputs, named(label), [Perceptron.start(len(cols), hidden, seed)], key,
        batch_rows=batch_rows, batches=batches, epochs=epochs, rate=rate, held_out=held_out, seed=seed,
    )
    return MaliciousScorer(weights, cols, bounds, history)


def raw_probability(
    scorer, df: DataFrame, out: str, bounds: Bounds | None = None
) -> DataFrame:
    """Class-1 probability of a fitted scorer, before it is rescaled.

    Null and non-finite inputs count as 0. Without ``bounds`` the inputs are scaled by the range of the batch itself.
    """
    bounds = fit_bounds(df, scorer.cols) if bounds is None else bounds
    scaled = df.withColumns({c + "__scaled": minmax_column(finite_or_zero(named(c)), *bounds[c]) for c in scorer.cols})
    scored = scorer.apply(scaled, out)
    return scored.select(*[named(c) for c in df.columns], F.col(f"`{out}`"))


def score_mlp(
    scorer, df: DataFrame, out: str = "malicious_score", bounds: Bounds | None = None,
    score_bounds: Bounds | None = None,
) -> DataFrame:
    """Scored rows with the score min-maxed to [0, 1]; input columns stay unscaled."""
    return minmax(raw_probability(scorer, df, out, bounds), [out], score_bounds)
