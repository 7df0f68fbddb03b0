"""Cross-validated accuracy over given folds."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel, cloudpickle
from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.columns import finite_or_zero, named, ratio
from packetloom.operators.encode import assemble
from packetloom.operators.evaluate import multiclass_accuracy
from packetloom.operators.minibatch import train
from packetloom.operators.mlp import BATCHES, EPOCHS, HIDDEN_UNITS, RATE, Perceptron
from packetloom.operators.scale import fit_moments, standardize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows that all networks work off at once: their units stay in a core's cache.
CHUNK = 512

Fit = Callable[[DataFrame], object]
Score = Callable[[object, DataFrame], DataFrame]


def cross_validate(
    df: DataFrame, fold: str, k: int, fit: Fit, score: Score, label: str, pred: str = "prediction"
) -> DataFrame:
    """Accuracy on each fold after fitting on the others: one row per fold.

    The folds are kept (spilling to disk) so the ``k`` fits do not redo the
    work that assigned them.
    """
    results = []
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for i in range(k):
            model = fit(df.filter(named(fold) != i))
            held_out = score(model, df.filter(named(fold) == i))
            results.append((i, multiclass_accuracy(held_out, label, pred).first()[0]))
    finally:
        df.unpersist()
    schema = T.StructType([T.StructField("fold", T.IntegerType()), T.StructField("accuracy", T.DoubleType())])
    return df.sparkSession.createDataFrame(results, schema)


def summarize_folds(folds: DataFrame) -> DataFrame:
    """Mean and population standard deviation of the fold accuracies."""
    return folds.agg(
        F.avg("accuracy").alias("mean_accuracy"), F.stddev_pop("accuracy").alias("sd_accuracy")
    )


def standardized_mlp(
    cols: Sequence[str], label: str, hidden: int = 10, max_iter: int = 100, seed: int = 42
) -> tuple[Fit, Score]:
    """Fit and score functions for a perceptron on columns standardised by the fit rows."""
    cols = list(cols)

    def fit(train: DataFrame):
        moments = fit_moments(train, cols)
        perceptron = MultilayerPerceptronClassifier(
            layers=[len(cols), hidden, 2], labelCol="__label", maxIter=max_iter, seed=seed
        )
        scaled = standardize(train, cols, moments).withColumn("__label", named(label).cast("double"))
        return moments, Pipeline(stages=[assemble(cols), perceptron]).fit(scaled)

    def score(model, held_out: DataFrame) -> DataFrame:
        moments, fitted = model
        return fitted.transform(standardize(held_out, cols, moments))

    return fit, score


@dataclass
class Standardised:
    """A network whose inputs are shifted and scaled first, by moments of its own training rows."""

    network: Perceptron
    mean: np.ndarray
    sd: np.ndarray

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.sd

    def flat(self) -> np.ndarray:
        return self.network.flat()

    def like(self, flat: np.ndarray) -> Standardised:
        return Standardised(self.network.like(flat), self.mean, self.sd)

    def single(self) -> Standardised:
        return self

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
        return self.network.gradient(self._scaled(x), y)

    def loss(self, x: np.ndarray, y: np.ndarray) -> float:
        return self.network.loss(self._scaled(x), y)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.network.logit(self._scaled(x))


class JointFolds:
    """Perceptrons of all folds side by side as one wide layer; network ``j`` takes the rows outside fold ``j``.

    Rows are standardised once, by the first network's moments; what the others' moments differ by goes into
    their weights, and out of their gradients. A unit's sum of (error x inputs and one) over the rows that it is
    active on gives all its gradients: times its outer weight those of its inputs and bias, times its own
    weights that of the outer weight.
    """

    def __init__(self, networks: Sequence[Standardised]) -> None:
        first = networks[0]
        n, h = first.network.hidden.shape
        self.k, self.n, self.h, self.mean, self.sd = len(networks), n, h, first.mean, first.sd
        self.scale = np.array([first.sd / w.sd for w in networks])
        self.shift = np.array([(first.mean - w.mean) / w.sd for w in networks])
        # a unit a row, its bias in the last column
        hidden = [(w.network.hidden * s[:, None]).T for w, s in zip(networks, self.scale, strict=True)]
        bias = [w.network.hidden_bias + t @ w.network.hidden for w, t in zip(networks, self.shift, strict=True)]
        self.units = np.ascontiguousarray(np.column_stack([np.vstack(hidden), np.concatenate(bias)]))
        self.out = np.array([w.network.out for w in networks])
        self.out_bias = np.array([w.network.out_bias for w in networks])

    def sums(self, x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
        k, n, h = self.k, self.n, self.h
        found, rest, nothing = np.zeros((k * h, n + 1)), np.zeros((3, k)), np.zeros(CHUNK)
        # for one chunk after the other: fresh arrays would cost more than the work on them
        room, marks = np.empty(k * h * CHUNK), np.empty(k * h * CHUNK, bool)
        x = np.column_stack([(x - self.mean) / self.sd, np.ones(len(x))])
        for i in range(0, len(x), CHUNK):
            a, b = x[i : i + CHUNK], y[i : i + CHUNK].astype(float)
            own = fold[i : i + CHUNK] != np.arange(k, dtype=fold.dtype)[:, None]
            active = np.matmul(self.units, a.T, out=room[: k * h * len(a)].reshape(k * h, len(a)))
            on = np.greater(active, 0.0, out=marks[: active.size].reshape(active.shape)).reshape(k, h, len(a))
            active = np.maximum(active, nothing[: len(a)], out=active).reshape(k, h, len(a))
            z = (self.out[:, None, :] @ active)[:, 0] + self.out_bias
            p = 0.5 * np.tanh(0.5 * z) + 0.5
            error = (p - b) * own
            found += np.multiply(on, error[:, None], out=active).reshape(k * h, len(a)) @ a
            rest += (error.sum(axis=1), ((np.maximum(z, 0.0) - np.log(np.maximum(p, 1.0 - p)) - b * z) * own).sum(axis=1), own.sum(axis=1))
        out = (found * self.units).sum(axis=1)
        found *= self.out.reshape(-1, 1)
        total = []
        for j in range(k):
            at = slice(j * h, (j + 1) * h)
            hidden, bias = found[at, :n].T, found[at, n]
            of_hidden = hidden * self.scale[j][:, None] + np.outer(self.shift[j], bias)
            total.append(np.concatenate([of_hidden.ravel(), bias, out[at], rest[:, j]]))
        return np.array(total)


def fold_moments(df: DataFrame, fold: str, cols: Sequence[str], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Mean and population deviation of each column over the rows outside each fold, from one grouped aggregate.

    Sums are taken around the overall mean, so that differences of folds stay exact enough; a deviation of
    zero becomes 1.
    """
    centre = np.array([m or 0.0 for m in df.agg(*[F.avg(finite_or_zero(named(c))) for c in cols]).first()], float)
    moved = [finite_or_zero(named(c)) - F.lit(float(m)) for c, m in zip(cols, centre, strict=True)]
    sums = [f for v in moved for f in (F.sum(v), F.sum(v * v))]
    rows = df.groupBy(named(fold).cast("int")).agg(F.count("*"), *sums).collect()
    own = {r[0]: np.array(r[1:], float) for r in rows}
    out = []
    for i in range(k):
        total = np.sum([v for f, v in own.items() if f != i], axis=0) if any(f != i for f in own) else np.zeros(1 + 2 * len(cols))
        n = max(total[0], 1.0)
        mean, square = total[1::2] / n, total[2::2] / n
        sd = np.sqrt(np.maximum(square - mean**2, 0.0))
        out.append((centre + mean, np.where(sd > 0, sd, 1.0)))
    return out


def cross_validate_perceptron(
    df: DataFrame,
    cols: Sequence[str],
    label: str,
    fold: str,
    k: int,
    hidden: int = HIDDEN_UNITS,
    epochs: int = EPOCHS,
    batches: int = BATCHES,
    rate: float = RATE,
    key: str | Sequence[str] | None = None,
    seed: int = 42,
) -> DataFrame:
    """Accuracy on each of ``k`` folds of perceptrons fitted on the others: one row per fold.

    All ``k`` networks are trained in the same steps: a step reads a batch once and gives each network the
    gradient over the rows outside its fold, on inputs standardised by those rows. A last scan scores
    every row by its fold's network. Null and non-finite inputs count as 0; rows without label or
    fold take no part.
    """
    cols = list(cols)
    df = df.select(*[finite_or_zero(named(c)).alias(c) for c in cols], *[named(c) for c in df.columns if c not in cols])
    df = df.where(named(label).isNotNull() & named(fold).isNotNull()).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        start = Perceptron.start(len(cols), hidden, seed)
        networks = [Standardised(start, *moments) for moments in fold_moments(df, fold, cols, k)]
        networks, _ = train(
            df, [named(c) for c in cols], named(label), networks, key,
            batches=batches, epochs=epochs, rate=rate, fold=fold, seed=seed, joint=JointFolds,
        )

        def hits(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            found = np.zeros((k, 2), np.int64)
            for frame in frames:
                x, y, own = frame[cols].to_numpy(np.float32), frame["__label"].to_numpy(), frame["__fold"].to_numpy()
                for i in np.unique(own):
                    at = own == i
                    right = (networks[i].logit(x[at]) > 0) == (y[at] > 0.5)
                    found[i] += (int(right.sum()), int(at.sum()))
            yield pd.DataFrame({"fold": np.arange(k, dtype=np.int32), "hits": found[:, 0], "n": found[:, 1]})

        rows = df.select(*[named(c) for c in cols], named(label).cast("double").alias("__label"), named(fold).cast("int").alias("__fold"))
        counts = rows.where(F.col("__fold").between(0, k - 1)).mapInPandas(hits, "fold int, hits long, n long")
        counts = counts.groupBy("fold").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n"))
        results = counts.select("fold", ratio(F.col("hits"), F.col("n")).alias("accuracy")).orderBy("fold").collect()
    finally:
        df.unpersist()
    return df.sparkSession.createDataFrame(results, "fold int, accuracy double")
