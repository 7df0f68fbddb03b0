"""Quality classifier learnt from positive and unlabelled texts.

Trusted positives and a sample of unlabelled web text give an estimate of the share of good texts (the
class prior), then a model that minimises the non-negative unbiased risk
``prior E_P[l(g)] + max(0, E_U[l(-g)] - prior E_P[l(-g)])`` with the logistic loss l. Labels of bad texts
are never used. The model is additive over binned statistics of the whole text, so it is a small table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from packetloom.llm.common import WordHashes, blocks, fold, map_blocks, materialize, run_starts, windows

#: Rows used to fit, at most: labelled positives and unlabelled texts, the first by a hash of their ids.
MOST_POSITIVE, MOST_UNLABELLED = 6_000, 12_000
#: Bins of a statistic, steps of the fit, weight of the squared table entries.
BINS, STEPS, SHRINK = 16, 1_500, 1e-5
#: A text is accepted from this score on.
ACCEPT = 0.3

_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&|<>", b"|", b"!?", b".,;:", bytes(range(128, 192)), bytes(range(192, 256)), b"\n", b" \t\r\x0b\x0c", b"\"'()[]{}=+/\\@~^_`-")
_TABLE = np.zeros((256, len(_CLASSES)))
for _i, _class in enumerate(_CLASSES):
    _TABLE[list(_class), _i] = 1
N_STATISTICS = len(_CLASSES) + 13


def statistics(text: bytes, hashes: WordHashes) -> np.ndarray:
    """Numbers that describe a whole text; all 0 if it is empty."""
    out = np.zeros(N_STATISTICS)
    words = text.split()
    n = len(words)
    if not n:
        return out
    size = len(text)
    out[: len(_CLASSES)] = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _TABLE / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    ids = np.sort(own := hashes.of(words))
    starts = np.flatnonzero(run_starts(ids))
    counts = np.diff(np.append(starts, n))
    lines = text.split(b"\n")
    triples = np.sort(windows(own, 3))
    out[len(_CLASSES) :] = (
        np.log1p(n),
        lengths.mean(),
        lengths.std(),
        lengths.max(),
        (lengths <= 3).mean(),
        len(counts) / n,
        np.log(len(counts)) / np.log(n + 1),
        counts.max() / n,
        (len(lines) - len(set(lines))) / len(lines),
        n / len(lines),
        1 - run_starts(triples).mean() if len(triples) else 0,
        (own[1:] == own[:-1]).mean() if n > 1 else 0,
        np.log1p(lengths.max() / lengths.mean()),
    )
    return out


@dataclass(frozen=True)
class Model:
    """``edges`` (statistic x inner bin edges), ``table`` (statistic x bins), ``offset`` and the estimated ``prior``."""

    edges: np.ndarray
    table: np.ndarray
    offset: float
    prior: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        at = binned(x, self.edges)
        return self.offset + self.table[np.arange(x.shape[1]), at].sum(axis=1)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -40, 40)))


def binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)], axis=1)


def _fit(p: np.ndarray, u: np.ndarray, bins: int, slopes) -> tuple[np.ndarray, float]:
    """Adam on an additive table; ``slopes`` gives the loss's slopes by margin for both samples."""
    k = p.shape[1]
    p, u = (x + np.arange(k) * bins for x in (p, u))
    w, m, v = np.zeros(k * bins + 1), np.zeros(k * bins + 1), np.zeros(k * bins + 1)
    for step in range(1, STEPS + 1):
        gp, gu = (w[-1] + w[x].sum(axis=1) for x in (p, u))
        sp, su = slopes(gp, gu)
        grad = np.append(np.bincount(p.ravel(), np.repeat(sp, k), k * bins) + np.bincount(u.ravel(), np.repeat(su, k), k * bins), sp.sum() + su.sum())
        grad[:-1] += SHRINK * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1].reshape(k, bins), float(w[-1])


def _sigmoid(g: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(g, -40, 40)))


def class_prior(p: np.ndarray, u: np.ndarray) -> float:
    """The share of positives among unlabelled rows, given scores that rise with positiveness on fresh rows.

    Above any score the unlabelled rows hold at least the positives' share of it, so each top part bounds the
    prior by P_U(above) / P_P(above); the least bound is taken over parts that hold a tenth of the positives
    or more, with an allowance for sampling.
    """
    cuts = np.quantile(p, np.linspace(0.02, 0.9, 45))
    above_p, above_u = (np.array([(x >= c).mean() for c in cuts]) for x in (p, u))
    spread = np.sqrt(above_u * (1 - above_u) / len(u)) / above_p + above_u * np.sqrt(above_p * (1 - above_p) / len(p)) / above_p**2
    best = np.argmin(above_u / above_p + spread)
    return float(np.clip(above_u[best] / above_p[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """The model of the given statistics. Without rows of either kind every score is 0.5."""
    k = N_STATISTICS
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros((k, BINS - 1)), np.zeros((k, BINS)), 0.0, 0.5)
    edges = np.quantile(np.concatenate([positive, unlabelled]), np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    p, u = binned(positive, edges), binned(unlabelled, edges)

    def against(n_p: int, n_u: int):
        """Plain logistic slopes of telling positive from unlabelled rows."""
        return lambda gp, gu: (-_sigmoid(-gp) / n_p, _sigmoid(gu) / n_u)

    if min(len(p), len(u)) > 1:  # every other row fits, the rest are fresh
        table, offset = _fit(p[::2], u[::2], BINS, against(len(p[::2]), len(u[::2])))
        fresh = [offset + table[np.arange(k), x[1::2]].sum(axis=1) for x in (p, u)]
        prior = class_prior(*fresh)
    else:
        prior = 0.5

    def risk(gp: np.ndarray, gu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slopes of the risk; when its part for negatives is below 0, that part is stepped back instead."""
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        sp, su = -prior * _sigmoid(-gp) / len(gp), _sigmoid(gu) / len(gu)
        if negative < 0:
            return prior * _sigmoid(gp) / len(gp), -su
        return sp - prior * _sigmoid(gp) / len(gp), su

    table, offset = _fit(p, u, BINS, risk)
    return Model(edges, table, offset, prior)


def _statistics(rows: DataFrame, kind: str) -> DataFrame:
    def work(block: pa.RecordBatch) -> dict:
        hashes = WordHashes()
        return {"doc_id": block.column("doc_id"), "x": [statistics(t or b"", hashes).tolist() for t in block.column("text").to_pylist()]}

    return map_blocks(rows, "text", f"doc_id {kind}, x array<double>", work)


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", parts: int = 5, held_out: int = 0) -> Model:
    """Fit on rows whose crc32(id) mod ``parts`` isn't ``held_out``.

    Positives are ids all of whose labels are 1; null labels and ids don't count. Only the chosen rows'
    statistics (a bounded number) come to the driver.
    """
    order = F.xxhash64("doc_id", F.lit("fit"))
    learn = fold("doc_id", parts) != held_out
    good = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("y")).where(learn).groupBy("doc_id").agg(F.min("y").alias("y")).where("y = 1")
    ids = docs.select(F.col(doc_id).alias("doc_id")).where(learn & F.col("doc_id").isNotNull()).distinct()
    good = good.join(ids, "doc_id", "left_semi").orderBy(order, "doc_id").limit(MOST_POSITIVE).select("doc_id", F.lit(True).alias("good"))
    drawn = ids.orderBy(order, "doc_id").limit(MOST_UNLABELLED).select("doc_id", F.lit(True).alias("drawn"))
    chosen = materialize(good.join(drawn, "doc_id", "full"), "quality-rows")  # a bounded number
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    made = _statistics(rows, docs.schema[doc_id].dataType.simpleString()).groupBy("doc_id").agg(F.min("x").alias("x")).join(F.broadcast(chosen), "doc_id").orderBy("doc_id").collect()
    pick = lambda c: np.array([r.x for r in made if r[c]]).reshape(-1, N_STATISTICS)
    return fit(pick("good"), pick("drawn"))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``score`` (0 to 1) of every row. Null counts as the empty text, which has a score like any other; repeated rows stay."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def work(block: pa.RecordBatch) -> dict:
        hashes = WordHashes()
        x = np.array([statistics(t or b"", hashes) for t in block.column("text").to_pylist()])
        return {"doc_id": block.column("doc_id"), "score": model.scores(x)}

    return map_blocks(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")), "text", f"doc_id {kind}, score double", work)


def accepted(docs: DataFrame, model: Model, text: str = "text", least: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` whose text scores ``least`` or more, with all their columns."""
    schema = to_arrow_schema(docs.schema)
    at = docs.columns.index(text)

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for block in blocks([batch], text):
                x = np.array([statistics((t or "").encode(), hashes) for t in block.column(at).to_pylist()])
                yield block.filter(pa.array(model.scores(x) >= least)).cast(schema)

    return docs.mapInArrow(run, docs.schema)
