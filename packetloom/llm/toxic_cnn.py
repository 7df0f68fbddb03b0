"""Convolutional text classifier for toxicity: hashed word embeddings, several filter widths, max pooling.

The network is trained in numpy on a bounded sample of labelled rows. As a filter's response to a window is
a sum of one part per word, a text is scored by looking up each word's parts, adding them up along the
text and taking each filter's largest response: the whole text is read, whatever its length.

Thresholds by language come from all labelled rows that the network wasn't trained on, counted by Spark.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.common import fold, heavy_light_join, map_blocks, materialize

#: Labelled rows used to fit, at most, of either class: the first by a hash of their ids.
MOST_TOXIC, MOST_CLEAN = 1_500, 3_000
#: Rows of the embedding table, their length, filters of each width, widths.
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 16, 8, (1, 2, 3)
#: Passes, batch size, step; every fifth row of the sample is kept to scale the scores.
EPOCHS, BATCH, STEP, LEAK = 12, 150, 0.02, 0.1
#: A text is toxic from this score on, where no language says otherwise.
TOXIC = 0.7
#: Score bins between whose edges a language's threshold is chosen.
BINS = 10_000
#: Words whose parts a worker remembers; then it forgets them all.
REMEMBERED = 150_000

_EDGE = b".,;:!?\"'()[]{}|*%&$#<>-_"
_PARTS = sum(WIDTHS)


def word_rows(word: bytes) -> tuple[int, int, int]:
    """Embedding rows of a word, lower-cased and without edge punctuation: itself, its first four and first five bytes."""
    word = word.lower().strip(_EDGE)
    return tuple(xxhash.xxh3_64_intdigest(x) % (BUCKETS - 1) + 1 for x in (word, b"4" + word[:4], b"5" + word[:5]))


class Vocabulary(dict):
    """Numbers of words, 0 being the gap between texts, and their embedding rows."""

    def __init__(self) -> None:
        super().__init__()
        self.rows = [(0, 0, 0)]

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self.rows)
        self.rows.append(word_rows(word))
        return at


def laid_out(texts: list[bytes], words: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts in one row and each text's start. A text without words is one gap; gaps as
    long as the widest window part the texts."""
    gap, row, starts = [0] * (max(WIDTHS) - 1), [], []
    for text in texts:
        starts.append(len(row))
        row += list(map(words.__getitem__, text.split())) or [0]
        row += gap
    return np.array(row, np.int64), np.array(starts, np.int64)


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray  # DIM x parts x FILTERS; part o of width k stands at k (k - 1) / 2 + o
    bias: np.ndarray
    out: np.ndarray
    offset: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: DataFrame | None = None  # lang, threshold

    def parts(self, rows: np.ndarray) -> np.ndarray:
        """Words x parts x filters: what a word adds to each response."""
        return np.tensordot(self.embed[rows].sum(axis=1), self.filters, 1)

    def pooled(self, parts: np.ndarray, row: np.ndarray, starts: np.ndarray, where: bool = False):
        """Each text's largest response of each filter, and where it starts if asked for."""
        n, gap = len(row), max(WIDTHS) - 1
        padded = np.append(row, np.zeros(gap, np.int64))
        ends = np.append(starts[1:], n) - gap
        idle = np.concatenate([ends + i for i in range(gap)])
        best, places = [], []
        for k, width in enumerate(WIDTHS):
            first = sum(WIDTHS[:k])
            response = parts[padded[:n], first]
            for o in range(1, width):
                response = response + parts[padded[o : n + o], first + o]
            response[idle] = -np.inf
            top = np.maximum.reduceat(response, starts)
            best.append(top)
            if where:
                hit = response == np.repeat(top, np.diff(np.append(starts, n)), axis=0)
                at = np.where(hit, np.arange(n)[:, None], n)
                places.append(np.minimum.reduceat(at, starts))
        return np.concatenate(best, axis=1) + self.bias, places

    def margins(self, pooled: np.ndarray) -> np.ndarray:
        return np.where(pooled > 0, pooled, LEAK * pooled) @ self.out + self.offset

    def scores(self, margins: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * margins.astype(np.float64) + b, -40, 40)))


def new_network(seed: int = 0) -> Network:
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    embed[0] = 0
    n = FILTERS * len(WIDTHS)
    return Network(embed, rng.normal(0, 0.3, (DIM, _PARTS, FILTERS)).astype(np.float32), np.zeros(n, np.float32), rng.normal(0.3, 0.1, n).astype(np.float32))


class _Adam:
    def __init__(self, value: np.ndarray) -> None:
        self.m, self.v, self.t = np.zeros_like(value), np.zeros_like(value), 0

    def step(self, value: np.ndarray, grad: np.ndarray, at=slice(None)) -> None:
        self.t += 1
        self.m[at] = 0.9 * self.m[at] + 0.1 * grad
        self.v[at] = 0.99 * self.v[at] + 0.01 * grad * grad
        value[at] -= STEP * (self.m[at] / (1 - 0.9**self.t)) / (np.sqrt(self.v[at] / (1 - 0.99**self.t)) + 1e-6)


def train_network(texts: list[bytes], y: np.ndarray, seed: int = 0) -> Network:
    """Cross-entropy, both classes weighing the same, by Adam; the gradient of a pooled response reaches only the window it comes from."""
    net, rng, words = new_network(seed), np.random.default_rng(seed), Vocabulary()
    steps = {n: _Adam(getattr(net, n)) for n in ("embed", "filters", "bias", "out")}
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    laid = [laid_out([t], words)[0] for t in texts]
    table = np.array(words.rows, np.int64)
    for _ in range(EPOCHS):
        mix = rng.permutation(len(texts))
        for i in range(0, len(mix), BATCH):
            batch = mix[i : i + BATCH]
            lengths = np.array([len(laid[b]) for b in batch])
            whole = np.concatenate([laid[b] for b in batch])
            known, row = np.unique(np.append(whole, 0), return_inverse=True)  # the gap, 0, stays first
            row, starts = row[:-1], np.cumsum(lengths) - lengths
            vectors = net.embed[table[known]].sum(axis=1)
            pooled, places = net.pooled(np.tensordot(vectors, net.filters, 1), row, starts, True)
            margin = net.margins(pooled)
            slope = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y[batch]) * weight[batch] / len(batch)
            leak = np.where(pooled > 0, 1, LEAK)
            hidden = pooled * leak
            back = (slope[:, None] * net.out * leak).astype(np.float32)
            grad_filters, grad_vectors = np.zeros_like(net.filters), np.zeros_like(vectors)
            padded = np.append(row, np.zeros(max(WIDTHS), np.int64))
            for k, width in enumerate(WIDTHS):
                own = back[:, k * FILTERS : (k + 1) * FILTERS]
                for o in range(width):
                    part, at = sum(WIDTHS[:k]) + o, padded[places[k] + o]
                    grad_filters[:, part] += np.einsum("bfd,bf->df", vectors[at], own)
                    np.add.at(grad_vectors, at, own[:, :, None] * net.filters[:, part].T)
            touched = np.flatnonzero(grad_vectors.any(axis=1) & (known > 0))
            rows, which = np.unique(table[known[touched]], return_inverse=True)
            grad_rows = np.zeros((len(rows), DIM), np.float32)
            np.add.at(grad_rows, which.reshape(-1, 3), grad_vectors[touched][:, None, :])
            net.offset -= STEP * float(slope.sum())
            steps["out"].step(net.out, (hidden * slope[:, None]).sum(axis=0).astype(np.float32) + 1e-4 * net.out)
            steps["bias"].step(net.bias, back.sum(axis=0))
            steps["filters"].step(net.filters, grad_filters)
            if len(rows):
                steps["embed"].step(net.embed, grad_rows, rows)
    return net


class Memory:
    """The parts of the words met so far; forgets all when it holds ``REMEMBERED``."""

    def __init__(self) -> None:
        self.words, self.parts = Vocabulary(), np.empty((1024, _PARTS, FILTERS), np.float32)
        self.have = 0

    def margins(self, net: Network, texts: list[bytes]) -> np.ndarray:
        if self.have > REMEMBERED:
            self.words, self.have = Vocabulary(), 0
        row, starts = laid_out(texts, self.words)
        n = len(self.words.rows)
        if n > len(self.parts):
            self.parts = np.concatenate([self.parts, np.empty((n, _PARTS, FILTERS), np.float32)])
        if n > self.have:
            self.parts[self.have : n] = net.parts(np.array(self.words.rows[self.have :], np.int64))
            self.have = n
        return net.margins(net.pooled(self.parts, row, starts)[0])


def _platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make margins log-odds, by Newton steps; targets are pulled in by the sample's size."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    middle, spread = float(margins.mean()), float(margins.std()) + 1e-9
    x = np.stack([(margins - middle) / spread, np.ones_like(margins)], axis=1).astype(np.float64)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - target) + 0.1 * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), grad)
    slope = max(float(w[0]), 1e-3) / spread
    return slope, float(w[1]) - slope * middle


def threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1; between cuts that tell as well, the one nearest to ``TOXIC``."""
    if not len(y) or y.min() == y.max():
        return TOXIC
    edges = np.unique(scores)
    cuts = np.unique(np.concatenate([(edges[1:] + edges[:-1]) / 2, [TOXIC]]))
    called = scores[:, None] >= cuts
    hits = (called & (y == 1)[:, None]).sum(axis=0)
    f1 = 2 * hits / (called.sum(axis=0) + (y == 1).sum())
    best = cuts[f1 >= f1.max() - 1e-12]
    return float(best[np.argmin(np.abs(best - TOXIC))])


def _fit(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, parts: int, held_out: int) -> tuple[Network, DataFrame]:
    """The network without thresholds, and ``doc_id``, ``y`` of the labelled rows of the learning fold that it wasn't trained on."""
    order = F.xxhash64("doc_id", F.lit("fit"))
    learn = fold("doc_id", parts) != held_out
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("y")).where(learn & F.col("y").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y"))
    known = known.join(docs.select(F.col(doc_id).alias("doc_id")), "doc_id", "left_semi")
    chosen = known.where("y = 1").orderBy(order, "doc_id").limit(MOST_TOXIC).union(known.where("y = 0").orderBy(order, "doc_id").limit(MOST_CLEAN))
    chosen = materialize(chosen, "toxic-rows")  # a bounded number
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("text", "y")).alias("r")).orderBy("doc_id").collect()
    y = np.array([r.r.y for r in rows], np.int64)
    if not len(y) or y.min() == y.max():
        net = new_network()
        net.out[:] = 0
        return net, known
    texts = [bytes(r.r.text or b"") for r in rows]
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        held[np.flatnonzero(y == c)[::5]] = True
    net = train_network([t for t, h in zip(texts, held, strict=True) if not h], y[~held])
    memory = Memory()
    margins = np.concatenate([memory.margins(net, texts[i : i + 50]) for i in range(0, len(texts), 50)])
    net.scale = _platt(margins[held], y[held])
    kept = docs.sparkSession.createDataFrame([(r.doc_id,) for r, h in zip(rows, held, strict=True) if h], known.select("doc_id").schema)
    trained = chosen.select("doc_id").join(F.broadcast(kept), "doc_id", "left_anti")
    return net, known.join(F.broadcast(trained), "doc_id", "left_anti")


def _scores(docs: DataFrame, net: Network, doc_id: str, text: str, lang: str) -> DataFrame:
    """``doc_id``, ``lang`` and ``score`` of every row; the score reads the text alone."""
    kinds = [docs.schema[c].dataType.simpleString() for c in (doc_id, lang)]
    shared = docs.sparkSession.sparkContext.broadcast(replace(net, thresholds=None))  # a fixed size
    memory = Memory()

    def work(block: pa.RecordBatch) -> dict:
        own = shared.value
        made = own.scores(memory.margins(own, [t or b"" for t in block.column("text").to_pylist()]))
        return {"doc_id": block.column("doc_id"), "lang": block.column("lang"), "score": made}

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), F.col(lang).alias("lang"))
    return map_blocks(rows, "text", f"doc_id {kinds[0]}, lang {kinds[1]}, score double", work)


def thresholds(scored: DataFrame, known: DataFrame) -> DataFrame:
    """``lang`` and ``threshold`` of each language with labelled rows, as ``threshold`` has it, over score bins.

    Rows are counted by language and bin before anything is ordered, so a language is at most ``BINS`` + 1 rows,
    whatever its size. An id that stands in several rows counts once, by its lowest score. Languages with one class
    alone, or whose cuts find nothing, have ``TOXIC``.
    """
    rows = scored.where("doc_id is not null").select("doc_id", "lang", "score").join(known, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("score", F.coalesce("lang", F.lit("")).alias("lang"))).alias("r"), F.max("y").alias("y"))
    edge = lambda k: k / F.lit(float(BINS))
    low = F.floor(F.col("r.score") * BINS)
    fits = low + F.when(F.col("r.score") >= edge(low + 1), 1).when(F.col("r.score") < edge(low), -1).otherwise(0)
    counts = rows.groupBy(F.col("r.lang").alias("lang"), fits.cast("long").alias("bin")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("n1"))
    own = Window.partitionBy("lang")
    up = own.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    bins = counts.select("lang", "bin", F.sum("n").over(up).alias("called"), F.sum("n1").over(up).alias("hits"), F.sum("n").over(own).alias("all"), F.sum("n1").over(own).alias("all1"), F.lag("bin").over(own.orderBy("bin")).alias("below"))
    usual = round(TOXIC * BINS)
    inside = (F.col("bin") >= usual) & (F.col("below").isNull() | (F.col("below") < usual))
    cut = F.when(inside, usual).otherwise(F.floor((F.col("below") + 1 + F.col("bin")) / 2))  # null: the lowest bin alone has no cut below it
    f1 = F.when((F.col("all1") > 0) & (F.col("all1") < F.col("all")) & (F.col("hits") > 0) & cut.isNotNull(), 2 * F.col("hits") / (F.col("called") + F.col("all1")))
    best = F.max(F.when(f1.isNotNull(), F.struct(f1.alias("f1"), (-F.abs(cut - usual)).alias("near"), (-cut).alias("cut"))))
    return bins.groupBy("lang").agg(best.alias("b")).select("lang", F.coalesce(edge(-F.col("b.cut")), F.lit(TOXIC)).alias("threshold"))


def _cut(scored: DataFrame, cuts: DataFrame | None) -> DataFrame:
    """``doc_id``, ``score``, ``threshold``, ``flagged``; languages with many rows are broadcast, the others joined."""
    rows = scored.withColumn("lang", F.coalesce("lang", F.lit("")))
    if cuts is not None:
        counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
        keyed = materialize(counts.join(cuts, "lang"), "toxic-cuts")
        rows = heavy_light_join(rows, keyed, "lang", "n", scored.count(), ["threshold"])
    else:
        rows = rows.withColumn("threshold", F.lit(None).cast("double"))
    cut = F.coalesce("threshold", F.lit(TOXIC))
    return rows.select("doc_id", "score", cut.alias("threshold"), (F.col("score") >= cut).alias("flagged"))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", parts: int = 3, held_out: int = 1) -> Network:
    """Fit on rows whose crc32(id) mod ``parts`` isn't ``held_out``; the scale of the scores comes from every fifth
    of the sample, the languages' thresholds from all of the rows that the network wasn't trained on.

    An id with several labels counts as toxic if any is 1; null labels and ids don't count. A sample
    without both classes gives the untrained network, whose scores are all 0.5. A bounded number of rows comes to the driver.
    """
    net, known = _fit(docs, labels, doc_id, text, label, parts, held_out)
    net.thresholds = materialize(thresholds(_scores(docs, net, doc_id, text, lang), known), "toxic-thresholds")
    return net


def score(docs: DataFrame, net: Network, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``doc_id``, ``score`` (0 to 1), ``threshold`` (of the row's language) and ``flagged`` of every row.

    The score reads the text alone. Null counts as the empty text, which has a score like any other; a language
    without labelled rows takes ``TOXIC``; null and empty languages are one; repeated rows stay.
    """
    return _cut(materialize(_scores(docs, net, doc_id, text, lang), "toxic-scores"), net.thresholds)


def train_and_score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic", parts: int = 3, held_out: int = 1) -> DataFrame:
    """``score`` of the rows of ``docs`` by the network that ``train`` fits on them; the texts are scored once for both."""
    net, known = _fit(docs, labels, doc_id, text, label, parts, held_out)
    made = materialize(_scores(docs, net, doc_id, text, lang), "toxic-scores")
    return _cut(made, materialize(thresholds(made, known), "toxic-thresholds"))
