"""Pooled responses against a plain convolution, gradients through training, held-out accuracy, odd rows."""

import random
import zlib

import numpy as np

from packetloom.llm import toxic_cnn
from packetloom.llm.queries import QUERIES
from packetloom.llm.toxic_cnn import FILTERS, WIDTHS, Memory, Vocabulary, laid_out, new_network, word_rows


def plain_margin(net, text):
    rows = [word_rows(w) for w in text.split()] or [(0, 0, 0)]
    vectors = [net.embed[list(r)].sum(axis=0) for r in rows] + [np.zeros(net.embed.shape[1])] * (max(WIDTHS) - 1)
    pooled = []
    for k, width in enumerate(WIDTHS):
        first = sum(WIDTHS[:k])
        for f in range(FILTERS):
            pooled.append(max(sum(vectors[i + o] @ net.filters[:, first + o, f] for o in range(width)) for i in range(len(rows))))
    pooled = np.array(pooled) + net.bias
    return np.where(pooled > 0, pooled, toxic_cnn.LEAK * pooled) @ net.out + net.offset


def test_pooling_equals_a_plain_convolution():
    rng, net, memory = random.Random(1), new_network(3), Memory()
    texts = [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randint(0, 40))).encode() for _ in range(60)] + [b"", b" ", b"one"]
    got = memory.margins(net, texts)
    assert np.allclose(got, [plain_margin(net, t) for t in texts], atol=1e-4)
    assert np.allclose(memory.margins(net, texts[::-1]), got[::-1], atol=1e-4)
    row, starts = laid_out(texts, Vocabulary())
    assert len(starts) == len(texts) and row[starts[-2]] == 0


def corpus(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        text, y = [rng.choice(words) for _ in range(rng.randint(3, 60))], rng.random() < 0.3
        if y:
            text.insert(rng.randrange(len(text)), rng.choice(["awful", "Vile!", "rotten1", "rotten2", "rotten3"]))
        out.append((i, " ".join(text), rng.choice(["en", "de", None]), int(y)))
    return out


def test_learns_words_and_generalises_to_their_kin():
    rows = corpus(600, 2)
    net = toxic_cnn.train_network([t.encode() for _, t, _, _ in rows], np.array([y for *_, y in rows]))
    fresh = corpus(300, 4)
    margins = Memory().margins(net, [t.replace("rotten", "rotten9").encode() for _, t, _, _ in fresh])
    assert ((margins > 0) == [y == 1 for *_, y in fresh]).mean() > 0.95


def test_threshold():
    scores, y = np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 0, 1, 1])
    assert 0.2 < toxic_cnn.threshold(scores, y) <= 0.3
    assert toxic_cnn.threshold(scores, np.zeros(4)) == toxic_cnn.TOXIC
    assert toxic_cnn.threshold(np.array([0.1, 0.9]), np.array([0, 1])) == toxic_cnn.TOXIC


def test_tables(spark):
    rows = corpus(400, 5)
    docs = spark.createDataFrame([r[:3] for r in rows] + [(None, "x", "en"), (1000, None, "xx"), (1001, "", None), rows[0][:3]], "doc_id long, text string, lang string")
    frame = lambda r: spark.createDataFrame(r, "doc_id long, toxic int")
    labels = [(i, y) for i, _, _, y in rows] + [(None, 1), (3, None), (rows[1][0], rows[1][3])]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    net = toxic_cnn.train(docs, frame(labels))
    flipped = toxic_cnn.train(docs, frame([(i, 1 - y if i is not None and y is not None and held(i) else y) for i, y in labels]))
    assert np.array_equal(net.embed, flipped.embed) and net.scale == flipped.scale  # held-out labels aren't read
    made = toxic_cnn.score(docs, net)
    assert made.count() == 404 and made.where("score is null or score < 0 or score > 1 or flagged <> (score >= threshold)").count() == 0
    truth = {i: y for i, _, _, y in rows}
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in made.collect() if r.doc_id in truth and held(r.doc_id)]) > 0.9
    assert toxic_cnn.score(docs.limit(0), net).count() == 0
    assert {r.score for r in toxic_cnn.score(docs, toxic_cnn.train(docs, frame(labels).limit(0))).collect()} == {0.5}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    made = QUERIES["op4_toxic_cnn"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in made)
    fresh = [r for r in made if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in fresh]) > 0.9


def test_thresholds_come_from_all_labelled_rows(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["en", "de", "xx", None]), rng.choice([0.05, 0.31, 0.33, 0.5, 0.52, 0.7, 0.9]), rng.random()) for i in range(3000)]
    rows = [(i, lang, s, int(u < (s if lang != "de" else s * s))) for i, lang, s, u in rows]
    rows += [(9000 + i, f"lang {i}", s, y) for i in range(0, 300, 2) for i, s, y in ((i, 0.2, 0), (i + 1, 0.4, 1))]
    rows = [(i, f"lang {(i - 9000) // 2}" if i >= 9000 else lang, s, y) for i, lang, s, y in rows]  # 150 languages of two rows
    rows += [(9900, "one", 0.3, 1), (9901, "one", 0.4, 1), (9902, "low", 0.3, 1), (9903, "low", 0.4, 0)]
    scored = spark.createDataFrame([r[:3] for r in rows] + [rows[0][:3], (None, "en", 0.1)], "doc_id long, lang string, score double")
    got = {r.lang: r.threshold for r in toxic_cnn.thresholds(scored, spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, y int")).collect()}
    for lang in {r[1] or "" for r in rows}:
        own = [(s, y) for _, x, s, y in rows if (x or "") == lang]
        s, y = np.array([a for a, _ in own]), np.array([b for _, b in own])
        want = toxic_cnn.threshold(s, y)
        assert ((s >= got[lang]) == (s >= want)).all() and abs(got[lang] - want) < 2 / toxic_cnn.BINS, lang
    assert got["one"] == got["low"] == toxic_cnn.TOXIC and abs(got["lang 149"] - 0.3) < 2 / toxic_cnn.BINS


def test_rare_languages_beyond_the_sample_have_thresholds(spark, monkeypatch):
    monkeypatch.setattr(toxic_cnn, "MOST_TOXIC", 60)
    monkeypatch.setattr(toxic_cnn, "MOST_CLEAN", 120)
    rows = [(i, t, f"l{i % 150}", y) for i, t, _, y in corpus(3000, 6)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int")
    net = toxic_cnn.train(docs, labels)
    learnt = {x for i, _, x, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1}
    assert {r.lang for r in net.thresholds.collect()} == learnt and len(learnt) == 150
    made = sorted(toxic_cnn.score(docs, net).collect())
    assert made == sorted(toxic_cnn.train_and_score(docs, labels).collect()) and len(made) == 3000
    cuts, langs = {r.lang: r.threshold for r in net.thresholds.collect()}, {i: x for i, _, x, _ in rows}
    assert all(r.threshold == cuts[langs[r.doc_id]] for r in made)
