"""The pipeline against brute force on the small tables; odd rows through every stage."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from packetloom.llm import pu_quality
from packetloom.llm.mixture import mix_sources
from packetloom.llm.pii import entities
from packetloom.session import materialize
from tests.llm.test_jaccard_tree import brute


def test_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    kept, stages = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stages[name] = materialize(stage(spark, kept, small), "pipeline-test")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    quality, near, pii, mixed, coded = stages.values()
    model = pu_quality.train(docs, spark.read.parquet(f"{small}/labels.parquet"))
    good = {r.doc_id for r in pu_quality.score(docs, model).where(f"score >= {pu_quality.ACCEPT}").collect()}
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in quality.collect()} == good
    firsts = {c for _, _, c in brute([(i, rows[i]) for i in good])}
    assert sorted(r.doc_id for r in near.collect()) == sorted(firsts)
    clean = {r.doc_id: r for r in pii.collect()}
    assert set(clean) == firsts and all(r.n_chars == len(r.text) for r in clean.values())
    for i, r in clean.items():
        old, new = entities(rows[i]), entities(r.text)
        assert [k for _, _, k, _ in old] == [k for _, _, k, _ in new] and not {e for *_, e in old} & {e for *_, e in new}
        assert old or r.text == rows[i]
    copies = {r.doc_id: r.copies for r in mix_sources(pii).collect()}
    got = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == {i: n for i, n in copies.items() if n}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made = coded.collect()
    assert len(made) == sum(got.values())
    for r in made:
        ids = library.encode(clean[r.doc_id].text, add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(clean[r.doc_id].text.encode()).hexdigest()
    assert sorted(map(str, corpus_pipeline.run(spark, small).collect())) == sorted(map(str, made))


@pytest.mark.parametrize("stage", range(4))
def test_odd_rows(spark, small, stage):
    rng = random.Random(stage)
    text = lambda: " ".join(f"w{rng.randrange(400)}" for _ in range(60))
    rows = [(i, text(), "en", f"s{i % 3}", 1, "x") for i in range(40)]
    rows += [(100, None, None, None, None, None), (101, "", "en", "s1", 0, "x"), (None, text(), "en", "s1", 9, "x"), (None, None, None, None, None, None)]
    rows += [rows[3], rows[3], (4, text(), "en", "s2", 5, "y"), (102, rows[7][1], "de", "s9", 5, "z"), (103, "long " * 50_000, "en", "s1", 5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string").repartition(4)
    run = corpus_pipeline.STAGES[stage][1]
    made = run(spark, docs, small)
    assert made.columns == docs.columns and made.dtypes == docs.dtypes
    ids = [r.doc_id for r in made.collect()]
    if stage == 1:
        assert ids.count(3) == ids.count(4) == 1 and 102 not in ids and {100, 101, 103} <= set(ids) and ids.count(None) == 2
    if stage == 2:
        assert len(ids) == len(rows)
    assert run(spark, docs.limit(0), small).count() == 0


def test_registered_once():
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and "pipeline" not in __spark_entry__.oracle_sql()
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in __spark_entry__.queries())] == []
