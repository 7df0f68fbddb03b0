"""From raw documents to token ids: quality, near duplicates, personal data, mixture, encoding.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns documents with
their columns; the last returns ids. ``run`` stores each stage's rows in the shared scratch folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import pu_quality
from packetloom.llm.bpe import bpe_encode
from packetloom.llm.common import materialize, read_table
from packetloom.llm.jaccard_tree import one_of_each
from packetloom.llm.mixture import mixed_documents
from packetloom.llm.pii import pseudonymise

#: Setting with the secret key of the surrogates, and the key where it is unset.
PII_KEY, NO_KEY = "packetloom.pii.key", "key of the registered query"
#: Learnt scores can't be expressed in SQL.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return pu_quality.accepted(docs, pu_quality.train(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Entities get surrogates; ``n_chars`` follows the text."""
    made = pseudonymise(docs, spark.conf.get(PII_KEY, NO_KEY).encode())
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else made


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``ids``, their number and digest, and the digest of the text decoded from them."""
    made = bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    return made.select(
        "doc_id",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mixture),
    ("BPE encoding and decoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return STAGES[-1][1](spark, docs, sf_dir)
