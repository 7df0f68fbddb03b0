"""Host-level quality rules: failures by host, rates shrunk by an empirical beta prior, verdicts joined back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.common import WordHashes, heavy_light_join, map_blocks, materialize, run_starts, windows

SPACES = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
#: A document fails the rule where its expression holds.
RULES: dict[str, str] = {
    "short": "n_words < 50",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > n_words",
}
#: The rules that a document may not fail itself.
BASE_RULES = ("short", "repeats")
#: A host is out if the shrunk rate of one of its rules is above this.
MOST_FAILING = 0.8


def text_counts(text: bytes, hashes: WordHashes) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in 3-word windows found twice."""
    words = text.split()
    bare = text.translate(None, SPACES)
    chars = len(bare) if bare.isascii() else len(bare.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = text.split(b"\n")
    again = 0
    if len(lines) > 1:
        seen: set[bytes] = set()
        for line in lines:
            if line in seen:
                again += bool(line.strip(SPACES))
            else:
                seen.add(line)
    repeated = 0
    if len(words) > 3:
        found = windows(hashes.of(words), 3)
        order = np.argsort(found)
        ordered = found[order]
        new = run_starts(ordered)
        if not new.all():
            twice = ~new
            twice[:-1] |= ~new[1:]
            covered = np.zeros(len(words), bool)
            at = order[twice]
            for i in range(3):
                covered[at + i] = True
            repeated = int(covered.sum())
    return len(words), chars, symbols, again, repeated


def document_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """``doc_id``, ``host`` and the five counts of each document; null and empty texts count 0 throughout."""
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (doc_id, host)}

    def work(block: pa.RecordBatch) -> dict:
        hashes = WordHashes()
        counts = [text_counts(x or b"", hashes) for x in block.column("text").to_pylist()]
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
        return {"doc_id": block.column("doc_id"), "host": block.column("host")} | dict(zip(names, map(list, zip(*counts, strict=True)), strict=True))

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).alias("host"), F.col(text).cast("binary").alias("text"))
    return map_blocks(rows, "text", f"doc_id {kinds[doc_id]}, host {kinds[host]}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long", work)


def _prior(f: Column, n: Column) -> tuple[Column, Column]:
    """Mean m and strength s of the beta prior of a rule's rates, by moments weighted with the hosts' documents.

    m is the rate of all documents. The variance between hosts is what the weighted spread of rates has
    beyond sampling: v = (sum(n (f / n - m)^2) - (hosts - 1) m (1 - m)) / (N - sum(n^2) / N), N = sum(n);
    s = m (1 - m) / v - 1, held between 1 and 1,000.
    """
    docs, hits = F.sum(n), F.sum(f)
    m = hits / docs
    spread = F.sum(f * f / n) - hits * hits / docs - (F.count("*") - 1) * m * (1 - m)
    v = F.greatest(spread / F.greatest(docs - F.sum(n * n) / docs, F.lit(1.0)), F.lit(1e-9))
    return m, F.least(F.greatest(m * (1 - m) / v - 1, F.lit(1.0)), F.lit(1000.0))


def host_verdicts(counts: DataFrame, rules: dict[str, str] = RULES, most: float = MOST_FAILING) -> DataFrame:
    """One row a host: documents ``n``, for each rule the shrunk ``rate_<rule>`` = (failures + s m) / (n + s), and ``host_failed``.

    Null is a host. Failures are summed before the shuffle, so that a host with any share of the rows
    is a row per task.
    """
    fails = {r: F.sum(F.expr(e).cast("long")).alias(f"f_{r}") for r, e in rules.items()}
    hosts = counts.groupBy("host").agg(F.count("*").alias("n"), *fails.values())
    priors = [p.alias(f"{k}_{r}") for r in rules for k, p in zip("ms", _prior(F.col(f"f_{r}").cast("double"), F.col("n").cast("double")), strict=True)]
    shrunk = hosts.crossJoin(F.broadcast(hosts.agg(*priors)))  # one row of priors
    rates = {f"rate_{r}": (F.col(f"f_{r}") + F.col(f"s_{r}") * F.col(f"m_{r}")) / (F.col("n") + F.col(f"s_{r}")) for r in rules}
    shrunk = shrunk.withColumns(rates)
    return shrunk.select("host", "n", *rates, F.greatest(*rates).alias("worst_rate")).withColumn("host_failed", F.col("worst_rate") > most)


def host_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", most: float = MOST_FAILING) -> DataFrame:
    """One row a document: its counts, ``base_failed``, ``host``, ``host_failed``, ``worst_rate`` and ``kept``.

    Kept are the documents that fail no base rule and whose host isn't out. Repeated rows count as often
    as they stand there; other columns are not read; an empty table gives none. Counts are stored once and
    read by both passes.
    """
    counts = materialize(document_counts(docs, doc_id, text, host), "host-rules-counts")
    total = counts.count()
    verdicts = materialize(host_verdicts(counts, most=most), "host-rules-verdicts")
    failed = " or ".join(f"({RULES[r]})" for r in BASE_RULES)
    rows = heavy_light_join(counts.withColumn("base_failed", F.expr(failed)), verdicts.withColumn("__n", F.col("n")), "host", "__n", total, ["host_failed", "worst_rate"])
    return rows.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
