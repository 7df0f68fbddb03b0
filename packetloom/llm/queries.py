"""The operators over the given tables with production parameters, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import pu_quality, toxic_cnn
from packetloom.llm.bpe import bpe_encode
from packetloom.llm.common import fold, read_table
from packetloom.llm.hamming_index import nearest
from packetloom.llm.host_rules import host_rules
from packetloom.llm.jaccard_tree import jaccard_components
from packetloom.llm.mixture import mix_sources
from packetloom.llm.order_minhash import edited_likeness
from packetloom.llm.pii import pseudonymise
from packetloom.llm.prefix_trie import prefix_trie
from packetloom.llm.seed_extend import remove_repeats
from packetloom.llm.spelling import spelling_variants
from packetloom.llm.trie_counts import token_counts

#: Stands for the secret key that a user passes to the surrogates.
PII_KEY = b"key of the registered query"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` gives the same rows in DuckDB."""

    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


@query("op10_bpe_pair_index")
def op10_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe_encode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), decoded=True)
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op9_order_minhash")
def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(read_table(spark, sf_dir, "documents"))


HOST_RULES_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         string_split(coalesce(text, ''), chr(10)) AS lines
  FROM documents),
wins AS (
  SELECT r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w
  FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM split)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS c FROM wins),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words
  FROM twice CROSS JOIN range(3) t(k) WHERE c > 1 GROUP BY r),
again AS (
  SELECT r, sum(c - 1) AS n_dup_lines
  FROM (SELECT r, line, count(*) AS c FROM (SELECT r, unnest(lines) AS line FROM split) GROUP BY r, line)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
counts AS (
  SELECT doc_id, source AS host, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM split LEFT JOIN covered USING (r) LEFT JOIN again USING (r)),
hosts AS (
  SELECT host, count(*) AS n, unnest([
    {'rule': 1, 'f': count(*) FILTER (n_words < 50)},
    {'rule': 2, 'f': count(*) FILTER (100 * n_repeat_words > 50 * n_words)},
    {'rule': 3, 'f': count(*) FILTER (10 * n_symbols > n_words)},
    {'rule': 4, 'f': count(*) FILTER (10 * n_dup_lines > n_words)}]) AS x
  FROM counts GROUP BY host),
sums AS (
  SELECT x.rule AS rule, sum(n) AS docs, sum(x.f) / sum(n) AS m,
         sum(x.f * x.f / n) - sum(x.f) * sum(x.f) / sum(n) AS spread, count(*) AS hosts, sum(n * n) / sum(n) AS even
  FROM hosts GROUP BY 1),
priors AS (
  SELECT rule, m, least(greatest(m * (1 - m) / greatest((spread - (hosts - 1) * m * (1 - m)) / greatest(docs - even, 1.0), 1e-9) - 1, 1.0), 1000.0) AS s
  FROM sums),
verdicts AS (
  SELECT host, max((x.f + s * m) / (n + s)) > 0.8 AS host_failed
  FROM hosts JOIN priors ON rule = x.rule GROUP BY host),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT host_failed AS kept, b.host AS host, host_failed
FROM base b JOIN verdicts v ON b.host IS NOT DISTINCT FROM v.host
"""


@query("op2_host_rules", HOST_RULES_SQL)
def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host", "host_failed"
    )


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS symbols,
         (CAST('0x' || substring(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM documents),
keyed AS (SELECT doc_id, source, size, -ln(u) / ((1.0 + size) / (1 + size + 4 * symbols)) AS key FROM sized),
sources AS (SELECT source, sum(size) AS source_size FROM keyed GROUP BY source),
weighed AS (
  SELECT *, 3.0 * source_size AS cap, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0 AS weight FROM sources),
leveled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE), CAST(max(CASE WHEN level * weight <= cap THEN level END) OVER () * weight AS DOUBLE)) AS target FROM leveled),
parts AS (SELECT *, coalesce(CAST(floor(target / nullif(source_size, 0)) AS BIGINT), 0) AS epochs FROM targets),
placed AS (
  SELECT k.*, source_size, target, epochs, target - epochs * source_size AS rest,
         sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS through
  FROM keyed k JOIN parts p ON k.source IS NOT DISTINCT FROM p.source),
gaps AS (SELECT *, rest - coalesce(max(CASE WHEN through <= rest THEN through END) OVER (PARTITION BY source), 0) AS gap FROM placed),
fills AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN through > rest AND size > 0 AND abs(gap - size) < gap THEN abs(gap - size) END NULLS LAST, key, doc_id) AS nearest
  FROM gaps)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(size * (epochs + CASE WHEN through <= rest OR (nearest = 1 AND size > 0 AND abs(gap - size) < gap) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM fills
"""


@query("op8_mix_sources", MIX_SQL)
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


JACCARD_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM split WHERE len(words) > 0),
sets AS (SELECT DISTINCT doc_id, array_to_string(list_slice(words, i, i + 4), ' ') AS shingle FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(least_b, s.doc_id)) AS component_id
FROM split s LEFT JOIN sizes z ON z.doc_id = s.doc_id
LEFT JOIN (SELECT a, min(b) AS least_b FROM reach GROUP BY a) r ON r.a = s.doc_id
"""


@query("op6_signature_tree_join", JACCARD_SQL)
def op6_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))


REPEATS_SQL = r"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM split),
wins AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 12), ' ') AS w FROM starts),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS owner FROM wins) WHERE owner < doc_id),
covered AS (SELECT DISTINCT doc_id, i + k AS i FROM again CROSS JOIN range(13) t(k)),
words AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM split),
kept AS (
  SELECT w.doc_id, count(c.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY w.i) FILTER (c.i IS NULL), '') AS kept
  FROM words w LEFT JOIN covered c ON c.doc_id = w.doc_id AND c.i = w.i GROUP BY w.doc_id)
SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id
"""


@query("op7_seed_extend", REPEATS_SQL)
def op7_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = remove_repeats(read_table(spark, sf_dir, "documents"))
    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda s, r: s + r[1] - r[0])
    return made.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op1_pu_quality")
def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    made = pu_quality.score(docs, pu_quality.train(docs, read_table(spark, sf_dir, "labels")))
    return made.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= pu_quality.ACCEPT).cast("int").alias("predicted"))


@query("op4_toxic_cnn")
def op4_toxic_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    made = toxic_cnn.train_and_score(docs, read_table(spark, sf_dir, "labels"))
    return made.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= toxic_cnn.TOXIC).cast("int").alias("predicted"), "threshold", "flagged")


@query("op3_trie_token_counts")
def op3_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op5_pii_surrogates")
def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, spans="entities")
    return made.select("doc_id", "text", F.size("entities").alias("n_entities"), "entities")


#: DuckDB has no crc32: the table of its byte steps, and the checksum of a list of bytes.
CRC_TABLE = """SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
    FROM range(256) r(i))"""


def crc32_sql(text: str) -> str:
    """The checksum of a text of code points below U+0800 in UTF-8; ``t`` is the table's list."""
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(unicode(c) AS BIGINT))"
    octets = f"flatten(list_transform({codes}, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 + (c >> 6), 128 + (c & 63)] END))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])))"


SPELLING_SQL = f"""
WITH RECURSIVE crc AS ({CRC_TABLE}),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
  FROM documents),
hashed AS (
  SELECT run, n, {crc32_sql("coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run")} AS h
  FROM (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL) CROSS JOIN crc),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 97 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
skips AS (SELECT word, substring(word, 1, i - 1) AS a, substring(word, i + 1) AS b FROM places),
pairs AS (
  SELECT x.word AS u, y.word AS v FROM skips x JOIN skips y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT s.word, w.word FROM skips s JOIN words w ON w.word = s.a || s.b
  UNION SELECT w.word, s.word FROM skips s JOIN words w ON w.word = s.a || s.b),
ranked AS (
  SELECT u, v, n, row_number() OVER (PARTITION BY u ORDER BY n DESC, v) AS r, count(*) OVER (PARTITION BY u) AS n_near
  FROM pairs JOIN words ON word = v),
forms AS (
  SELECT w.word, CASE WHEN r.n >= 2 * w.n THEN v END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n
  FROM words w LEFT JOIN ranked r ON u = w.word AND r = 1),
chain AS (
  SELECT word, word AS up, 0 AS d FROM forms
  UNION ALL SELECT c.word, f.form, d + 1 FROM chain c JOIN forms f ON f.word = c.up WHERE f.form IS NOT NULL)
SELECT f.word, form, (SELECT arg_max(up, d) FROM chain c WHERE c.word = f.word) AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM forms f
"""


@query("op11_spelling_trie_pairs", SPELLING_SQL)
def op11_spelling_trie_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read_table(spark, sf_dir, "documents"))


@query("op12_multi_index_hashing")
def op12_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 50 = 0"), k=5)


TRIE_SQL = f"""
WITH crc AS ({CRC_TABLE}),
rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (
  SELECT conv_id, digest, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place
  FROM (SELECT conv_id, turn, md5(length(role) || ':' || role || text) AS digest, length(text) AS chars FROM rows)),
convs AS (
  SELECT conv_id, own, conv_id - conv_id % 100 AS base, {crc32_sql("CAST(conv_id AS VARCHAR)")} % 6 AS h
  FROM (SELECT conv_id, count(*) AS own FROM rows GROUP BY conv_id) CROSS JOIN crc),
led AS (
  SELECT c.*, least(h, coalesce(b.own, 0)) AS lead FROM convs c LEFT JOIN (SELECT conv_id AS base, own FROM convs) b USING (base)),
seqs AS (
  SELECT c.conv_id, place AS depth, digest, chars FROM led c JOIN turns t ON t.conv_id = c.base AND place <= lead
  UNION ALL SELECT c.conv_id, lead + place - h, digest, chars FROM led c JOIN turns t ON t.conv_id = c.conv_id AND place > h),
steps AS (
  SELECT conv_id, depth, chars, md5(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS key,
         depth = max(depth) OVER (PARTITION BY conv_id) AS is_end
  FROM seqs),
linked AS (SELECT *, coalesce(lag(key) OVER (PARTITION BY conv_id ORDER BY depth), 'root') AS above FROM steps),
nodes AS (
  SELECT key, min(above) AS above, count(*) AS n_convs, min(conv_id) AS conv_id, min(depth) AS depth, min(chars) AS chars FROM linked GROUP BY key
  UNION ALL SELECT 'root', NULL, count(*), min(conv_id), 0, 0 FROM convs HAVING count(*) > 0),
kids AS (SELECT above AS key, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
tree AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (key)),
paths AS (
  SELECT s.key, (n_children = 0)::BIGINT AS leaf, (n_convs - 1) * t.chars AS saved FROM tree t JOIN steps s ON s.conv_id = t.conv_id AND s.depth <= t.depth
  UNION ALL SELECT 'root', (n_children = 0)::BIGINT, (n_convs - 1) * chars FROM tree),
totals AS (SELECT key, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM paths GROUP BY key),
ends AS (
  SELECT key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT key, conv_id FROM steps WHERE is_end UNION ALL SELECT 'root', conv_id FROM convs WHERE conv_id NOT IN (SELECT conv_id FROM steps))
  GROUP BY key)
SELECT t.conv_id, CAST(t.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, t.n_convs, t.n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(ends_sha256, sha256('')) AS ends_sha256
FROM tree t LEFT JOIN tree p ON p.key = t.above LEFT JOIN totals o ON o.key = t.key LEFT JOIN ends e ON e.key = t.key
"""


@query("op13_prefix_trie_contraction", TRIE_SQL)
def op13_prefix_trie_contraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))
