"""The queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docframe.llm import bpe, context_mixing, cover_tree, html_tree, lexical_index, media, packing, prefix_trie, quality, simhash, sketch, token_store, toxicity
from docframe.llm.shared import new_path

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "tokens")
    token_store.write_token_table(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path, end_id=1)
    return token_store.with_checksum(token_store.read_token_table(spark, path))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract_main_text(_read(spark, sf_dir, "pages"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read(media.store(_read(spark, sf_dir, "documents")), tensors=False)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score_documents(_read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(_read(spark, sf_dir, "documents"), shingle=3, seed=42, radius=2)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sketch.fingerprint_documents(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", sketch.as_text(F.col("sketch")).alias("fingerprint"), sketch.as_text(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next", "distinct_estimate", "kept_share")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie_of(_read(spark, sf_dir, "conversations"), rebuild=True)


PREFIX_TRIE_SQL = """
WITH convs AS (
  SELECT conv_id, CAST(xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), CAST(4294967295 AS BIGINT)), 4294967295) % 9 AS BIGINT) AS h,
    list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, list_concat(CASE WHEN d.turns IS NULL THEN [] ELSE d.turns[1:c.h] END, c.turns[c.h + 1:]) AS turns
  FROM convs c LEFT JOIN convs d ON d.conv_id = c.conv_id - c.conv_id % 5),
steps AS (SELECT conv_id, depth, len(turns) AS length, turns[1:depth] AS path, CASE WHEN depth = 0 THEN 0 ELSE strlen(turns[depth].text) END AS bytes FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt)),
named AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, path) AS node FROM steps),
nodes AS (
  SELECT depth, node, count(*) AS n_convs, any_value(bytes) * (count(*) - 1) AS saved, any_value(path) AS path,
    sha256(coalesce(string_agg(CASE WHEN length = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends
  FROM named GROUP BY depth, node),
linked AS (SELECT n.*, u.node AS parent FROM nodes n LEFT JOIN named u ON u.conv_id = n.node AND u.depth = n.depth - 1),
children AS (SELECT parent, depth - 1 AS depth, count(*) AS n FROM linked WHERE depth > 0 GROUP BY ALL),
sums AS (
  SELECT up.node, up.depth, sum(l.saved) AS saved, count(*) FILTER (WHERE c.n IS NULL) AS leaves
  FROM linked l JOIN named up ON up.conv_id = l.node AND up.depth <= l.depth LEFT JOIN children c ON c.parent = l.node AND c.depth = l.depth GROUP BY ALL)
SELECT l.node AS conv_id, l.depth, l.parent AS parent_conv_id, l.n_convs, CAST(coalesce(c.n, 0) AS BIGINT) AS n_children, CAST(s.leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, l.ends AS ends_sha256
FROM linked l JOIN sums s ON s.node = l.node AND s.depth = l.depth LEFT JOIN children c ON c.parent = l.node AND c.depth = l.depth
"""


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_index.top_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=10)


LEXICAL_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents WHERE doc_id IS NOT NULL),
uses AS (SELECT doc_id, unnest(terms) AS term FROM docs),
tf AS (SELECT doc_id, term, count(*) AS tf FROM uses WHERE term <> '' GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY doc_id),
totals AS (SELECT count(*) AS N, CAST(sum(n) AS BIGINT) AS L FROM sizes),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
items AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
weights AS (SELECT i.item_id, i.term, CAST(floor(1000 * ln(CAST(2 * t.N + 2 AS DOUBLE) / CAST(2 * d.df + 1 AS DOUBLE))) AS BIGINT) AS w FROM items i JOIN dfs d ON d.term = i.term, totals t),
scored AS (
  SELECT w.item_id, f.doc_id, CAST(sum(w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (10 + (90 * s.n * t.N) // t.L)))) AS BIGINT) AS score
  FROM weights w JOIN tf f ON f.term = w.term JOIN sizes s ON s.doc_id = f.doc_id, totals t GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, factor=256)


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.v, d.v) AS BIGINT) AS score FROM v q JOIN v d ON d.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0))
WHERE rank <= 5
"""


def queries() -> dict[str, Query]:
    found = [op1_token_store, op2_packing, op3_bpe, op4_html, op5_media, op6_mixing, op7_simhash, op8_quality, op9_sketch, op10_toxicity, op11_prefix_trie, op12_lexical_search, op13_top_k]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op11_prefix_trie": PREFIX_TRIE_SQL, "op12_lexical_search": LEXICAL_SQL, "op13_top_k": TOP_K_SQL}
