"""The ten operators' queries over the given tables, and SQL where it can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridfront.llm import bpe, fingerprint, langid, packing, pii, quality, simhash, substring, urls, vectors

#: Fixed values: (verdict, host, path) of the URL rules.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited(table(spark, sf_dir, "documents"))


def op2_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024, 0)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), RULES, urls.train(urls.labelled_urls(spark)))


def op4_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_duckdb_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_rabin_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(table(spark, sf_dir, "documents"))


def op8_random_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op9_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_recurrent_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
), pairs AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.93
), reach AS (
  SELECT u, v FROM pairs
  UNION
  SELECT r.u, p.v FROM reach r JOIN pairs p ON r.v = p.u
), n AS (SELECT u, count(*) AS n_links FROM pairs GROUP BY u),
 c AS (SELECT u, min(v) AS least FROM reach GROUP BY u)
SELECT e.vec_id, coalesce(n.n_links, 0) AS n_links, least(coalesce(c.least, e.vec_id), e.vec_id) AS component_id,
       e.vec_id <= coalesce(c.least, e.vec_id) AS kept
FROM embeddings e LEFT JOIN n ON n.u = e.vec_id LEFT JOIN c ON c.u = e.vec_id
"""

OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)
), f AS (SELECT s, min(doc_id) AS lo FROM win GROUP BY s),
 hit AS (SELECT win.doc_id, win.i FROM win JOIN f USING (s) WHERE win.doc_id > f.lo),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM hit),
 g AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN ks IS NULL THEN ws ELSE list_filter(ws, lambda x, k: NOT list_contains(ks, k)) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g ON g.doc_id = w.doc_id
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_quartile_digest, op2_concatenate_and_cut, op3_url_filter, op4_simhash_trie, op5_duckdb_bpe, op6_multi_index, op7_rabin_karp, op8_random_field, op9_random_indexing, op10_recurrent_language)}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": urls.judge_sql(RULES), "op6_multi_index": OP6_SQL, "op7_rabin_karp": OP7_SQL}
