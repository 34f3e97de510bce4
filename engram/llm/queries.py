"""The registered queries of the corpus operators, and their DuckDB twins.

Each query applies its operator with production parameters to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, fingerprints, hilbert, html, jaccard, langid, license, merkle, mixing, suffix, tokencount, toxicity
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


# Targets by repeated sharing out, quotas from every quotient of every party.
ORACLE["op1_mix_sources"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17:' || coalesce(doc_id::VARCHAR, '-')) AS ord
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source),
tot AS (SELECT 1.5 * sum(source_size) AS total FROM src),
lv AS (
  SELECT 0 AS step, 0.0::DOUBLE AS level
  UNION ALL
  SELECT step + 1, (SELECT ((SELECT total FROM tot) - coalesce(sum(2.0 * source_size) FILTER (2.0 * source_size <= lv.level * w), 0))
                    / sum(w) FILTER (2.0 * source_size > lv.level * w) FROM src)
  FROM lv WHERE step < 64),
targets AS (
  SELECT source, source_size, w, least(2.0 * source_size, (SELECT max(level) FROM lv) * w)::DOUBLE AS target FROM src),
nb AS (SELECT round(sum(target) / 64)::BIGINT AS n FROM targets),
q1 AS (
  SELECT source, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, source NULLS LAST, k) AS r
  FROM (SELECT source, target, unnest(range(1, (ceil(target / 64) + 40)::BIGINT)) AS k FROM targets)),
sq AS (
  SELECT t.source, t.source_size, t.target, greatest(1, ceil(t.source_size / 262144))::BIGINT AS shards,
         (SELECT count(*) FROM q1 WHERE q1.source IS NOT DISTINCT FROM t.source AND r <= (SELECT n FROM nb)) AS quota
  FROM targets t),
ds AS (
  SELECT d.*, sq.source_size, sq.target, sq.quota AS source_quota,
         ('0x' || substr(ord, 25, 8))::BIGINT % shards AS shard
  FROM d JOIN sq ON d.source IS NOT DISTINCT FROM sq.source),
sh AS (SELECT source, shard, source_quota, sum(size)::BIGINT AS sw FROM ds GROUP BY ALL),
q2 AS (
  SELECT source, shard, source_quota,
         row_number() OVER (PARTITION BY source ORDER BY sw / (2 * k - 1) DESC, shard, k) AS r
  FROM (SELECT *, unnest(range(1, source_quota + 2)) AS k FROM sh WHERE sw > 0)),
shq AS (
  SELECT sh.source, sh.shard, ceil(sw / 64)::BIGINT AS blocks,
         (SELECT count(*) FROM q2 WHERE q2.source IS NOT DISTINCT FROM sh.source AND q2.shard = sh.shard
          AND r <= q2.source_quota) AS quota
  FROM sh),
pos AS (
  SELECT *, row_number() OVER w AS place, sum(size) OVER w - size AS st
  FROM ds WINDOW w AS (PARTITION BY source, shard ORDER BY ord, doc_id, size ROWS UNBOUNDED PRECEDING)),
bl AS (
  SELECT source, shard, b, row_number() OVER (PARTITION BY source, shard
         ORDER BY md5('17:' || shard::VARCHAR || ':' || b::VARCHAR), b) AS r, blocks, quota
  FROM (SELECT *, unnest(range(0, blocks)) AS b FROM shq)),
taken AS (
  SELECT p.source, p.shard, p.place,
         sum((least(st + size, (b + 1) * 64) - greatest(st, b * 64))
             * (least(quota, 2 * blocks) // blocks + (r <= least(quota, 2 * blocks) % blocks)::INT)) AS taken
  FROM pos p JOIN bl ON p.source IS NOT DISTINCT FROM bl.source AND p.shard = bl.shard
   AND p.size > 0 AND b BETWEEN st // 64 AND (st + size - 1) // 64
  GROUP BY ALL)
SELECT p.doc_id, p.source, p.size, p.source_size, p.target, coalesce(t.taken, 0)::BIGINT AS taken
FROM pos p LEFT JOIN taken t ON p.source IS NOT DISTINCT FROM t.source AND p.shard = t.shard AND p.place = t.place
"""


@query
def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.document_token_counts(table(spark, sf_dir, "documents"),
                                            public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query
def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents"), words=3, threshold=(9, 10))


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"),
                                public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query
def op6_hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.nearest(table(spark, sf_dir, "embeddings"))


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents"))


@query
def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                           public_tokenizers.path("piece_bpe_32k.model"))


@query
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_manifest(table(spark, sf_dir, "documents"))


# Levels by repeated grouping of runs, proofs by a walk from every leaf; CRC-32 bit by bit.
ORACLE["op13_merkle_manifest"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text,
         xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda h, c: list_reduce(list_prepend(xor(h, c), range(8)),
             lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))) AS crc
  FROM documents),
f AS (
  SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other,
         coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-')
         || coalesce(octet_length(encode(source)) || ':' || source, '-')
         || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
         || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head
  FROM d),
leaf AS (
  SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS digest,
         sha256(head || coalesce(octet_length(encode(other)) || ':' || other, '-')) AS start
  FROM f),
placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, digest) - 1 AS idx,
         count(*) OVER (PARTITION BY source) AS size
  FROM leaf),
low AS (
  SELECT tree, 0 AS level, idx, digest, size FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (size + 2) // 3
  FROM low WHERE size > 1 GROUP BY tree, level, idx // 3, size),
high AS (
  SELECT -1 AS tree, 0 AS level, tree AS idx, digest, (SELECT count(DISTINCT tree) FROM placed) AS size
  FROM low WHERE size = 1
  UNION ALL
  SELECT tree, level + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (size + 2) // 3
  FROM high WHERE size > 1 GROUP BY tree, level, idx // 3, size),
nodes AS (SELECT * FROM low UNION ALL SELECT * FROM high),
segments AS (
  SELECT tree, level, idx, size,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM nodes WINDOW w AS (PARTITION BY tree, level, idx // 3 ORDER BY idx)),
walk AS (
  SELECT row_number() OVER () AS leaf_no, doc_id, digest AS leaf, tree AS own, tree, 0 AS level, idx, start AS h, '' AS siblings
  FROM placed
  UNION ALL
  SELECT leaf_no, doc_id, leaf, own, CASE WHEN s.size = 1 THEN -1 ELSE w.tree END,
         CASE WHEN s.size = 1 THEN 0 ELSE w.level + 1 END, CASE WHEN s.size = 1 THEN w.tree ELSE w.idx // 3 END,
         CASE WHEN s.size = 1 THEN h ELSE sha256(s.l || h || s.r) END,
         CASE WHEN s.size = 1 THEN siblings ELSE siblings || s.l || s.r END
  FROM walk w JOIN segments s ON s.tree = w.tree AND s.level = w.level AND s.idx = w.idx
  WHERE NOT (s.size = 1 AND s.tree = -1)),
ended AS (
  SELECT w.* FROM walk w JOIN segments s ON s.tree = w.tree AND s.level = w.level AND s.idx = w.idx
  WHERE s.size = 1 AND s.tree = -1)
SELECT doc_id, leaf, t.digest AS subroot, r.digest AS root, sha256(siblings) AS proof_sha256, h AS folded_root,
       h = r.digest AS verified
FROM ended JOIN low t ON t.tree = ended.own AND t.size = 1 JOIN (SELECT digest FROM high WHERE size = 1) r ON true
"""
