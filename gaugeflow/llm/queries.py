"""The registered corpus queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gaugeflow.llm.alignment import op12_alignment
from gaugeflow.llm.chat import rotate_perspectives
from gaugeflow.llm.decontaminate import find_leaks
from gaugeflow.llm.embeddings import near_vectors
from gaugeflow.llm.packing import pack
from gaugeflow.llm.pii import op1_pii
from gaugeflow.llm.prefix_trie import op11_prefix_trie
from gaugeflow.llm.quality import op5_quality
from gaugeflow.llm.quality_rules import op13_quality_rules
from gaugeflow.llm.secrets import op10_secrets
from gaugeflow.llm.sharding import shard_documents
from gaugeflow.llm.simhash import op2_simhash
from gaugeflow.llm.toxicity import op4_toxicity


def _over(operator: Callable[..., DataFrame], *tables: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(*[spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in tables])

    query.__doc__ = operator.__doc__
    return query


LLM_QUERIES = {
    "op1_pii": _over(op1_pii, "documents"),
    "op2_simhash": _over(op2_simhash, "documents"),
    "op3_chat": _over(rotate_perspectives, "conversations"),
    "op4_toxicity": _over(op4_toxicity, "documents", "labels"),
    "op5_quality": _over(op5_quality, "documents", "labels"),
    "op6_sharding": _over(shard_documents, "documents"),
    "op7_packing": _over(pack, "documents"),
    "op8_decontamination": _over(find_leaks, "documents", "benchmark"),
    "op9_embeddings": _over(near_vectors, "embeddings"),
    "op10_secrets": _over(op10_secrets, "documents"),
    "op11_prefix_trie": _over(op11_prefix_trie, "conversations"),
    "op12_alignment": _over(op12_alignment, "documents"),
    "op13_quality_rules": _over(op13_quality_rules, "documents", "labels"),
}

_CHAT_SQL = """
WITH plain AS (
  SELECT conv_id, turn, replace(coalesce(text, ''), '<|', '< |') AS text,
         coalesce(nullif(trim(replace(coalesce(role, ''), '<|', '< |')), ''), 'unnamed') AS name
  FROM conversations),
speakers AS (SELECT DISTINCT conv_id, name AS perspective FROM plain WHERE name <> 'system'),
counted AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, name, text) - 1) AS place FROM plain),
cut AS (
  SELECT conv_id, name, text, place, place // 64 AS part, max(place // 64) OVER (PARTITION BY conv_id) AS last,
         place < 64 AND name = 'system' AS opens FROM counted),
shown AS (
  SELECT conv_id, part, 2 AS kind, place, name, text FROM cut
  UNION ALL SELECT conv_id, unnest(range(1, last + 1)), 0, place, name, text FROM cut WHERE opens
  UNION ALL SELECT conv_id, part + 1, 1, place, name, text FROM cut
            WHERE part < last AND place >= (part + 1) * 64 - 8 AND NOT opens),
pieces AS (
  SELECT p.conv_id, s.perspective, p.part, p.kind, p.place AS turn, p.name, p.text,
         p.kind = 2 AND p.name = s.perspective AS own,
         CASE WHEN p.name = 'system' THEN '<|system|>' WHEN p.name = s.perspective THEN '<|assistant|>'
              ELSE '<|user:' || p.name || '|>' END || chr(10) AS head
  FROM shown p JOIN speakers s ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
placed AS (
  SELECT *, head || text || '<|end|>' || chr(10) AS whole,
         row_number() OVER w AS place,
         coalesce(sum(length(head || text) + 8) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM pieces WINDOW w AS (PARTITION BY conv_id, perspective, part ORDER BY kind, turn))
SELECT conv_id, perspective, part, CAST(count(*) FILTER (WHERE kind = 2) AS INTEGER) AS n_turns,
       string_agg(whole, '' ORDER BY place) AS text,
       coalesce(string_agg(CAST(start + length(head) AS BIGINT) || ':' || CAST(start + length(whole) - 1 AS BIGINT), ',' ORDER BY place)
                FILTER (WHERE own), '') AS mask,
       CAST(coalesce(sum(length(whole) - 1 - length(head)) FILTER (WHERE own), 0) AS INTEGER) AS n_masked
FROM placed GROUP BY conv_id, perspective, part
"""

_SECRETS_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
found AS (
  SELECT row, 1 AS rank, 'assign' AS kind, 6 AS least,
         regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS whole,
         regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) AS own,
         string_split_regex(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gaps
  FROM docs
  UNION ALL
  SELECT row, 2, 'access', 20, regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0), regexp_extract_all(text, 'AKIA[A-Z0-9]+', 0),
         string_split_regex(text, 'AKIA[A-Z0-9]+') FROM docs
  UNION ALL
  SELECT row, 3, 'hex', 24, regexp_extract_all(text, '[0-9a-f]{24,}', 0), regexp_extract_all(text, '[0-9a-f]{24,}', 0),
         string_split_regex(text, '[0-9a-f]{24,}') FROM docs
  UNION ALL
  SELECT row, 4, 'pem', 1, regexp_extract_all(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0),
         regexp_extract_all(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----', 0), string_split_regex(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') FROM docs
  UNION ALL
  SELECT row, 5, 'forge', 1, regexp_extract_all(text, 'gh[pousr]_[A-Za-z0-9]{36,}', 0),
         regexp_extract_all(text, 'gh[pousr]_[A-Za-z0-9]{36,}', 0), string_split_regex(text, 'gh[pousr]_[A-Za-z0-9]{36,}') FROM docs),
each AS (
  SELECT row, rank, kind, least, i, length(whole[i]) AS size, length(own[i]) AS deciding,
         sum(length(gaps[i]) + length(whole[i])) OVER (PARTITION BY row, rank ORDER BY i) AS ends
  FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM found)),
spans AS (
  SELECT row, string_agg(kind || ':' || CAST(ends - size AS BIGINT) || ':' || CAST(ends AS BIGINT), ',' ORDER BY ends - size, rank) AS spans,
         coalesce(string_agg(kind || ':' || CAST(ends - size AS BIGINT) || ':' || CAST(ends AS BIGINT), ',' ORDER BY ends - size, rank)
                  FILTER (WHERE rank <= 3), '') AS base,
         count(*) FILTER (WHERE rank = 1) AS n_assign, count(*) FILTER (WHERE rank = 2) AS n_access, count(*) FILTER (WHERE rank = 3) AS n_hex
  FROM each WHERE deciding >= least GROUP BY row)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN spans USING (row)
"""

_TRIE_SQL = """
WITH ordered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place, digest, points
  FROM (SELECT conv_id, turn, length(coalesce(text, '')) AS points,
               md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
        FROM conversations WHERE conv_id IS NOT NULL)),
sizes AS (
  SELECT conv_id, max(place) AS total, conv_id - conv_id % 100 AS base,
         xor(4294967295, list_reduce(list_transform(string_split('!' || CAST(conv_id AS VARCHAR), ''), lambda ch: CASE ch WHEN '!' THEN 4294967295 ELSE ord(ch)::BIGINT END),
             lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))) % 6 AS h
  FROM ordered GROUP BY conv_id),
plan AS (
  SELECT s.conv_id, s.base, s.h, least(s.h, coalesce(b.total, 0)) AS taken,
         least(s.h, coalesce(b.total, 0)) + greatest(s.total - s.h, 0) AS length
  FROM sizes s LEFT JOIN sizes b ON b.conv_id = s.base),
rebuilt AS (
  SELECT p.conv_id, o.place, o.digest, o.points FROM plan p JOIN ordered o ON o.conv_id = p.base AND o.place <= p.h
  UNION ALL
  SELECT p.conv_id, o.place - p.h + p.taken, o.digest, o.points FROM plan p JOIN ordered o ON o.conv_id = p.conv_id AND o.place > p.h),
paths AS (
  SELECT conv_id, 0 AS depth, '' AS node, NULL AS above, 0 AS points FROM plan
  UNION ALL
  SELECT conv_id, place, md5(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY place)),
         coalesce(md5(string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), ''),
         points FROM rebuilt),
nodes AS (
  SELECT node, min(depth) AS depth, min(conv_id) AS conv_id, any_value(above) AS above, count(*) AS n_convs, any_value(points) AS points
  FROM paths GROUP BY node),
children AS (SELECT above AS node, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above),
below AS (SELECT DISTINCT a.node AS top, b.node FROM paths a JOIN paths b ON a.conv_id = b.conv_id AND a.depth <= b.depth),
sums AS (
  SELECT top AS node, CAST(sum((n.n_convs - 1) * n.points) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE c.node IS NULL) AS n_leaves
  FROM below b JOIN nodes n ON n.node = b.node LEFT JOIN children c ON c.node = b.node GROUP BY top),
ends AS (
  SELECT a.node, string_agg(CAST(a.conv_id AS VARCHAR), ',' ORDER BY a.conv_id) AS ids
  FROM paths a JOIN plan p ON p.conv_id = a.conv_id AND p.length = a.depth GROUP BY a.node)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children,
       s.n_leaves, s.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n LEFT JOIN nodes u ON u.node = n.above LEFT JOIN children c ON c.node = n.node
JOIN sums s ON s.node = n.node LEFT JOIN ends e ON e.node = n.node
"""

LLM_ORACLES = {"op3_chat": _CHAT_SQL, "op10_secrets": _SECRETS_SQL, "op11_prefix_trie": _TRIE_SQL}
