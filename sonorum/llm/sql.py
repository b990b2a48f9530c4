"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

TOPK = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id,
         list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda t: t[1] * t[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), r AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

WARC = """
WITH p AS (
  SELECT CAST(page_id AS BIGINT) AS page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), b AS (SELECT h, max(page_id) AS best FROM p GROUP BY h),
w AS (
  SELECT p.page_id, strlen(html) AS payload_bytes, best,
         list_transform(range(0, 160, 5), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (
           (CAST('0x' || substr(p.h || '00', CAST(k // 4 + 1 AS INTEGER), 3) AS BIGINT) >> CAST(12 - 5 - k % 4 AS INTEGER)) & 31) AS INTEGER), 1)) AS c
  FROM p JOIN b USING (h)
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string(c, '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = best THEN NULL ELSE best END AS refers_to
FROM w
"""

LINES = r"""
WITH d AS (SELECT row_number() OVER () AS r, CAST(doc_id AS BIGINT) AS doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (
  SELECT r, doc_id, i, l[i] AS line,
         translate(trim(l[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT r, doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d)
),
f AS (SELECT k FROM e WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10)
SELECT e.doc_id, count(*) AS n_lines, count(f.k) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN f.k IS NULL THEN line END, chr(10) ORDER BY i), '')) AS kept_sha256
FROM e LEFT JOIN f ON e.k = f.k GROUP BY e.r, e.doc_id
"""

ORACLES = {"op1_exact_topk": TOPK, "op6_warc": WARC, "op9_line_dedup": LINES}
