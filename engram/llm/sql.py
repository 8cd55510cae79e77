"""DuckDB SQL of operators 1, 2 and 6, by brute force: for small inputs."""

from __future__ import annotations

OP1_SQL = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c0 AS (SELECT doc_id, h, greatest(0, CAST(length(h) / 2 AS BIGINT) - 49) AS n FROM b),
c1 AS (SELECT doc_id, base, least(500, n - base) AS n, substring(h, 2 * base + 1, 1098) AS part FROM (SELECT doc_id, h, n, unnest(range(0, n, 500)) AS base FROM c0)),
w AS (SELECT doc_id, base + q AS p, substring(part, 2 * q + 1, 100) AS g FROM (SELECT doc_id, base, part, unnest(range(0, n)) AS q FROM c1)),
m AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g),
hit AS (SELECT w.doc_id, w.p FROM w JOIN m ON w.g = m.g WHERE w.doc_id > m.first),
i AS (SELECT *, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS begins FROM hit),
k AS (SELECT *, sum(begins) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM i),
s AS (SELECT doc_id, span, min(p) AS a, max(p) + 50 AS z FROM k GROUP BY doc_id, span),
c AS (SELECT s.*, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
parts AS (
  SELECT c.doc_id, c.a AS place, substring(b.h, 2 * c.before + 1, 2 * (c.a - c.before)) AS part FROM c JOIN b ON c.doc_id = b.doc_id
  UNION ALL SELECT b.doc_id, length(b.h), substring(b.h, 2 * coalesce(e.z, 0) + 1) FROM b LEFT JOIN (SELECT doc_id, max(z) AS z FROM s GROUP BY doc_id) e ON b.doc_id = e.doc_id),
kept AS (SELECT doc_id, string_agg(part, '' ORDER BY place) AS h FROM parts GROUP BY doc_id),
n AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT b.doc_id, CAST(length(b.h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n.n_removed, 0) AS BIGINT) AS n_removed, coalesce(n.n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM b JOIN kept ON b.doc_id = kept.doc_id LEFT JOIN n ON b.doc_id = n.doc_id
"""

OP2_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[k] || ' ' || w[k + 1] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w)))) AS k FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON p.x = nx.doc_id JOIN n ny ON p.y = ny.doc_id WHERE 100 * k >= 80 * (nx.n + ny.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM t UNION SELECT e.y, r.c FROM r JOIN e ON r.doc_id = e.x)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id, r.doc_id = min(r.c) AS kept FROM r LEFT JOIN n ON r.doc_id = n.doc_id GROUP BY r.doc_id
"""

OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS d FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND d IS NOT NULL AND len(list_filter(d, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(d, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.d) = len(b.d) WHERE list_cosine_similarity(a.d, b.d) >= 0.98),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x),
r AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT l.y, r.c FROM r JOIN l ON r.vec_id = l.x)
SELECT r.vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.c) AS component_id, r.vec_id = min(r.c) AS kept FROM r LEFT JOIN n ON r.vec_id = n.x GROUP BY r.vec_id
"""
