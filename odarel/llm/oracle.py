"""SQL for the queries that SQL can express, for DuckDB."""

from __future__ import annotations

from odarel.llm.secrets import RULES

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

LINES = """
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
b AS (SELECT trim(line, ' ') AS line FROM l WHERE length(trim(line, ' ')) >= 1 GROUP BY 1 HAVING count(DISTINCT source) >= 5),
k AS (SELECT doc_id, count(*) AS n_lines, count(b.line) AS n_removed,
  coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE b.line IS NULL), '') AS text
FROM l LEFT JOIN b ON trim(l.line, ' ') = b.line GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, k.text FROM documents d LEFT JOIN k USING (doc_id)
"""


def _rule(i: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Places of a rule's matches from the pieces between them."""
    quoted = pattern.replace("'", "''")
    return f"""
SELECT doc_id, {i} AS rank, '{kind}' AS kind, a + g AS start, a + g + h AS stop FROM (
  SELECT doc_id, length(gaps[k]) AS g, length(hits[k]) AS h, length(vals[k]) AS v, coalesce(list_sum(list_transform(gaps[1:k-1], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:k-1], lambda x: length(x))), 0) AS a
  FROM (SELECT doc_id, gaps, hits, vals, unnest(range(1, len(hits) + 1)) AS k FROM (
    SELECT doc_id, string_split_regex(text, '{quoted}') AS gaps, regexp_extract_all(text, '{quoted}') AS hits, regexp_extract_all(text, '{quoted}', {group}) AS vals FROM documents WHERE regexp_matches(text, '{quoted}'))))
WHERE v >= {least}"""


SECRETS = f"""
WITH s AS ({" UNION ALL ".join(_rule(i, r.kind, r.pattern, r.group, r.least) for i, r in enumerate(RULES))}),
j AS (SELECT doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{r.kind}') AS n_{r.kind}" for r in RULES)},
  string_agg(concat_ws(':', kind, start::BIGINT, stop::BIGINT), ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in RULES)}, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN j USING (doc_id)
"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x, label FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
root AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM e WHERE e.a = vec_id) AS n_links, root AS component_id, root = vec_id AS kept FROM v JOIN root ON root.a = vec_id
"""

WINNOW = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, n, array_to_string(w[k+1:k+n], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(0, len(w) - least(10, len(w)) + 1)) AS k FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, n, k, array_to_string(w[k+1:k+n], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(0, greatest(0, len(w) - n + 1))) AS k FROM d, (SELECT DISTINCT n FROM i))),
h AS (SELECT DISTINCT doc_id, item_id, g.n, k FROM g JOIN i ON g.n = i.n AND g.g = i.g),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY 1),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[k+1:k+n], ' ')) AS g FROM (SELECT doc_id, w, least(5, len(w)) AS n, unnest(range(0, len(w) - least(5, len(w)) + 1)) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
root AS (SELECT a, min(b) AS root FROM reach GROUP BY a)
SELECT doc_id, root AS class_id, (SELECT count(*) FROM e WHERE e.a = doc_id) AS n_links, root = doc_id AS kept FROM d JOIN root ON root.a = doc_id
"""

ORACLE = {"op4_line_dedup": LINES, "op6_secrets": SECRETS, "op8_near_vectors": VECTORS, "op9_contamination": WINNOW, "op10_jaccard": JACCARD}
