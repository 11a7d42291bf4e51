"""DuckDB SQL for those corpus queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(column: str, gap: str) -> str:
    return f"list_filter(regexp_split_to_array(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), '{gap}'), lambda x: x <> '')"


_ITEM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_words("text", _ITEM_GAP)} AS ws FROM documents),
b AS (SELECT item_id, {_words("text", _ITEM_GAP)} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS m, unnest(list_transform(range(1, len(ws) - least(len(ws), 10) + 2), lambda i: array_to_string(ws[i:i + least(len(ws), 10) - 1], ' '))) AS w FROM b WHERE len(ws) > 0),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT r, m, unnest(range(1, len(ws) - m + 2)) AS i, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS w FROM d, ms WHERE len(ws) >= m),
hits AS (SELECT r, i, dw.m AS m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.w = bw.w),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + m)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

MINHASH = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words("text", "[ \\x09-\\x0D]+")} AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM d),
u AS (SELECT doc_id, unnest(sh) AS g FROM s),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM u a JOIN u b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN s a ON x = a.doc_id JOIN s b ON y = b.doc_id WHERE 100 * k >= 80 * (len(a.sh) + len(b.sh) - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""

EMBEDDINGS = """
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
g AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM e WHERE label IS NOT NULL AND len(v) > 0
  AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM e UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x),
k AS (SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)
"""

_FOURS = ", ".join(f"'{i:04b}'" for i in range(16))
_FIVE = " + ".join(f"{16 >> j} * CAST(substr(bits, CAST(5 * k + {j + 1} AS BIGINT), 1) AS INT)" for j in range(5))
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, array_to_string(list_transform(string_split(sha1(h), ''), lambda c: [{_FOURS}][strpos('0123456789abcdef', c)]), '') AS bits, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {_FIVE}, 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM d
"""

SQL = {"op3_decontaminate": DECONTAMINATE, "op5_minhash": MINHASH, "op7_embedding_dedup": EMBEDDINGS, "op8_warc": WARC}
