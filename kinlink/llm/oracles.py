"""The registered queries of this subpackage that SQL can express, for DuckDB.

The others have none: byte-pair encoding (2), trained models (3, 7, 8, 10) and
random draws (5) are tested against brute force, a round trip or held-out rows.
"""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: smallest reachable node by `edges` (a, b, in both directions) of every row of `nodes` (r)
REACH = "reach AS (SELECT r AS a, r AS b FROM nodes UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b)"

OP1 = """WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS h FROM documents),
c AS (SELECT r, doc_id, unnest(range(0, len(h))) AS b, unnest(h) AS v FROM d),
w AS (SELECT r, doc_id, p, g FROM (SELECT r, doc_id, b AS p, string_agg(v, '') OVER (PARTITION BY r ORDER BY b ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING) AS g FROM c) WHERE length(g) = 100),
m AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g),
x AS (SELECT w.r, w.p FROM w JOIN m ON m.g = w.g WHERE m.first < w.doc_id),
y AS (SELECT c.r, c.b, c.v, coalesce(max(x.p) OVER (PARTITION BY c.r ORDER BY c.b ROWS UNBOUNDED PRECEDING) >= c.b - 49, false) AS gone FROM c LEFT JOIN x ON x.r = c.r AND x.p = c.b),
z AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY b), false) AS starts FROM y),
t AS (SELECT r, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (starts) AS n_spans, coalesce(string_agg(v, '' ORDER BY b) FILTER (NOT gone), '') AS kept FROM z GROUP BY r)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN t ON t.r = d.r"""

OP4 = f"""WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
nodes AS (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(v, lambda x: abs(x))) > 0),
edges AS (SELECT a.r AS a, b.r AS b FROM nodes a JOIN nodes b ON b.label = a.label AND len(b.v) = len(a.v) AND b.r <> a.r WHERE list_inner_product(a.v, b.v) / (a.n * b.n) >= 0.93),
{REACH},
k AS (SELECT reach.a AS r, min(o.vec_id) AS component_id FROM reach JOIN v o ON o.r = reach.b GROUP BY 1),
l AS (SELECT a AS r, count(*) AS n_links FROM edges GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(vec_id = coalesce(component_id, vec_id), false) AS kept FROM v LEFT JOIN k ON k.r = v.r LEFT JOIN l ON l.r = v.r"""

OP6 = rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, size, array_to_string(w[p : p + size - 1], ' ') AS g FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM b)),
s AS (SELECT DISTINCT size FROM i),
x AS (SELECT r, p, size, array_to_string(w[p : p + size - 1], ' ') AS g FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM d, s WHERE len(w) >= size)),
h AS (SELECT x.r, x.p, x.size, i.item_id FROM x JOIN i ON i.size = x.size AND i.g = x.g),
n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + size)) AS q FROM h) GROUP BY 1),
k AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM h WHERE item_id IS NOT NULL GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN k ON k.r = d.r"""

OP9 = rf"""WITH RECURSIVE nodes AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, g FROM (SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM nodes)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON b.g = a.g AND b.r <> a.r GROUP BY 1, 2),
edges AS (SELECT a, b FROM common JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
{REACH},
k AS (SELECT reach.a AS r, min(o.doc_id) AS component_id FROM reach JOIN nodes o ON o.r = reach.b GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM nodes JOIN k ON k.r = nodes.r LEFT JOIN n ON n.r = nodes.r"""

ORACLES: dict[str, str] = {"op1_suffix_array_dedup": OP1, "op4_embedding_near_dedup": OP4, "op6_decontamination": OP6, "op9_ngram_jaccard_join": OP9}
