"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = f"""
WITH d AS (SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS r FROM s),
x AS (SELECT *, CASE r WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM w),
y AS (SELECT *, 2.0::DOUBLE * source_size / weight AS room FROM x),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY room, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY room, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM y),
t AS (SELECT *, least(2.0::DOUBLE * source_size, coalesce((SELECT max(level) FROM l WHERE level <= room), 0.0::DOUBLE) * weight) AS target FROM l),
p AS (SELECT d.doc_id, d.size, CAST(t.source_size AS BIGINT) AS source_size, t.target, t.r, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, floor(target) AS most, done + source_size AS again, CASE r WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS m, CASE r WHEN 0 THEN -1.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS slope FROM p),
z AS (SELECT *, CAST(done AS DOUBLE) / target AS a1, CAST(again AS DOUBLE) / target AS a2 FROM q)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, most - done)) + greatest(0, least(size, most - again)) AS BIGINT) AS taken,
CASE WHEN size > 0 AND done < most THEN CASE WHEN a1 <= 0 THEN 0.0 ELSE 2.0::DOUBLE * a1 / (m + sqrt(greatest(m * m + 2.0::DOUBLE * slope * a1, 0.0::DOUBLE))) END END AS position,
CASE WHEN size > 0 AND again < most THEN CASE WHEN a2 <= 0 THEN 0.0 ELSE 2.0::DOUBLE * a2 / (m + sqrt(greatest(m * m + 2.0::DOUBLE * slope * a2, 0.0::DOUBLE))) END END AS position_again
FROM z
"""

OP3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024.0 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
OP6 = rf"""
WITH p AS (SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS host,
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', '', 'g'), '(?i)</?(p|br|div|li|ul|ol|nav|article|section|header|footer|aside|main|table|tr|td|th|h[1-6]|title|head|body|html|blockquote|pre)(\s[^>]*)?/?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS text FROM pages),
l AS (SELECT page_id, host, string_split(text, chr(10)) AS lines FROM p),
k AS (SELECT page_id, host, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x, {_BLANKS})), lambda x: x <> ''))) AS line FROM l),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
b AS (SELECT k.host, list(line) AS gone FROM (SELECT host, line, count(*) AS n FROM k GROUP BY ALL) k JOIN t ON k.host IS NOT DISTINCT FROM t.host WHERE n >= 2 AND pages >= 10 AND n > 0.1 * pages GROUP BY k.host),
f AS (SELECT page_id, l.host, lines, CASE WHEN gone IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(gone, trim(x, {_BLANKS}))) END AS kept FROM l LEFT JOIN b ON l.host IS NOT DISTINCT FROM b.host)
SELECT page_id, host, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(lines), 0) - coalesce(len(kept), 0) AS BIGINT) AS n_dropped, CAST(length(array_to_string(kept, chr(10))) AS BIGINT) AS n_chars, sha256(array_to_string(kept, chr(10))) AS text_sha256 FROM f
"""

OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 1 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END)) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
u AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT DISTINCT x AS id, x AS reach FROM u UNION SELECT r.id, u.y FROM r JOIN u ON u.x = r.reach),
m AS (SELECT id, min(reach) AS least FROM r GROUP BY id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id, coalesce(m.least, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": OP1, "op3_top_k": OP3, "op6_line_dedup": OP6, "op9_near_duplicates": OP9}
