"""SQL for the registered queries that SQL can express."""

OP9_LINE_DEDUP = r"""
WITH d AS (
  SELECT doc_id, text, coalesce('=' || source, 'null') AS site, string_split(text, chr(10)) AS parts FROM documents
), l AS (
  SELECT doc_id, md5(text) AS content, text, site, unnest(parts) AS line, generate_subscripts(parts, 1) AS place FROM d
), w AS (
  SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), b AS (
  SELECT line, min((doc_id, text, place)) AS first FROM w GROUP BY line HAVING count(DISTINCT site) >= 3
), r AS (
  SELECT DISTINCT w.doc_id, w.content, w.place FROM w JOIN b USING (line) WHERE (w.doc_id, w.text, w.place) <> b.first
), k AS (
  SELECT l.doc_id, l.content, string_agg(l.line, chr(10) ORDER BY l.place) FILTER (WHERE r.place IS NULL) AS text, count(r.place) AS n_removed, count(*) AS n_lines
  FROM (SELECT DISTINCT doc_id, content, line, place FROM l) l LEFT JOIN r ON l.doc_id = r.doc_id AND l.content = r.content AND l.place = r.place
  GROUP BY l.doc_id, l.content
)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed, md5(coalesce(k.text, '')) AS text_md5
FROM d LEFT JOIN k ON d.doc_id = k.doc_id AND md5(d.text) = k.content
"""

OP10_NEAREST = """
WITH u AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x : x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x : x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p : p[1] * p[2]))
    / (sqrt(list_sum(list_transform(c.v, lambda x : x * x))) * sqrt(list_sum(list_transform(q.v, lambda x : x * x)))) AS score
  FROM u q JOIN u c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP12_CHOSEN_PATH = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i : array_to_string(w[i : i + 4], ' '))) END AS found FROM w
), t AS (
  SELECT doc_id, len(found) AS n, unnest(found) AS token FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.token = b.token AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (min(a.n) + min(b.n) - count(*))
), c AS (
  SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT c.node, p.b FROM c JOIN p ON p.a = c.seen
)
SELECT s.doc_id, len(s.found)::BIGINT AS n_shingles, min(c.seen) AS component_id, s.doc_id = min(c.seen) AS kept
FROM s JOIN c ON c.node = s.doc_id GROUP BY s.doc_id, s.found
"""

OP13_RANKED_SEARCH = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS w FROM documents
), g AS (
  SELECT count(*) AS total, sum(len(w))::BIGINT AS length FROM d WHERE len(w) > 0
), q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark
  ) GROUP BY item_id, term
), t AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term
), f AS (
  SELECT term, floor(1000 * ln((2.0::DOUBLE * total + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM t GROUP BY term), g
), i AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * total) // length))) AS part FROM t JOIN f USING (term), g
), s AS (
  SELECT item_id, doc_id, sum(times * part)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY item_id, doc_id
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
) WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_line_dedup": OP9_LINE_DEDUP, "op10_nearest": OP10_NEAREST, "op12_chosen_path": OP12_CHOSEN_PATH, "op13_ranked_search": OP13_RANKED_SEARCH}
