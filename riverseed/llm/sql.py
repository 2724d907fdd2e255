"""DuckDB SQL for the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP4 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) = 1 THEN ws
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
flat AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS s FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, len(sh)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM sets LEFT JOIN least_of ON a = doc_id
"""

OP5 = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
t AS (SELECT *, max(page_id) OVER (PARTITION BY d, n) AS top FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> top THEN top END AS refers_to FROM t
"""

_ITEM_WORDS = r"list_filter(regexp_split_to_array({}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')".format(_LOWER)
OP9 = f"""
WITH i AS (SELECT item_id, {_ITEM_WORDS} AS ws FROM benchmark),
d AS (SELECT doc_id, {_ITEM_WORDS} AS ws FROM documents),
win AS (SELECT DISTINCT item_id, least(len(ws), 10) AS k, array_to_string(ws[p:p + least(len(ws), 10) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS p FROM i WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
places AS (SELECT doc_id, k, p, array_to_string(ws[p:p + k - 1], ' ') AS s FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, sizes WHERE len(ws) >= k)),
hits AS (SELECT doc_id, item_id, places.k, p FROM places JOIN win ON places.k = win.k AND places.s = win.s),
covered AS (SELECT doc_id, count(DISTINCT q)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_TERMS = r"list_filter(regexp_split_to_array({}, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')".format(_LOWER)
OP12 = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents), i AS (SELECT item_id, {_TERMS} AS ts FROM benchmark),
docs AS (SELECT doc_id, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
size AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM docs),
tf AS (SELECT doc_id, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM d) GROUP BY ALL),
df AS (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t),
q AS (SELECT item_id, t, count(*)::BIGINT AS c FROM (SELECT item_id, unnest(ts) AS t FROM i) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, size),
s AS (SELECT item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt))))::BIGINT AS score
  FROM q JOIN w USING (t) JOIN tf USING (t) JOIN docs USING (doc_id), size GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

SQL: dict[str, str] = {"op4_near_duplicates": OP4, "op5_warc": OP5, "op9_decontamination": OP9, "op12_ranked_search": OP12}
