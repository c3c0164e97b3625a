"""DuckDB SQL of the queries that SQL can express."""

SQL = {
    "op1_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, max(v) AS v FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
s AS (
  SELECT q.query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM q JOIN v c ON q.query_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
""",
    "op8_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS gram FROM s),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY gram) AS first FROM g),
r AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (
  SELECT doc_id, unnest(range(i, i + 13)) AS p FROM m WHERE first < doc_id) GROUP BY doc_id),
k AS (
  SELECT d.doc_id, d.w, coalesce(r.gone, []) AS gone FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_filter(w, lambda x, i: NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM k
""",
    "op9_ngram_jaccard": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE
  WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 90 * (nx.n + ny.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT e.y, r.c FROM r JOIN e ON r.doc_id = e.x)
SELECT r.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id
""",
    "op6_decontamination": r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
d AS (SELECT doc_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS g FROM dw WHERE len(w) >= 5),
b AS (SELECT item_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS h FROM iw WHERE len(w) >= 5),
c AS (SELECT DISTINCT x.doc_id, y.item_id FROM (SELECT doc_id, unnest(g) AS q FROM d) x JOIN (SELECT item_id, unnest(h) AS q FROM b) y ON x.q = y.q),
w AS (SELECT doc_id, item_id, h, g, unnest(range(0, len(g) - len(h) + 1)) AS word FROM c JOIN d USING (doc_id) JOIN b USING (item_id)),
v AS (SELECT doc_id, item_id, h, word, g[word + 1:word + len(h)] AS win FROM w),
m AS (SELECT doc_id, item_id, word, len(h) AS n, list_sum(list_transform(list_distinct(h), lambda q: least(len(list_filter(win, lambda y: y = q)), len(list_filter(h, lambda y: y = q))))) AS hit FROM v),
t AS (SELECT doc_id, item_id, word, CAST(hit AS DOUBLE) / (2 * n - hit) AS similarity FROM m)
SELECT doc_id, item_id, similarity, CAST(word AS BIGINT) AS word FROM t WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, word) = 1
""",
}


def _words(text: str) -> str:
    return rf"len(list_filter(regexp_split_to_array(coalesce({text}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))"


def _codes() -> str:
    """Two rounds of assignment and update, then the last assignment."""
    near = """a{0} AS (SELECT rid, part, any_value(x) AS x, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (
  SELECT rid, p.part, x, entry, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS HUGEINT) AS d FROM p JOIN c{0} ON c{0}.part = p.part) GROUP BY rid, part)"""
    move = """c{1} AS (SELECT part, entry, CASE WHEN m IS NULL THEN c ELSE m END AS c FROM c{0} LEFT JOIN (
  SELECT part, entry, list(CAST(floor(total / n) AS BIGINT) ORDER BY i) AS m FROM (SELECT part, entry, i, CAST(sum(x[i]) AS BIGINT) AS total, count(*) AS n FROM a{0}, range(1, 5) t(i) GROUP BY part, entry, i) GROUP BY part, entry) USING (part, entry))"""
    steps = [near.format(0), move.format(0, 1), near.format(1), move.format(1, 2), near.format(2)]
    return """
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v, row_number() OVER () AS rid FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT rid, CAST(part AS INTEGER) AS part, v[part * 4 + 1:part * 4 + 4] AS x FROM v, range(16) t(part)),
c0 AS (SELECT part, entry, x AS c FROM p JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v WHERE vec_id IS NOT NULL QUALIFY entry < 64) USING (rid)),
""" + ",\n".join(steps) + """,
e AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) FROM c2) AS codebooks_sha256
FROM v JOIN e USING (rid)
"""


#: The remainder of the unsigned CRC-32 of an id's decimal digits, bit by bit.
_CRC = """list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda ch: ord(ch)::BIGINT)), lambda crc, byte:
  list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, bit: xor(x >> 1, CASE x & 1 WHEN 1 THEN 3988292384 ELSE 0 END)))"""

SQL["op12_vector_codes"] = _codes()

#: Sources of at most mixing.GROUP documents: one order each, taken where they still fit.
SQL["op11_mixing"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST({_words('text')} AS BIGINT) AS size, CAST(('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT) AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS w FROM d GROUP BY source),
b AS (SELECT *, 3.0::DOUBLE * source_size / w AS top FROM s),
-- sources by the level at which they are full; the highest level that is not above the next top holds
l AS (SELECT *, coalesce(sum(3.0::DOUBLE * source_size) OVER x, 0) AS gone, sum(w) OVER (ORDER BY top, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM b
  WINDOW x AS (ORDER BY top, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT coalesce(max(((SELECT sum(size) FROM d) - gone) / free) FILTER (((SELECT sum(size) FROM d) - gone) / free <= top), 0) AS level FROM l),
t AS (SELECT row_number() OVER () AS sid, source, source_size, least(3.0::DOUBLE * source_size, level * w) AS target FROM s, h),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t),
k AS (SELECT sid, doc_id, size, floor(rate) AS copies, CAST(round(target) AS BIGINT) - CAST(floor(rate) * source_size AS BIGINT) AS rest, rate > floor(rate) AS more, row_number() OVER (PARTITION BY sid ORDER BY u, doc_id) AS nth FROM r JOIN d ON d.source IS NOT DISTINCT FROM r.source),
g AS (
  SELECT sid, 0::BIGINT AS nth, any_value(rest) AS rest, false AS fits, NULL::BIGINT AS spare, NULL::BIGINT AS late FROM k WHERE more GROUP BY sid
  UNION ALL
  SELECT g.sid, k.nth, CASE WHEN k.size <= g.rest THEN g.rest - k.size ELSE g.rest END, k.size <= g.rest,
    CASE WHEN k.size > g.rest AND (spare IS NULL OR k.size < spare) THEN k.size ELSE spare END, CASE WHEN k.size > g.rest AND (spare IS NULL OR k.size < spare) THEN k.nth ELSE late END
  FROM g JOIN k ON k.sid = g.sid AND k.nth = g.nth + 1),
z AS (SELECT sid, arg_max(late, nth) AS late FROM (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY sid ORDER BY nth DESC) = 1) WHERE spare - rest < rest GROUP BY sid)
SELECT k.doc_id, k.size, t.source_size, t.target, CAST(k.size * (k.copies + CASE WHEN coalesce(g.fits, false) OR coalesce(k.nth = z.late AND k.more, false) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM k JOIN t USING (sid) LEFT JOIN g ON g.sid = k.sid AND g.nth = k.nth LEFT JOIN z ON z.sid = k.sid
"""

SQL["op13_prefix_trie"] = f"""
WITH o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place, [coalesce(role, ''), coalesce(text, '')] AS k, CAST({_words('text')} AS BIGINT) AS w FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(k ORDER BY place) AS ks, list(w ORDER BY place) AS ws, xor({_CRC.format('conv_id')}, 4294967295) % 4 AS h FROM o GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(coalesce(b.ks[:c.h], []), c.ks[c.h + 1:]) AS ks, list_concat(coalesce(b.ws[:c.h], []), c.ws[c.h + 1:]) AS ws FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 20),
m AS (SELECT conv_id, len(ks) AS total, depth, ks[:depth] AS path, CASE WHEN depth > 0 THEN ws[depth] ELSE 0 END AS w FROM (SELECT *, unnest(range(0, len(ks) + 1)) AS depth FROM r)),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (total = depth), '')) AS ends FROM m GROUP BY depth, path),
u AS (SELECT n.*, p.conv_id AS parent_conv_id FROM n LEFT JOIN n p ON p.depth = n.depth - 1 AND p.path = n.path[:n.depth - 1]),
f AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM u WHERE depth > 0 GROUP BY ALL),
-- every node under each of its ancestors, itself included
x AS (SELECT u.path[:top] AS path, top AS depth, (u.n_convs - 1) * u.w AS saved, f.conv_id IS NULL AS leaf FROM (SELECT *, unnest(range(0, depth + 1)) AS top FROM u) u LEFT JOIN f USING (conv_id, depth)),
t AS (SELECT path, depth, sum(saved) AS saved, count(*) FILTER (leaf) AS leaves FROM x GROUP BY path, depth)
SELECT u.conv_id, CAST(u.depth AS BIGINT) AS depth, u.parent_conv_id, u.n_convs, coalesce(f.n_children, 0) AS n_children, t.leaves AS n_leaves, CAST(t.saved AS BIGINT) AS saved_tokens, u.ends AS ends_sha256
FROM u JOIN t USING (path, depth) LEFT JOIN f ON f.conv_id = u.conv_id AND f.depth = u.depth
"""
