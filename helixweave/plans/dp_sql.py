"""The alignment recurrence as recursive SQL, by anti-diagonals; it checks the kernels."""

from __future__ import annotations

from helixweave.functions.scoring import Edges

_INF = "-999999999"


def scores_sql(pairs: str, edges: Edges) -> str:
    """SQL for (aid, bid, score, end_i, end_j) of ``pairs`` (aid, bid, a, b)."""
    return f"WITH RECURSIVE {scores_ctes(pairs, edges)}\nSELECT * FROM found"


def scores_ctes(pairs: str, edges: Edges) -> str:
    """Tables q (pairs), dp (a row for each diagonal d: lists h1, e1, f1 by i), c (cells) and found."""
    zero = "0" if edges.local else _INF
    row = "0" if edges.free_row else "-3 - 2 * d"  # H[0, d]
    col = "0" if edges.free_column else "-3 - 2 * d"  # H[d, 0]
    # lists are indexed by i + 1 for i in 0..n; j = d - i
    e = f"list_transform(range(0, n + 1), lambda i: CASE WHEN d - i < 1 OR d - i > m THEN {_INF} ELSE greatest(h1[i + 1] - 3, e1[i + 1]) - 2 END)"
    f = f"list_transform(range(0, n + 1), lambda i: CASE WHEN i < 1 OR d - i < 0 OR d - i > m THEN {_INF} ELSE greatest(h1[i] - 3, f1[i]) - 2 END)"
    h = f"""list_transform(range(0, n + 1), lambda i: CASE
      WHEN d - i < 0 OR d - i > m THEN {_INF}
      WHEN i = 0 THEN {row}
      WHEN d = i THEN {col}
      ELSE greatest({zero}, h2[i] + CASE WHEN a[i] = b[d - i] THEN 1 ELSE -3 END, e[i + 1], f[i + 1]) END)"""
    start = f"list_transform(range(0, n + 1), lambda i: CASE WHEN i = 0 THEN 0 ELSE {_INF} END)"
    none = f"list_transform(range(0, n + 1), lambda i: {_INF})"
    where = {
        "*": "i >= 1 AND d - i >= 1 AND d - i <= m AND x > 0",
        "1": "i = n AND d - i BETWEEN 0 AND m",
        "2": "d - i = m",
        "3": "d - i BETWEEN 0 AND m AND (i = n OR d - i = m)",
        "+": "i = n AND d - i = m",
    }[edges.end]
    return f"""p AS ({pairs}),
q AS (SELECT aid, bid, list_transform(string_split(a, ''), lambda c: unicode(c)) AS a, list_transform(string_split(b, ''), lambda c: unicode(c)) AS b, length(a) AS n, length(b) AS m FROM p),
dp AS (
  SELECT aid, bid, a, b, n, m, CAST(0 AS BIGINT) AS d, {start} AS h1, {none} AS h2, {none} AS e1, {none} AS f1 FROM q
  UNION ALL
  SELECT aid, bid, a, b, n, m, d, {h}, h1, e, f FROM (
    SELECT aid, bid, a, b, n, m, d, h1, h2, {e} AS e, {f} AS f FROM (SELECT * REPLACE (d + 1 AS d) FROM dp WHERE d < n + m))),
c AS (SELECT aid, bid, d, n, m, unnest(h1) AS x, unnest(range(0, n + 1)) AS i FROM dp),
r AS (SELECT aid, bid, x AS score, i AS end_i, d - i AS end_j,
  row_number() OVER (PARTITION BY aid, bid ORDER BY x DESC, i, d - i) AS k FROM c WHERE {where}),
found AS (SELECT q.aid, q.bid, CAST(coalesce(r.score, 0) AS BIGINT) AS score, CAST(coalesce(r.end_i, -1) AS BIGINT) AS end_i, CAST(coalesce(r.end_j, -1) AS BIGINT) AS end_j
FROM q LEFT JOIN r ON q.aid = r.aid AND q.bid = r.bid AND r.k = 1)"""


def path_ctes(pairs: str, edges: Edges) -> str:
    """Tables of scores_ctes, and step (aid, bid, k, op, i, j, value, run) and path (aid, bid, score, start_i .. ops).

    The way back from the end is a recursive walk with a state: 0 anywhere, 1 inside a vertical gap, 2 inside a
    horizontal one. step: the k-th operation from the start, where it leads, its value, and the number of its run.
    """
    at = lambda t, i, j: f"{t}[{i} + {j} + 1][{i} + 1]"
    stop = "WHEN s = 0 AND " + at("hs", "i", "j") + " = 0 THEN NULL" if edges.local else ""
    sub = "CASE WHEN a[i] = b[j] THEN 1 ELSE -3 END"
    return f"""{scores_ctes(pairs, edges)},
m AS (SELECT dp.aid, dp.bid, any_value(a) AS a, any_value(b) AS b, list(h1 ORDER BY d) AS hs, list(e1 ORDER BY d) AS es, list(f1 ORDER BY d) AS fs FROM dp GROUP BY dp.aid, dp.bid),
walk AS (
  SELECT aid, bid, end_i AS i, end_j AS j, 0 AS s, '' AS op, 0 AS back FROM found WHERE end_i >= 0
  UNION ALL
  SELECT aid, bid, i, j, s, op, back FROM (
    SELECT aid, bid, back + 1 AS back, i - CASE WHEN move = 'H' THEN 0 ELSE 1 END AS i, j - CASE WHEN move = 'V' THEN 0 ELSE 1 END AS j,
      CASE WHEN move = 'D' OR i = 0 OR j = 0 THEN 0
        WHEN move = 'V' THEN CASE WHEN {at("fs", "i", "j")} = {at("hs", "(i - 1)", "j")} - 5 THEN 0 ELSE 1 END
        ELSE CASE WHEN {at("es", "i", "j")} = {at("hs", "i", "(j - 1)")} - 5 THEN 0 ELSE 2 END END AS s,
      CASE WHEN move <> 'D' THEN move WHEN a[i] = b[j] THEN 'M' ELSE 'X' END AS op
    FROM (SELECT w.*, m.a, m.b, hs, es, fs, CASE
        WHEN i = 0 AND j = 0 THEN NULL
        WHEN s = 0 AND i = 0 THEN {"NULL" if edges.free_row else "'H'"}
        WHEN s = 0 AND j = 0 THEN {"NULL" if edges.free_column else "'V'"}
        {stop}
        WHEN s = 0 AND {at("hs", "i", "j")} = {at("hs", "(i - 1)", "(j - 1)")} + {sub} THEN 'D'
        WHEN s = 1 OR (s = 0 AND {at("hs", "i", "j")} = {at("fs", "i", "j")}) THEN 'V'
        ELSE 'H' END AS move FROM walk w JOIN m ON w.aid = m.aid AND w.bid = m.bid) WHERE move IS NOT NULL)),
whole AS (SELECT aid, bid, max(back) AS total, arg_max(i, back) AS i0, arg_max(j, back) AS j0, string_agg(op, '' ORDER BY back DESC) AS ops FROM walk GROUP BY aid, bid),
ahead AS (SELECT w.aid, w.bid, total - back + 1 AS k, op, lag(i) OVER o AS i, lag(j) OVER o AS j, coalesce(lead(op) OVER o, '') AS op0 FROM walk w JOIN whole USING (aid, bid) WINDOW o AS (PARTITION BY w.aid, w.bid ORDER BY back)),
step AS (SELECT aid, bid, k, op, i, j, CASE op WHEN 'M' THEN 1 WHEN 'X' THEN -3 ELSE CASE WHEN op0 = op THEN -2 ELSE -5 END END AS value,
  sum(CASE WHEN op = op0 THEN 0 ELSE 1 END) OVER (PARTITION BY aid, bid ORDER BY k) AS run FROM ahead WHERE op <> ''),
path AS (SELECT f.aid, f.bid, f.score, CASE WHEN end_i < 0 THEN -1 ELSE i0 + 1 END AS start_i, CASE WHEN end_i < 0 THEN -1 ELSE j0 + 1 END AS start_j, end_i, end_j, coalesce(ops, '') AS ops
  FROM found f LEFT JOIN whole w ON f.aid = w.aid AND f.bid = w.bid)"""


def points_cte(every: int, name: str = "point") -> str:
    """Points of the paths of path_ctes: the start, every every-th step and the last."""
    return f"""{name} AS (
  SELECT aid, bid, 0 AS ord, 0 AS type, start_i - 1 AS i, start_j - 1 AS j, 0 AS score FROM path WHERE end_i >= 0
  UNION ALL
  SELECT aid, bid, ord, type, i, j, score FROM (
    SELECT aid, bid, k AS ord, CASE op WHEN 'H' THEN 1 WHEN 'V' THEN 2 ELSE 0 END AS type, i, j, sum(value) OVER o AS score, max(k) OVER (PARTITION BY aid, bid) AS last
    FROM step WINDOW o AS (PARTITION BY aid, bid ORDER BY k)) WHERE ord % {every} = 0 OR ord = last)"""


def blocks_ctes(pairs: str, height: int, width: int) -> str:
    """Tables of scores_ctes (local), and block: the best cell of each block of every pair's matrix."""
    return f"""{scores_ctes(pairs, Edges())},
inner_cell AS (SELECT aid, bid, n, m, i, d - i AS j, x FROM c WHERE i >= 1 AND d - i BETWEEN 1 AND m),
block AS (SELECT aid, bid, n, m, (i - 1) // {height} AS block_row, (j - 1) // {width} AS block_col, max(x) AS score, -max((x, -i, -j))[2] AS i, -max((x, -i, -j))[3] AS j
  FROM inner_cell GROUP BY aid, bid, n, m, block_row, block_col)"""
