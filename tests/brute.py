"""Cell-by-cell reference for the kernels."""

from helixweave.functions.scoring import INF, Edges, Scores


def matrix(a, b, edges: Edges, sc: Scores = Scores()):
    n, m = len(a), len(b)
    h = [[0] * (m + 1) for _ in range(n + 1)]
    e = [[-INF] * (m + 1) for _ in range(n + 1)]
    f = [[-INF] * (m + 1) for _ in range(n + 1)]
    for j in range(1, m + 1):
        h[0][j] = 0 if edges.free_row else -sc.gap_open - sc.gap_ext * j
    for i in range(1, n + 1):
        h[i][0] = 0 if edges.free_column else -sc.gap_open - sc.gap_ext * i
        for j in range(1, m + 1):
            e[i][j] = max(h[i][j - 1] - sc.gap_open, e[i][j - 1]) - sc.gap_ext
            f[i][j] = max(h[i - 1][j] - sc.gap_open, f[i - 1][j]) - sc.gap_ext
            d = h[i - 1][j - 1] + (sc.match if a[i - 1] == b[j - 1] else sc.mismatch)
            h[i][j] = max(d, e[i][j], f[i][j], *([0] if edges.local else []))
    return h, e, f


def best(a, b, edges: Edges, sc: Scores = Scores()):
    h, _, _ = matrix(a, b, edges, sc)
    n, m = len(a), len(b)
    cells = {"*": [(i, j) for i in range(1, n + 1) for j in range(1, m + 1)], "1": [(n, j) for j in range(m + 1)], "2": [(i, m) for i in range(n + 1)], "3": [(n, j) for j in range(m + 1)] + [(i, m) for i in range(n + 1)], "+": [(n, m)]}[edges.end]
    got = min(((-h[i][j], i, j) for i, j in cells), default=(0, -1, -1))
    if edges.end == "*" and -got[0] <= 0:
        return 0, -1, -1
    return -got[0], got[1], got[2]
