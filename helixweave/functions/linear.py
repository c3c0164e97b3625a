"""Optimal paths in linear memory: a matrix is split at its middle row until its pieces are small.

A piece has a start and an end state: 0 anywhere, 1 inside a gap on b (vertical), 2 inside a gap on a
(horizontal). A gap that crosses a cut is paid for by the piece before the cut: that piece must end
inside it, and the piece after goes on in it at the cost of its extension.
"""

from __future__ import annotations

import numpy as np

from . import kernels as K
from .scoring import INF, Scores, border

#: Cells of a piece that is solved by one small matrix.
SMALL = 1024
SWAP = (0, 2, 1)


def first_borders(n: int, m: int, state: int, strict: bool, sc: Scores = Scores()):
    """Top row and left column (index 0: the corner) of a matrix that starts in a state.

    strict: the path must begin inside the gap and pays for it; else the gap is open already, and may end at once.
    """
    top, left = (border("gaps", k, sc) for k in (m, n))
    if state and strict:
        top, left = (np.full(m + 1, -INF, np.int32), left) if state == 1 else (top, np.full(n + 1, -INF, np.int32))
        top[0] = left[0] = -INF
    elif state:
        top, left = (top, border("opened", n, sc)) if state == 1 else (border("opened", m, sc), left)
    return top, left


def last_row(a: np.ndarray, b: np.ndarray, state: int, strict: bool, sc: Scores = Scores()):
    """H and F of the last row of the matrix of a and b."""
    top, left = first_borders(len(a), len(b), state, strict, sc)
    low = np.full(len(b) + 1, -INF, np.int32)
    if not len(a):
        return top, low
    h, f, _, _, _ = K.block(a, b, top, low, left, np.full(len(a) + 1, -INF, np.int32), False, sc)
    f[0] = left[-1]
    return h, f


def _small(a, b, start: int, end: int, sc: Scores) -> str:
    """The operations of a small piece, by a matrix of three states."""
    n, m = len(a), len(b)
    o, x = sc.gap_open, sc.gap_ext
    h = [[-INF] * (m + 1) for _ in range(n + 1)]
    f, e = [[-INF] * (m + 1) for _ in range(n + 1)], [[-INF] * (m + 1) for _ in range(n + 1)]
    h[0][0] = 0
    (f if start == 1 else e)[0][0] = 0 if start else -INF
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                f[i][j] = max(h[i - 1][j] - o, f[i - 1][j]) - x
            if j:
                e[i][j] = max(h[i][j - 1] - o, e[i][j - 1]) - x
            if i and j:
                h[i][j] = h[i - 1][j - 1] + (sc.match if a[i - 1] == b[j - 1] else sc.mismatch)
            if i or j:
                h[i][j] = max(h[i][j], f[i][j], e[i][j])
    ops, i, j, state = [], n, m, end
    while i or j:
        if state == 0:
            if i and j and h[i][j] == h[i - 1][j - 1] + (sc.match if a[i - 1] == b[j - 1] else sc.mismatch):
                ops.append("M" if a[i - 1] == b[j - 1] else "X")
                i, j = i - 1, j - 1
                continue
            state = 1 if h[i][j] == f[i][j] else 2
        if state == 1:
            ops.append("V")
            state = 0 if f[i][j] == h[i - 1][j] - o - x else 1
            i -= 1
        else:
            ops.append("H")
            state = 0 if e[i][j] == h[i][j - 1] - o - x else 2
            j -= 1
    return "".join(reversed(ops))


_TURN = str.maketrans("VH", "HV")


def path(a: np.ndarray, b: np.ndarray, start: int = 0, end: int = 0, sc: Scores = Scores(), small: int = SMALL) -> str:
    """The operations of an optimal global alignment of a and b between two states."""
    out, todo = [], [(0, len(a), 0, len(b), start, end)]
    while todo:
        i, i2, j, j2, s, e = todo.pop()
        n, m = i2 - i, j2 - j
        if n == 0 or m == 0:
            out.append("V" * n + "H" * m)
            continue
        if n * m <= small or max(n, m) < 2:
            out.append(_small(a[i:i2].tolist(), b[j:j2].tolist(), s, e, sc))
            continue
        turned = n < m
        x, y, s1, e1 = (b[j:j2], a[i:i2], SWAP[s], SWAP[e]) if turned else (a[i:i2], b[j:j2], s, e)
        mid = len(x) // 2
        h1, f1 = last_row(x[:mid], y, s1, False, sc)
        h2, f2 = (v[::-1] for v in last_row(x[mid:][::-1], y[::-1], e1, True, sc))
        whole, gap = h1.astype(np.int64) + h2, f1.astype(np.int64) + f2 + sc.gap_open
        goal = max(whole.max(), gap.max())
        k = int(np.flatnonzero((whole == goal) | (gap == goal))[0])
        kind = 0 if whole[k] == goal else 1
        if turned:
            todo += [(i + k, i2, j + mid, j2, SWAP[kind], e), (i, i + k, j, j + mid, s, SWAP[kind])]
        else:
            todo += [(i + mid, i2, j + k, j2, kind, e), (i, i + mid, j, j + k, s, kind)]
    return "".join(out)


def score_of(ops: str, sc: Scores = Scores(), start: int = 0) -> int:
    """The score of operations; a first gap that goes on from the start state is open already."""
    total, last = 0, " VH"[start]
    for o in ops:
        total += sc.match if o == "M" else sc.mismatch if o == "X" else -sc.gap_ext - (0 if o == last else sc.gap_open)
        last = o
    return total
