"""Dynamic-programming kernels in numpy.

A row of the matrix is a handful of vector operations: without horizontal gaps a cell is
T = max(diagonal, vertical gap[, 0]); a horizontal gap re-opened from another never wins, so
E[j] = max over k < j of (T[k] + ext * k) - open - ext * j, a running maximum. Many pairs of similar
size advance together, one row at a time, with the pairs side by side in memory, so that the running
maximum too is a vector operation; one large pair is cut into blocks that pass their borders on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .scoring import INF, Edges, Scores, border

#: Cells of one row step over all pairs of a batch: where paths are traced, and for scores (what a core's cache holds).
ROW_CELLS, SCORE_CELLS = 200_000, 120_000
#: Pairs of a batch from which they lie side by side.
SIDE_BY_SIDE = 8
DIAG, VERT, HORI, V_CLOSE, H_CLOSE, STOP = map(np.uint8, (1, 2, 4, 8, 16, 32))


def codes(text: str) -> np.ndarray:
    """Code points: characters, not bytes, are compared."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)


def _padded(seqs: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(seqs), max(map(len, seqs), default=0)), fill, np.int32)
    for i, s in enumerate(seqs):
        out[i, : len(s)] = s
    return out


def _better(best, score, i, j):
    """best (score, i, j) improved in place: score desc, i asc, j asc."""
    s, bi, bj = best
    up = (score > s) | ((score == s) & ((i < bi) | ((i == bi) & (j < bj))))
    s[up], bi[up], bj[up] = score[up], np.broadcast_to(i, s.shape)[up], np.broadcast_to(j, s.shape)[up]


def _rows(a, b, na, nb, edges: Edges, sc: Scores, trace: bool):
    """Score, end and, if asked, the traceback bits of every pair of one batch."""
    a_codes, b_codes = _padded(a, -1), _padded(b, -2)
    p, n = a_codes.shape
    m = b_codes.shape[1]
    row = np.arange(p)
    k = np.arange(m + 1, dtype=np.int32)
    ramp = sc.gap_ext * k
    h = np.tile(border("zeroes" if edges.free_row else "gaps", m, sc), (p, 1))
    column = border("zeroes" if edges.free_column else "gaps", n, sc)
    f = np.full((p, m + 1), -INF, np.int32)
    best = (np.zeros(p, np.int64), np.full(p, -1), np.full(p, -1)) if edges.end == "*" else (np.full(p, -INF, np.int64), np.full(p, INF), np.full(p, INF))
    bits = np.zeros((n + 1, p, m + 1), np.uint8) if trace else None
    inside = k <= nb[:, None]

    def ends(i, h):
        if edges.end == "*":
            if i and m:
                inner = np.where(inside[:, 1:], h[:, 1:], -INF)
                j = inner.argmax(1)
                s = inner[row, j]
                up = (s > best[0]) & (na >= i)
                best[0][up], best[1][up], best[2][up] = s[up], i, j[up] + 1
            return
        if edges.end in "13":
            last = np.flatnonzero(na == i)
            if len(last):
                j = np.where(inside[last], h[last], -INF).argmax(1)
                got = tuple(x[last] for x in best)
                _better(got, h[last, j].astype(np.int64), i, j)
                for x, y in zip(best, got, strict=True):
                    x[last] = y
        if edges.end in "23":
            s = np.where(na >= i, h[row, nb], -INF).astype(np.int64)
            _better(best, s, i, nb)
        if edges.end == "+":
            last = na == i
            best[0][last], best[1][last], best[2][last] = h[row, nb][last], i, nb[last]

    ends(0, h)
    for i in range(1, n + 1):
        f = np.maximum(h - sc.gap_open, f) - sc.gap_ext
        diag = h[:, :-1] + np.where(a_codes[:, i - 1 : i] == b_codes, np.int32(sc.match), np.int32(sc.mismatch))
        t = np.empty_like(h)
        np.maximum(diag, f[:, 1:], out=t[:, 1:])
        if edges.local:
            np.maximum(t[:, 1:], 0, out=t[:, 1:])
        t[:, 0] = column[i]
        e = np.maximum.accumulate(t + ramp, axis=1)[:, :-1] - sc.gap_open - ramp[1:]
        new = t
        np.maximum(t[:, 1:], e, out=new[:, 1:])
        if trace:
            x = new[:, 1:]
            bits[i, :, 1:] = (x == diag) * DIAG | (x == f[:, 1:]) * VERT | (x == e) * HORI | (f[:, 1:] == h[:, 1:] - sc.gap_open - sc.gap_ext) * V_CLOSE | (e == new[:, :-1] - sc.gap_open - sc.gap_ext) * H_CLOSE
            if edges.local:
                bits[i, :, 1:] |= (x == 0) * STOP
        h = new
        ends(i, h)
    return best, bits


def _side_by_side(a, b, na, nb, edges: Edges, sc: Scores):
    """Score and end of every pair of one batch; arrays are (symbols of b, pairs)."""
    n, m, p = int(na.max()), int(nb.max()), len(a)
    # symbols as small numbers; what lies beyond a sequence equals nothing
    known = {c: k for k, c in enumerate(np.unique(np.concatenate([*a, *b])).tolist())}
    symbols = np.fromiter(known, np.int64, len(known))
    worst = (n + m) * max(sc.gap_ext, -sc.mismatch, sc.match) + 2 * sc.gap_open
    kind = np.int16 if worst < 10_000 and len(known) < 30_000 else np.int32
    low = kind(-15_000 if kind is np.int16 else -INF)
    a_codes, b_codes = (np.full((size, p), fill, kind) for size, fill in ((n, -1), (m, -2)))
    for k in range(p):
        a_codes[: na[k], k], b_codes[: nb[k], k] = np.searchsorted(symbols, a[k]), np.searchsorted(symbols, b[k])
    top, side = (border("zeroes" if free else "gaps", size, sc).astype(kind) for free, size in ((edges.free_row, m), (edges.free_column, n)))
    h, new = np.repeat(top[:, None], p, 1), np.empty((m + 1, p), kind)
    f, run = np.full((m + 1, p), low, kind), np.empty((m + 1, p), kind)
    other, zero = np.empty((m + 1, p), kind), np.zeros((m, p), kind)
    same, step = np.empty((m, p), bool), np.empty((m, p), kind)
    ramp = (sc.gap_ext * np.arange(m + 1)).astype(kind)[:, None]
    back = (ramp[1:] + sc.gap_open).astype(kind)
    gain, loss, open_, ext = kind(sc.match - sc.mismatch), kind(sc.mismatch), kind(sc.gap_open), kind(sc.gap_ext)
    beyond = None if (nb == m).all() else np.where(np.arange(m + 1)[:, None] <= nb, kind(0), low)
    cols = np.arange(p)
    if edges.end == "*":
        best = np.zeros(p, np.int64), np.full(p, -1), np.full(p, -1)
    else:
        best = np.full(p, -INF, np.int64), np.full(p, INF), np.full(p, INF)

    def ends(i):
        if edges.end == "*":
            if not i or not m:
                return
            inner = h[1:] if beyond is None else np.add(h[1:], beyond[1:], out=step)
            top_ = inner.max(0)
            up = np.flatnonzero((top_ > best[0]) & (na >= i))
            if len(up):
                best[0][up], best[1][up], best[2][up] = top_[up], i, inner[:, up].argmax(0) + 1
            return
        if edges.end in "13":
            last = np.flatnonzero(na == i)
            if len(last):
                line = h[:, last] if beyond is None else h[:, last] + beyond[:, last]
                j = line.argmax(0)
                got = tuple(x[last] for x in best)
                _better(got, line[j, np.arange(len(last))].astype(np.int64), i, j)
                for x, y in zip(best, got, strict=True):
                    x[last] = y
        if edges.end in "23":
            _better(best, np.where(na >= i, h[nb, cols].astype(np.int64), -INF), i, nb)
        if edges.end == "+":
            last = np.flatnonzero(na == i)
            best[0][last], best[1][last], best[2][last] = h[nb[last], last], i, nb[last]

    ends(0)
    for i in range(1, n + 1):
        np.subtract(h, open_, out=run)
        np.maximum(run, f, out=f)
        f -= ext
        np.equal(b_codes, a_codes[i - 1], out=same)
        np.multiply(same, gain, out=step)
        step += loss
        step += h[:-1]
        np.maximum(step, f[1:], out=new[1:])
        if edges.local:
            np.maximum(new[1:], zero, out=new[1:])
        new[0] = side[i]
        np.add(new, ramp, out=run)
        # the running maximum, by distances that double: faster than symbol by symbol
        x, y, d = run, other, 1
        while d <= m:
            np.maximum(x[d:], x[:-d], out=y[d:])
            y[:d] = x[:d]
            x, y, d = y, x, 2 * d
        np.subtract(x[:-1], back, out=step)
        np.maximum(new[1:], step, out=new[1:])
        h, new = new, h
        ends(i)
    return best


def batches(a: list[np.ndarray], b: list[np.ndarray], cells: int = ROW_CELLS, matrix: int | None = None):
    """Index groups of pairs of similar size whose rows (or whole matrices) fit a bound."""
    order = sorted(range(len(a)), key=lambda i: (len(a[i]), len(b[i])))
    group: list[int] = []
    wide = tall = 0
    for i in order:
        w, t = max(wide, len(b[i]) + 1), max(tall, len(a[i]) + 1)
        if group and ((len(group) + 1) * w > cells or (matrix and (len(group) + 1) * w * t > matrix)):
            yield group
            group, w, t = [], len(b[i]) + 1, len(a[i]) + 1
        group.append(i)
        wide, tall = w, t
    if group:
        yield group


def best_scores(a: list[np.ndarray], b: list[np.ndarray], edges: Edges = Edges(), sc: Scores = Scores()) -> np.ndarray:
    """(pairs, 3): score and end (i, j), 1-based counts of consumed symbols; (0, -1, -1) for an empty alignment."""
    out = np.zeros((len(a), 3), np.int64)
    for g in batches(a, b, SCORE_CELLS):
        x, y = [a[i] for i in g], [b[i] for i in g]
        na, nb = (np.array([len(s) for s in side]) for side in (x, y))
        if len(g) >= SIDE_BY_SIDE and nb.max():
            best = _side_by_side(x, y, na, nb, edges, sc)
        else:
            best, _ = _rows(x, y, na, nb, edges, sc, False)
        out[g] = np.stack(best, 1)
    return out


@dataclass
class Path:
    score: int
    start: tuple[int, int]
    end: tuple[int, int]
    ops: str  # M match, X mismatch, V gap on sequence 1, H gap on sequence 0


def _walk(bits, a, b, end, edges: Edges) -> tuple[int, int, str]:
    i, j = end
    ops: list[str] = []
    state = 0
    while True:
        if state == 0:
            if i == 0 and j == 0:
                break
            if i == 0:
                if edges.free_row:
                    break
                ops.append("H" * j)
                j = 0
                continue
            if j == 0:
                if edges.free_column:
                    break
                ops.append("V" * i)
                i = 0
                continue
            x = bits[i, j]
            if x & STOP:
                break
            if x & DIAG:
                ops.append("M" if a[i - 1] == b[j - 1] else "X")
                i, j = i - 1, j - 1
                continue
            state = VERT if x & VERT else HORI
        x = bits[i, j]
        if state == VERT:
            ops.append("V")
            i -= 1
            state = 0 if x & V_CLOSE else VERT
        else:
            ops.append("H")
            j -= 1
            # a gap that runs on into a gap border goes on in the border
            state = 0 if x & H_CLOSE else HORI
    return i, j, "".join(s[::-1] for s in ops)[::-1]


def best_paths(a: list[np.ndarray], b: list[np.ndarray], edges: Edges = Edges(), sc: Scores = Scores()) -> list[Path]:
    """One optimal alignment of each pair: diagonal before vertical before horizontal, gaps closed early."""
    out: list[Path | None] = [None] * len(a)
    for g in batches(a, b, matrix=64_000_000):
        x, y = [a[i] for i in g], [b[i] for i in g]
        (s, ei, ej), bits = _rows(x, y, np.array([len(v) for v in x]), np.array([len(v) for v in y]), edges, sc, True)
        for k, i in enumerate(g):
            if ei[k] < 0:
                out[i] = Path(0, (-1, -1), (-1, -1), "")
                continue
            i0, j0, ops = _walk(bits[:, k], x[k], y[k], (int(ei[k]), int(ej[k])), edges)
            out[i] = Path(int(s[k]), (i0, j0), (int(ei[k]), int(ej[k])), ops)
    return out


# ---------------------------------------------------------------- one block of a large matrix


def block(a, b, top_h, top_f, left_h, left_e, local: bool, sc: Scores = Scores()):
    """Borders below and right of a block, and its best cell (score, row, column from 1; first in row order).

    top_h, top_f: index 0..m of the row above (index 0 is the corner); left_h, left_e: index 0..n of the
    column to the left. A border's index 0 repeats the corner.
    """
    n, m = len(a), len(b)
    h, f = top_h.astype(np.int32).copy(), top_f.astype(np.int32).copy()
    ramp = sc.gap_ext * np.arange(m + 1, dtype=np.int32)
    right_h, right_e = np.empty(n + 1, np.int32), np.full(n + 1, -INF, np.int32)
    right_h[0] = h[m]
    best = (-INF, 0, 0)
    for i in range(1, n + 1):
        f = np.maximum(h - sc.gap_open, f) - sc.gap_ext
        t = np.empty(m + 1, np.int32)
        np.maximum(h[:-1] + np.where(b == a[i - 1], np.int32(sc.match), np.int32(sc.mismatch)), f[1:], out=t[1:])
        if local:
            np.maximum(t[1:], 0, out=t[1:])
        t[0] = left_h[i]
        e = np.maximum.accumulate(t + ramp)[:-1] - sc.gap_open - ramp[1:]
        np.maximum(e, left_e[i] - ramp[1:], out=e)
        t[1:] = np.maximum(t[1:], e)
        h = t
        right_h[i] = h[m]
        right_e[i] = e[-1] if m else left_e[i]
        j = int(h[1:].argmax()) if m else 0
        if m and h[j + 1] > best[0]:
            best = (int(h[j + 1]), i, j + 1)
    f[0] = -INF
    return h, f, right_h, right_e, best
