"""Best local scores of many short sequences against many others, from the cells that matter alone.

Where every loss is at least p, a best local alignment is one run of matches or begins with a run worth more
than p: a first run worth less than the loss behind it can be left out. So only such runs are started, from
equal k-grams, and followed row by row while their score is above 0. Cells whose score bears no gap go on along
their diagonals; the others are kept as a sorted list and get gaps as in the full recurrence. Pairs without an
longer run have their longest equal run as score. Results are those of ``kernels.best_scores``.
"""

from __future__ import annotations

import numpy as np

from . import kernels as K
from .scoring import Edges, Scores

#: Cells of a row that are followed at once; where more matter, sequences are halved, and a single pair is computed in full.
MOST = 4_000_000
#: Numbers of a table of the k-grams that sequences hold.
TABLE = 4_000_000


class _TooMany(Exception):
    pass


def _joined(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequences one after the other, each between two -1; index of each one's first symbol."""
    size = np.array([len(s) for s in seqs], np.int64)
    first = np.cumsum(size + 1) - size
    out = np.full(int(size.sum()) + len(seqs) + 1, -1, np.int64)
    at = np.arange(int(size.sum())) + np.repeat(first - np.cumsum(size) + size, size)
    out[at] = np.concatenate([*seqs, np.empty(0, np.int32)])
    return out, first


def _grams(sym: np.ndarray, k: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, codes) of the runs of k symbols that lie within one sequence; symbols are 1 .. base - 1, 0 lies between."""
    n = max(0, len(sym) - k + 1)
    code, top, ok = sym[:n], base, sym[:n] > 0
    for d in range(1, k):
        if top * base >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            top = len(code) + 1
        code, top, ok = code * base + sym[d : d + n], top * base, ok & (sym[d : d + n] > 0)
    at = np.flatnonzero(ok)
    return at, code[at]


def local_scores(a: list[np.ndarray], b: list[np.ndarray], sc: Scores = Scores()) -> np.ndarray:
    """(len(a), len(b)): the best local score of every a with every b."""
    try:
        return _scores(a, b, sc)
    except _TooMany:
        if len(b) > 1:
            h = len(b) // 2
            return np.concatenate([local_scores(a, b[:h], sc), local_scores(a, b[h:], sc)], 1)
        if len(a) > 1:
            h = len(a) // 2
            return np.concatenate([local_scores(a[:h], b, sc), local_scores(a[h:], b, sc)])
        return K.best_scores(a, b, Edges(), sc)[:, :1].astype(np.int32)


def _scores(a, b, sc: Scores) -> np.ndarray:
    best = np.zeros(len(a) * len(b), np.int32)
    if not len(best):
        return best.reshape(len(a), len(b))
    (x, x0), (y, y0) = _joined(a), _joined(b)
    sym = np.unique(np.append(np.concatenate([x, y]), -1), return_inverse=True)[1][:-1].astype(np.int64)
    base = int(sym.max()) + 1
    x, y = sym[: len(x)], sym[len(x) :]
    k = min(-sc.mismatch, sc.gap_open + sc.gap_ext) // sc.match + 1
    both, split = np.concatenate([x, y]), len(x)
    at, code = _grams(both, k, base)
    in_y = at >= split
    _sweep(x, x0, [len(s) for s in a], y, y0, [len(s) for s in b], at[~in_y], code[~in_y], at[in_y] - split, code[in_y], k, best, sc)
    best = best.reshape(len(a), len(b))
    for run in range(k, 0, -1):
        rows, cols = np.flatnonzero((best == 0).any(1)), np.flatnonzero((best == 0).any(0))
        if not len(rows):
            break
        at, code = _grams(both, run, base)
        of = np.where(at < split, np.searchsorted(x0, at, "right") - 1, len(a) + np.searchsorted(y0, at - split, "right") - 1)
        pick = np.concatenate([np.isin(np.arange(len(a)), rows), np.isin(np.arange(len(b)), cols)])[of]
        of, code = of[pick], code[pick]
        code = np.unique(code, return_inverse=True)[1]
        grams, mine = int(code.max(initial=-1)) + 1, of < len(a)
        for g in range(0, grams, step := max(1, TABLE // (len(a) + len(b)))):
            held = np.zeros((len(a) + len(b), min(step, grams - g)), np.float32)
            now = (code >= g) & (code < g + step)
            held[of[now], code[now] - g] = 1
            if mine[now].any() and not mine[now].all():
                hit = held[rows] @ held[len(a) :][cols].T > 0
                part = best[np.ix_(rows, cols)]
                best[np.ix_(rows, cols)] = np.where(hit & (part == 0), run * sc.match, part)
    return best


def _spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each repeated row, and its place among its repeats."""
    if int(count.sum()) > MOST:
        raise _TooMany
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def _merged(code, h, f):
    """Rows of equal code as one with the largest values, in the order of codes."""
    order = np.argsort(code, kind="stable")
    code = code[order]
    at = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.empty(0, np.int64)
    return (code[at], np.maximum.reduceat(h[order], at), np.maximum.reduceat(f[order], at)) if len(code) else (code, h, f)


def _sweep(x, x0, nx, y, y0, ny, xat, xcode, yat, ycode, k, best, sc: Scores) -> None:
    """Raises best (sequences of x by those of y, flat) to the scores, above k matches, of alignments that begin with these."""
    order = np.argsort(ycode, kind="stable")
    ycode, yat = ycode[order], yat[order]
    low, high = np.searchsorted(ycode, xcode), np.searchsorted(ycode, xcode, "right")
    some = high > low
    xat, low, many = xat[some], low[some], (high - low)[some]
    if not len(xat):
        return
    item = np.searchsorted(x0, xat, "right") - 1
    row = xat - x0[item] + k - 1
    by = np.argsort(row, kind="stable")
    xat, low, many, item, row = (v[by] for v in (xat, low, many, item, row))
    rows = np.searchsorted(row, np.arange(max(nx) + 1))
    line = np.zeros((len(nx), max(nx)), np.int32)
    for i, n in enumerate(nx):
        line[i, :n] = x[x0[i] : x0[i] + n]
    line = np.ascontiguousarray(line.T)
    n, width = len(ny), len(y)
    x, y = (np.append(v, [0] * (k + 2)).astype(np.int32) for v in (x, y))
    of = np.append(0, np.repeat(np.arange(n), np.asarray(ny) + 1))  # of y's places
    end = (y0 + np.asarray(ny))[of]  # the place behind each sequence
    gain, loss = np.int32(sc.match), np.int32(sc.mismatch)
    start, bears = k * gain, np.int32(sc.gap_open + sc.gap_ext + 1)
    # symbols around each k-gram; one that begins a sequence follows no match
    x_before, y_before = np.where(x[xat - 1] > 0, x[xat - 1], -1), y[yat - 1]
    ends_soon = start + 2 * loss <= 0 and start < bears
    x_next, y_next = ([v[at + d] for d in (k, k + 1)] for v, at in ((x, xat), (y, yat)))
    i = j = np.empty(0, np.intp)  # cells that bear no gap: sequence of x, place in y, score
    s = none = np.empty(0, np.int32)
    code, h, f = np.empty(0, np.int64), none, none  # the others

    def stepped(i, j, s):
        """One place on along the diagonal."""
        j = j + 1
        c = y[j]
        same = c == now[i]
        s = s + np.where(same, gain, loss)
        keep = np.flatnonzero((s > 0) & (c > 0))
        return i[keep], j[keep], s[keep], same[keep]

    for r in range(k - 1, max(nx)):
        now = line[r]
        if len(i):
            i, j, s, up = stepped(i, j, s)
            up = np.flatnonzero(up & (s > start))
            np.maximum.at(best, i[up] * n + of[j[up]], s[up])
        a, z = rows[r], rows[r + 1]
        if z > a:
            count = many[a:z]
            to = np.cumsum(count)
            if to[-1] > MOST:
                raise _TooMany
            pos = np.arange(to[-1]) + np.repeat(low[a:z] - to + count, count)
            fresh = np.repeat(x_before[a:z], count) != y_before[pos]
            if ends_soon:
                # two mismatches behind it end a run
                fresh &= (np.repeat(x_next[0][a:z], count) == y_next[0][pos]) | (np.repeat(x_next[1][a:z], count) == y_next[1][pos])
            fresh = np.flatnonzero(fresh)
            i, j, s = np.concatenate([i, np.repeat(item[a:z], count)[fresh]]), np.concatenate([j, yat[pos[fresh]] + k - 1]), np.concatenate([s, np.full(len(fresh), start, np.int32)])
        rich = s >= bears
        if len(code) or rich.any():
            di, dj, dh, _ = stepped(code // width, code % width, h)
            down = np.maximum(h - np.int32(sc.gap_open), f) - np.int32(sc.gap_ext)
            v, get = np.flatnonzero(down > 0), np.flatnonzero(rich)
            code = np.concatenate([di * width + dj, code[v], i[get] * width + j[get]])
            code, h, f = _merged(code, np.concatenate([dh, down[v], s[get]]), np.concatenate([np.zeros(len(di), np.int32), down[v], np.zeros(len(get), np.int32)]))
            # gaps along the row
            src = np.flatnonzero(h >= bears)
            at = code[src] % width
            which, d = _spread(np.minimum((h[src] - sc.gap_open - 1) // sc.gap_ext, end[at] - 1 - at))
            if len(which):
                at = src[which]
                side = (h[at] - sc.gap_open - sc.gap_ext * (d + 1)).astype(np.int32)
                code, h, f = _merged(np.concatenate([code, code[at] + d + 1]), np.concatenate([h, side]), np.concatenate([f, np.zeros(len(at), np.int32)]))
            ci, cj = code // width, code % width
            up = np.flatnonzero(h > start)
            np.maximum.at(best, ci[up] * n + of[cj[up]], h[up])
            stays = (h >= bears) | (f > sc.gap_ext)
            poor, keep = np.flatnonzero(~stays), np.flatnonzero(~rich)
            i, j, s = np.concatenate([i[keep], ci[poor]]), np.concatenate([j[keep], cj[poor]]), np.concatenate([s[keep], h[poor]])
            code, h, f = code[stays], h[stays], f[stays]
        if len(i) > MOST or len(code) > MOST:
            raise _TooMany
