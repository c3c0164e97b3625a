"""Splitting a global alignment at its middle row: two half matrices that meet.

``midpoints`` runs both halves whole. With the score known, ``midpoints_early`` runs a half by columns and ends when
the halves add up to it: the upper half from the left against a whole lower one ("orthogonal"), or both at once from
either side ("both").
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from helixweave.functions import kernels as K
from helixweave.functions.scoring import INF, Scores, border


def _last_row(a: np.ndarray, b: np.ndarray, sc: Scores) -> tuple[np.ndarray, np.ndarray]:
    """H and F of the last row of a global matrix."""
    m = len(b)
    left = border("gaps", len(a), sc)
    h, f, _, _, _ = K.block(a, b, border("gaps", m, sc), np.full(m + 1, -INF, np.int32), left, np.full(len(a) + 1, -INF, np.int32), False, sc)
    if len(a):
        f[0] = left[-1]
    return h, f


def midpoints(pairs: DataFrame, scores: Scores = Scores()) -> DataFrame:
    """(keys, mid_i, mid_j, type, upper, lower, score): where an optimal global path crosses the middle row.

    type 0: the halves add up to the score by H + H; 1: inside a vertical gap, by F + F + open. The
    first column that fits is taken, H before the gap.
    """
    keys = [c for c in pairs.columns if c not in ("a", "b")]

    def run(batches):
        for batch in batches:
            out = []
            for ta, tb in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                a, b = K.codes(ta or ""), K.codes(tb or "")
                mid = len(a) // 2
                h1, f1 = _last_row(a[:mid], b, scores)
                h2, f2 = (x[::-1] for x in _last_row(a[mid:][::-1], b[::-1], scores))
                hh, gg = h1.astype(np.int64) + h2, f1.astype(np.int64) + f2 + scores.gap_open
                goal = int(max(hh.max(), gg.max()))
                j = int(np.flatnonzero((hh == goal) | (gg == goal))[0])
                kind = 0 if hh[j] == goal else 1
                out.append((mid, j, kind, int(h1[j] if kind == 0 else f1[j]), int(h2[j] if kind == 0 else f2[j]), goal))
            names = ["mid_i", "mid_j", "type", "upper", "lower", "score"]
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array(c, pa.int64()) for c in cols)], [*keys, *names])

    types = dict(pairs.dtypes)
    return pairs.mapInArrow(run, ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"{c} long" for c in ("mid_i", "mid_j", "type", "upper", "lower", "score")]))


class _Columns:
    """A global half matrix by columns: H and F of its last row as far as the columns go."""

    def __init__(self, a: np.ndarray, b: np.ndarray, sc: Scores):
        # the turned matrix: its rows are the columns
        self.a, self.b, self.sc, self.used = a, b, sc, 0
        self.top = border("gaps", len(a), sc)
        self.low = np.full(len(a) + 1, -INF, np.int32)
        self.h = np.full(len(b) + 1, -INF, np.int64)
        self.f = self.h.copy()
        self.h[0] = self.top[-1]
        self.f[0] = self.top[-1] if len(a) else -INF

    def go(self, to: int) -> None:
        at, to = self.used, min(to, len(self.b))
        if to > at:
            left = border("gaps", to, self.sc, at)
            self.top, self.low, h, e, _ = K.block(self.b[at:to], self.a, self.top, self.low, left, np.full(to - at + 1, -INF, np.int32), False, self.sc)
            self.h[at + 1 : to + 1], self.f[at + 1 : to + 1] = h[1:], e[1:]
            self.used = to


def early_midpoint(a: np.ndarray, b: np.ndarray, goal: int, step: int, both: bool, sc: Scores = Scores()) -> tuple:
    """(mid_i, mid_j, type, upper, lower, cells): cells computed until the halves add up to the goal."""
    mid, m = len(a) // 2, len(b)
    upper, lower = _Columns(a[:mid], b, sc), _Columns(a[mid:][::-1], b[::-1], sc)
    if not both:
        lower.go(m)
    t = 0
    while True:
        upper.go(t)
        if both:
            lower.go(t)
        # the columns that both halves have reached
        j0, j1 = m - lower.used, upper.used
        if j0 <= j1:
            h1, f1 = upper.h[j0 : j1 + 1], upper.f[j0 : j1 + 1]
            h2, f2 = lower.h[::-1][j0 : j1 + 1], lower.f[::-1][j0 : j1 + 1]
            hit = np.flatnonzero((h1 + h2 == goal) | (f1 + f2 + sc.gap_open == goal))
            if len(hit):
                k = int(hit[0])
                kind = 0 if h1[k] + h2[k] == goal else 1
                cells = mid * upper.used + (len(a) - mid) * lower.used
                return mid, j0 + k, kind, int(h1[k] if kind == 0 else f1[k]), int(h2[k] if kind == 0 else f2[k]), cells
        if t >= m:
            raise ValueError(f"the halves never add up to {goal}")
        t += step


def midpoints_early(pairs: DataFrame, step: int = 8, both: bool = True, scores: Scores = Scores()) -> DataFrame:
    """midpoints of pairs that carry their global score, with cells; columns advance by step.

    Of several columns that fit, the one reached first counts, then the smaller one.
    """
    keys = [c for c in pairs.columns if c not in ("a", "b")]
    names = ["mid_i", "mid_j", "type", "upper", "lower", "cells"]

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "score")), strict=True)
            out = [early_midpoint(K.codes(a or ""), K.codes(b or ""), goal, step, both, scores) for a, b, goal in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array([x[k] for x in out], pa.int64()) for k in range(6))], [*keys, *names])

    types = dict(pairs.dtypes)
    return pairs.mapInArrow(run, ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"{c} long" for c in names]))
