import random

import numpy as np
import pytest

from helixweave.functions import kernels as K
from helixweave.functions.scoring import ALL_EDGES, INF, Edges, Scores

from .brute import best, matrix

RNG = random.Random(4)


def seq(low=0, high=14, letters="ACGT"):
    return "".join(RNG.choice(letters) for _ in range(RNG.randint(low, high)))


@pytest.mark.parametrize("edges", ALL_EDGES, ids=lambda e: e.start + e.end)
def test_scores_and_ends_equal_the_cell_loop(edges):
    pairs = [(seq(letters="ACG"), seq(letters="ACG")) for _ in range(40)] + [("", ""), ("", "AC"), ("AC", ""), ("A", "A"), ("A", "C"), ("ACNA", "ACnA"), ("é", "é")]
    got = K.best_scores([K.codes(a) for a, _ in pairs], [K.codes(b) for _, b in pairs], edges)
    assert [tuple(r) for r in got.tolist()] == [best(a, b, edges) for a, b in pairs]


@pytest.mark.parametrize("edges", ALL_EDGES, ids=lambda e: e.start + e.end)
def test_paths_add_up_to_their_score(edges):
    sc = Scores()
    pairs = [(seq(), seq()) for _ in range(40)] + [("", ""), ("", "AC"), ("AC", "")]
    for (a, b), p in zip(pairs, K.best_paths([K.codes(a) for a, _ in pairs], [K.codes(b) for _, b in pairs], edges), strict=True):
        assert p.score == best(a, b, edges)[0]
        if p.end == (-1, -1):
            assert not p.ops
            continue
        (i, j), x = p.start, 0
        assert (i == 0 or edges.free_column and j == 0 or edges.local) and (j == 0 or edges.free_row and i == 0 or edges.local)
        total, before = 0, ""
        for o in p.ops:
            if o in "MX":
                assert (a[i] == b[j]) == (o == "M")
                total += sc.match if o == "M" else sc.mismatch
                i, j = i + 1, j + 1
            else:
                total -= sc.gap_ext + (sc.gap_open if o != before else 0)
                i, j = i + (o == "V"), j + (o == "H")
            before = o
        assert (i, j) == p.end and total == p.score


@pytest.mark.parametrize("tile", [3, 5, 16])
def test_blocks_with_borders_equal_the_matrix(tile):
    for edges in (Edges("*", "*"), Edges("1", "1"), Edges("2", "2"), Edges("3", "3"), Edges("+", "+")):
        a, b = seq(8, 30), seq(8, 30)
        h, e, f = matrix(a, b, edges)
        n, m = len(a), len(b)
        rows, cols = {0: (np.array(h[0]), np.full(m + 1, -INF))}, {}
        for i in range(0, n, tile):
            i2 = min(n, i + tile)
            for j in range(0, m, tile):
                j2 = min(m, j + tile)
                top_h, top_f = (x[j : j2 + 1] for x in rows[i])
                left_h, left_e = cols.get((i, j), (np.array([h[r][0] for r in range(i, i2 + 1)]), np.full(i2 - i + 1, -INF)))
                bh, bf, rh, re, _ = K.block(K.codes(a[i:i2]), K.codes(b[j:j2]), top_h, top_f, left_h, left_e, edges.local)
                assert bh[1:].tolist() == h[i2][j + 1 : j2 + 1] and rh[1:].tolist() == [h[r][j2] for r in range(i + 1, i2 + 1)]
                assert bf[1:].tolist() == f[i2][j + 1 : j2 + 1] and re[1:].tolist() == [e[r][j2] for r in range(i + 1, i2 + 1)]
                old = rows.setdefault(i2, (np.zeros(m + 1, int), np.full(m + 1, -INF)))
                old[0][j : j2 + 1], old[1][j + 1 : j2 + 1] = bh, bf[1:]
                cols[(i, j2)] = (rh, re)


def test_swapping_and_reversing_keep_the_score():
    for _ in range(20):
        a, b = K.codes(seq(1, 20)), K.codes(seq(1, 20))
        s = [K.best_scores([x], [y])[0][0] for x, y in ((a, b), (b, a), (a[::-1], b[::-1]))]
        assert s[0] == s[1] == s[2]


@pytest.mark.parametrize("edges", ALL_EDGES, ids=lambda e: e.start + e.end)
def test_pairs_side_by_side_equal_row_by_row(edges, monkeypatch):
    rng = np.random.default_rng(3)
    a, b = ([rng.integers(0, 4, rng.integers(0, 30)).astype(np.int32) for _ in range(120)] for _ in range(2))
    monkeypatch.setattr(K, "SCORE_CELLS", 900)
    got = K.best_scores(a, b, edges)
    monkeypatch.setattr(K, "SIDE_BY_SIDE", 10**9)
    assert (got == K.best_scores(a, b, edges)).all()


def test_long_pairs_side_by_side():
    """Sums beyond 16 bits, and symbols beyond them."""
    a = [np.full(9000 + k, 70_000, np.int32) for k in range(9)]
    assert K.best_scores(a, a)[:, 0].tolist() == [9000 + k for k in range(9)]
