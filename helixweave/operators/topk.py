"""Bounded lists of distinct good alignments: candidates derived from a better one are suppressed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixweave.functions.scoring import Scores


def derived(best: tuple, s: tuple, min_score: int, n: int, m: int, sc: Scores) -> bool:
    """Whether candidate s (score, i, j) is explained by the better kept ``best``.

    It is where gaps from the best to it would cost less than the best's score (or, if scores below 0 count,
    where it lies farther off than the shorter sequence is long), and where its score is what a path between
    the two could give.
    """
    dx, dy, dz = s[2] - best[2], s[1] - best[1], s[0] - best[0]
    if dz >= 0:
        return False
    far = abs(dx) + abs(dy)
    if min_score >= 0 and best[0] > far // sc.gap_ext:
        return True
    if min_score < 0 and far > min(n, m):
        return True
    same = dx * dy >= 0
    gaps = abs(abs(dx) - abs(dy)) if same else far
    diag = min(abs(dx), abs(dy))
    low = int((sc.mismatch * 0.75 + sc.match * 0.25) * diag)
    cost = sc.gap_ext * gaps
    return low - 2 * cost <= dz <= sc.match * diag - cost / 2


def best_list(candidates: list[tuple], limit: int, n: int, m: int, min_score: int = 0, sc: Scores = Scores()) -> list[tuple]:
    """At most ``limit`` (score, i, j), best first, none derived from one before it.

    Scores below min_score go, and those below a quarter of a positive best (1.1 times a negative one).
    """
    if limit < 1:
        raise ValueError("at least one alignment is kept")
    kept: list[tuple] = []
    for s in sorted(set(candidates), key=lambda s: (-s[0], s[1], s[2])):
        if len(kept) == limit:
            break
        if s[0] < min_score or (kept and (s[0] < 0.25 * kept[0][0] if kept[0][0] > 0 else s[0] < 1.10 * kept[0][0])):
            continue
        if not any(derived(b, s, min_score, n, m, sc) for b in kept):
            kept.append(s)
    return kept


def ranked(scores: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k best rows of each key: score desc, i asc, j asc."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "i", "j")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def distinct_best(scores: DataFrame, limit: int, key: str, min_score: int = 0, sc: Scores = Scores()) -> DataFrame:
    """(key, rank, score, i, j) for candidates (key, n, m, score, i, j), one list for each key.

    A key's candidates are the block bests of one pair, so a group is bounded by the pair's grid.
    """
    import pandas as pd

    def run(group: pd.DataFrame) -> pd.DataFrame:
        got = best_list(list(group[["score", "i", "j"]].itertuples(index=False, name=None)), limit, int(group.n.iloc[0]), int(group.m.iloc[0]), min_score, sc)
        return pd.DataFrame([(group[key].iloc[0], r + 1, *x) for r, x in enumerate(got)], columns=[key, "rank", "score", "i", "j"])

    return scores.groupBy(key).applyInPandas(run, f"{key} string, rank int, score long, i long, j long")
