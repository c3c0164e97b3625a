"""Scoring parameters and the rules for where an alignment may start and end."""

from __future__ import annotations

from dataclasses import dataclass

INF = 999_999_999
#: Start and end rules: anywhere, edge of sequence 1, edge of sequence 2, either edge, corner.
EDGES = ("*", "1", "2", "3", "+")


@dataclass(frozen=True)
class Scores:
    """Affine gaps: a gap of length n costs gap_open + n * gap_ext."""

    match: int = 1
    mismatch: int = -3
    gap_open: int = 3
    gap_ext: int = 2

    def __post_init__(self):
        if self.match <= 0 or self.mismatch >= 0 or self.gap_open < 0 or self.gap_ext <= 0:
            raise ValueError("match must be positive, mismatch negative, gap costs not negative")


@dataclass(frozen=True)
class Edges:
    start: str = "*"
    end: str = "*"

    def __post_init__(self):
        if self.start not in EDGES or self.end not in EDGES:
            raise ValueError(f"start and end are among {' '.join(EDGES)}")

    @property
    def local(self) -> bool:
        """Scores are clamped at 0."""
        return self.start == "*"

    @property
    def free_row(self) -> bool:
        """The first row costs nothing (any part of sequence 1 may be skipped)."""
        return self.start in "*13"

    @property
    def free_column(self) -> bool:
        return self.start in "*23"


ALL_EDGES = [Edges(s, e) for s in EDGES for e in EDGES]


def border(kind: str, n: int, scores: Scores = Scores(), start: int = 0):
    """Index start..n of a synthetic border: 'zeroes', 'gaps' (open at index 1) or 'opened' (already open)."""
    import numpy as np

    k = np.arange(start, n + 1, dtype=np.int32)
    if kind == "zeroes":
        return np.zeros(n + 1 - start, np.int32)
    if kind == "opened":
        return -scores.gap_ext * k
    if kind == "gaps":
        return np.where(k > 0, -scores.gap_ext * k - scores.gap_open, 0).astype(np.int32)
    raise ValueError(kind)
