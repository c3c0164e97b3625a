"""Strips, refinement and the operators around them against whole matrices."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from helixweave.functions import kernels as K
from helixweave.functions import linear
from helixweave.functions.scoring import ALL_EDGES, Edges, border
from helixweave.operators import strips, wavefront


def random_pairs(n, seed=7):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        a = "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 150)))
        b = list(a)
        for _ in range(rng.randrange(0, 12)):
            at = rng.randrange(len(b) + 1)
            if rng.random() < 0.5:
                b[at : at + rng.randrange(1, 25)] = []
            else:
                b[at:at] = [rng.choice("ACGT") for _ in range(rng.randrange(1, 25))]
        out.append((k, a, "".join(b) or "A"))
    return [*out, (n, "A" * 60, "T" * 50), (n + 1, "A" * 100, "A" * 3), (n + 2, "C", "ACGT" * 30), (n + 3, "GATTACA" * 9, "GATTACA" * 9)]


def test_border_slices():
    for kind in ("zeroes", "gaps", "opened"):
        assert (border(kind, 20, start=7) == border(kind, 20)[7:]).all()


def check_path(a, b, edges, r, best):
    """The operations lead from the start to the end, and are worth the best score."""
    i0, j0 = r.start_i - 1, r.start_j - 1
    used_a, used_b = (sum(o in s for o in r.ops) for s in ("MXV", "MXH"))
    assert (i0 + used_a, j0 + used_b) == (best[1], best[2]) == (r.end_i, r.end_j)
    i, j = i0, j0
    for o in r.ops:
        assert o not in "MX" or (a[i] == b[j]) == (o == "M")
        i, j = i + (o in "MXV"), j + (o in "MXH")
    assert linear.score_of(r.ops) == best[0] == r.path_score
    if not edges.local:
        assert (i0 == 0 or edges.free_column) and (j0 == 0 or edges.free_row) and (i0 == 0 or j0 == 0)


@pytest.mark.parametrize("edges", [Edges("*", "*"), Edges("+", "+"), Edges("2", "3")], ids=lambda e: e.start + e.end)
def test_strips_find_best_paths(spark, tmp_path, edges):
    pairs = random_pairs(30)
    df = spark.createDataFrame(pairs, "aln long, a string, b string").repartition(3)
    saved = strips.save_rows(df, 16, 11, edges)
    saved.write.parquet(f"{tmp_path}/saved")
    saved = spark.read.parquet(f"{tmp_path}/saved")
    chunks = [strips.chunked(df, side, 11) for side in "ab"]
    points = strips.trace_points(spark, *chunks, saved, 11, str(tmp_path), 5, edges)
    parts = strips.partitions(points, *chunks, 11)
    small = strips.refine(spark, parts, 12, str(tmp_path), least=4)
    assert small.where("i1 > i0 and j1 > j0 and greatest(i1 - i0, j1 - j0) > 12").count() == 0
    got = {r.aln: r for r in strips.joined(strips.solved(small)).collect()}
    computed = dict(points.groupBy("aln").agg(F.sum("cells")).collect())
    for k, a, b in pairs:
        best = K.best_scores([K.codes(a)], [K.codes(b)], edges)[0].tolist()
        if k not in got:
            assert best[1] < 0 or best[1] == 0 or best[2] == 0 or best[0] == 0
            continue
        check_path(a, b, edges, got[k], best)
        assert computed[k] <= len(a) * (len(b) + 11)
    # strips end at the goal: a path along the diagonal leaves most of each strip alone
    assert computed[33] < 0.6 * 63 * 63 or edges.start != "*"


def test_cut_points_lie_on_best_paths():
    rng = random.Random(3)
    for _, a, b in random_pairs(40, 5):
        x, y = K.codes(a), K.codes(b)
        if len(x) < 4:
            continue
        start, end = rng.choice([0, 1, 2]), rng.choice([0, 1, 2])
        rows = sorted(rng.sample(range(1, len(x)), min(3, len(x) - 1)))
        cuts = [(0, 0, start), *strips.cut_points(x, y, start, end, rows), (len(x), len(y), end)]
        whole = linear.score_of(linear.path(x, y, start, end), start=start)
        total = sum(linear.score_of(linear.path(x[i:i2], y[j:j2], s, s2), start=s) for (i, j, s), (i2, j2, s2) in zip(cuts, cuts[1:], strict=False))
        assert total == whole


def test_no_pairs_no_points(spark, tmp_path):
    df = spark.createDataFrame([], "aln long, a string, b string")
    strips.save_rows(df, 16, 8).write.parquet(f"{tmp_path}/saved")
    chunks = [strips.chunked(df, side, 8) for side in "ab"]
    points = strips.trace_points(spark, *chunks, spark.read.parquet(f"{tmp_path}/saved"), 8, str(tmp_path))
    assert strips.refine(spark, strips.partitions(points, *chunks, 8), 8, str(tmp_path)).count() == 0
    assert len(ALL_EDGES) == 25 and np.int32(0) == 0


def test_strips_between_the_borders_of_a_wavefront(spark, tmp_path):
    rng = random.Random(21)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    a = dna(70)
    b = dna(4) + a[:24] + dna(31) + a[30:70]  # a gap over several blocks
    path = f"file://{tmp_path}/w"
    wavefront.align_large(spark, a, b, len(a), len(b), 12, path, prune="window")
    df = spark.createDataFrame([(0, a, b)], "aln long, a string, b string")
    chunks = [strips.chunked(df, side, 12) for side in "ab"]
    points = strips.trace_points(spark, *chunks, strips.rows_of(spark, path, 12), 12, path, 6)
    pieces = strips.solved(strips.partitions(points, *chunks, 12))
    check_path(a, b, Edges(), strips.joined(pieces).first(), K.best_scores([K.codes(a)], [K.codes(b)])[0].tolist())
    # a job for each row of blocks, not for each block
    assert points.agg(F.max("ord")).first()[0] <= 1 + len(a) // 12
