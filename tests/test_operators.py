import random

import pytest
from pyspark.sql import functions as F

from helixweave.functions import kernels as K
from helixweave.functions import linear
from helixweave.functions import sequences as S
from helixweave.functions.scoring import Edges, Scores, border
from helixweave.operators import align, crosspoints, grid, meet, pairs, report, rows, topk, wavefront
from helixweave.sources import fasta, formats
from helixweave.sources.state import RunState
from helixweave.streaming import online

from .brute import best

RNG = random.Random(8)


def dna(n):
    return "".join(RNG.choice("ACGT") for _ in range(n))


@pytest.fixture(scope="module")
def few(spark):
    r = [(1, 2, "ACGTTACGT", "ACGTACGT"), (1, 3, "AAAA", "CCCC"), (2, 3, "", "AC"), (3, 4, "ACGTACGTTTTTACGT", "ACGTACGACGT"), (4, 5, "é" * 5, "é" * 7)]
    return spark.createDataFrame(r, "aid long, bid long, a string, b string")


def test_small_parsers():
    assert [S.parse_size(x) for x in ("0", "1K", "1.5M", "2G")] == [0, 1024, 1572864, 2 << 30]
    assert S.parse_weights("3") == [1, 1, 1] and S.parse_weights("1,2") == [1, 2]
    for bad in ("", "0", "1,-2"):
        with pytest.raises(ValueError):
            S.parse_weights(bad)
    with pytest.raises(ValueError):
        S.parse_size("x")
    for n in (0, 1, 127, 128, 10**12):
        assert S.read_varint(S.varint(n), 0) == (n, len(S.varint(n)))
    assert border("gaps", 3).tolist() == [0, -5, -7, -9] and border("opened", 2).tolist() == [0, -2, -4]
    with pytest.raises(ValueError):
        Edges("x", "*")
    with pytest.raises(ValueError):
        Scores(mismatch=1)


def test_transforms(spark):
    df = spark.createDataFrame([(">gi|1|ref|NC_1| x", "acgtN")], "h string, s string")
    c = F.col("s")
    got = df.select(S.accession(F.col("h")), S.trim(c, 2, 4), S.trim(c, 2, 0), S.reverse(c), S.complement(c), S.reverse_complement(c), S.clear_n(c)).first()
    assert tuple(got) == ("NC_1", "cgt", "cgtN", "Ntgca", "TGCAN", "NACGT", "acgtn")


def test_scores_paths_and_reports_agree(spark, few):
    for e in (Edges(), Edges("+", "+"), Edges("3", "3"), Edges("1", "2")):
        got = {(r.aid, r.bid): r for r in align.with_stats(align.align_path(few, e)).collect()}
        for r in few.collect():
            x = got[(r.aid, r.bid)]
            assert (x.score, x.end_i, x.end_j) == best(r.a, r.b, e)
            assert x.stat_score == x.score
    p = align.align_path(few, Edges("+", "+"))
    lines = report.lines(p.join(few, ["aid", "bid"]), "aid", "bid", width=6).orderBy("aid", "bid", "block").collect()
    for r in few.collect():
        mine = [x for x in lines if (x.aid, x.bid) == (r.aid, r.bid)]
        assert "".join(x["query"] for x in mine).replace("-", "") == r.a and "".join(x.subject for x in mine).replace("-", "") == r.b
    runs = {(r.aid, r.bid): [] for r in few.collect()}
    for r in align.gap_runs(p, "aid", "bid").orderBy("gap_seq", "pos").collect():
        runs[(r.aid, r.bid)].append((r.gap_seq, r.pos, r.len))
    for r in p.collect():
        g0, g1 = formats.gaps_of(r.start_i, r.start_j, r.ops)
        assert runs[(r.aid, r.bid)] == [(0, *x) for x in g0] + [(1, *x) for x in g1]
        data = formats.encode_alignment(r.score, (r.start_i, r.start_j, r.end_i, r.end_j), g0, g1)
        assert formats.decode_alignment(data) == (r.score, (r.start_i, r.start_j, r.end_i, r.end_j), g0, g1)
    assert formats.alignments_binary(p, "aid", "bid").count() == few.count()


def test_all_pairs_is_complete(spark):
    s = spark.createDataFrame([(i, str(i)) for i in range(40)], "seq_id long, seq string")
    got = sorted((r.aid, r.bid, r.a, r.b) for r in pairs.all_pairs(s).collect())
    assert got == [(i, j, str(i), str(j)) for i in range(40) for j in range(i + 1, 40)]


def test_crosspoints(spark, few, tmp_path):
    p = align.align_path(few, Edges("+", "+"))
    pts = crosspoints.from_paths(p, 3, "aid", "bid")
    last = {(r.aid, r.bid): (r.i, r.j, r.score) for r in pts.orderBy("ord").collect()}
    assert last == {(r.aid, r.bid): (r.end_i, r.end_j, r.score) for r in p.collect()}
    total = {(r.aid, r.bid): r.s for r in crosspoints.segments(pts, "aid", "bid").groupBy("aid", "bid").agg(F.sum("d_score").alias("s")).collect()}
    assert total == {(r.aid, r.bid): r.score for r in p.collect()}
    fine = crosspoints.from_paths(p, 1, "aid", "bid")
    assert crosspoints.merge(fine, pts, "aid", "bid").count() == fine.count()
    sized = pts.join(few.select("aid", "bid", F.char_length("a").alias("n"), F.char_length("b").alias("m")), ["aid", "bid"])
    back = crosspoints.reverse(sized, "aid", "bid")
    assert back.where("ord = 0").select("i", "j").distinct().collect() == [(0, 0)]
    text = formats.crosspoints_text(pts, "aid", "bid")
    text.write.partitionBy("aid", "bid").option("lineSep", "\x01").text(str(tmp_path / "cp"))
    assert formats.read_crosspoints(spark, str(tmp_path / "cp")).count() == pts.count()


def test_lookups(spark):
    saved = spark.createDataFrame([(1, 256), (1, 512), (2, 100)], "seq_id long, row_id long")
    pts = spark.createDataFrame([(1, 0), (1, 300), (1, 385), (1, 700), (2, 90), (3, 5)], "seq_id long, i long")
    got = {(r.seq_id, r.i): r.row_id for r in rows.asof_row(pts, saved).collect()}
    assert got == {(1, 0): None, (1, 300): 0, (1, 385): 256, (1, 700): 512, (2, 90): 0, (3, 5): 0}
    a = spark.createDataFrame([(1, [0, 3, 5], [-9, 1, 0])], "id long, h array<int>, g array<int>")
    b = spark.createDataFrame([(1, [2, 4, 1], [-9, 1, 0])], "id long, h array<int>, g array<int>")
    assert [tuple(r) for r in rows.match_borders(a, b, 7).collect()] == [(1, 1, 0, 3)]
    with pytest.raises(Exception, match="more than the goal"):
        rows.match_borders(a, b, 6).collect()


def test_midpoints_reach_the_score(spark):
    data = [(k, dna(RNG.randint(0, 30)), dna(RNG.randint(0, 30))) for k in range(40)]
    df = spark.createDataFrame(data, "id long, a string, b string")
    for r in meet.midpoints(df).collect():
        _, a, b = data[r.id]
        assert r.score == best(a, b, Edges("+", "+"))[0]


def test_grid(spark):
    s = spark.createDataFrame([(1, 10), (2, 0), (3, 7)], "seq_id long, len long")
    parts = grid.split_weighted(s, [1, 2]).orderBy("seq_id", "part").collect()
    assert [(r.j0, r.j1) for r in parts] == [(1, 3), (4, 10), (1, 0), (1, 0), (1, 2), (3, 7)]
    p = spark.createDataFrame([(1, 10, 7)], "id long, n long, m long")
    b = grid.blocks(p, 4, 4, "id").orderBy("by", "bx").collect()
    assert len(b) == 6 and (b[-1].i0, b[-1].i1, b[-1].j0, b[-1].j1) == (8, 10, 4, 7)
    assert [grid.flush_interval(1000, 1000, 80000, k) for k in range(4)] == [101, 101, 50, 50]


def test_block_bests_and_pruning(spark, few):
    got = report.block_scores(few, 3, 4)
    top = {(r.aid, r.bid): r for r in topk.ranked(got, 1, "aid", "bid").collect()}
    for r in few.collect():
        s, i, j = best(r.a, r.b, Edges())
        if s > 0:
            x = top[(r.aid, r.bid)]
            assert (x.score, x.i, x.j) == (s, i, j)
    flags = grid.prune_flags(got, 1, "aid", "bid")
    assert flags.where("prunable and score + least(n - i0, m - j0) > best").count() == 0
    assert grid.downsample(got, 1, "aid", "bid").count() == got.select("aid", "bid").distinct().count()


def test_derived_suppression():
    sc = Scores()
    assert topk.best_list([(50, 60, 60), (49, 61, 62), (30, 400, 10), (5, 1, 1)], 3, 500, 500) == [(50, 60, 60), (30, 400, 10)]
    assert not topk.derived((10, 5, 5), (10, 6, 6), 0, 50, 50, sc)
    assert topk.best_list([], 2, 1, 1) == []
    with pytest.raises(ValueError):
        topk.best_list([(1, 1, 1)], 0, 1, 1)


@pytest.mark.parametrize("edges", [Edges(), Edges("+", "+"), Edges("3", "3")], ids=lambda e: e.start + e.end)
def test_wavefront_equals_one_matrix(spark, tmp_path, edges):
    a = dna(70)
    b = a[:20] + dna(15) + a[25:60]
    path = f"file://{tmp_path}/w"
    if edges.local:
        wavefront.align_large(spark, a, b, len(a), len(b), 20, path, edges, stop_after=3)
    got = wavefront.align_large(spark, a, b, len(a), len(b), 20, path, edges)
    assert got.count() == -(-len(a) // 20) * -(-len(b) // 20)
    if edges.local:
        assert tuple(wavefront.best_of(got).first()) == best(a, b, edges)
        plain = wavefront.align_large(spark, a, b, len(a), len(b), 20, f"file://{tmp_path}/p", edges, prune=False)
        assert tuple(wavefront.best_of(plain).first()) == best(a, b, edges)
        with pytest.raises(ValueError):
            wavefront.align_large(spark, a, b, len(a), len(b) - 1, 20, path, edges)
    else:
        whole = {(r.by, r.bx): r.score for r in report.block_scores(spark.createDataFrame([(a, b)], "a string, b string"), 20, 20, edges).collect()}
        assert {(r.by, r.bx): r.score for r in got.collect()} == whole


def test_run_state(spark, tmp_path):
    s = RunState(spark, f"file://{tmp_path}/state", {"n": 1})
    assert s.load() == (0, 0)
    s.save(2, 5)
    s.save(3, 7)
    assert s.load() == (3, 7)


def test_fasta_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("gi|1|ref|NC_1| one", "ACGTACGT"), ("two", "acg")], "description string, seq string")
    fasta.write_fasta(d, str(tmp_path / "f"), width=3)
    got = {r.accession: (r.description, r.seq, r.len) for r in fasta.read_fasta(spark, str(tmp_path / "f")).collect()}
    assert got == {"NC_1": ("gi|1|ref|NC_1| one", "ACGTACGT", 8), "two": ("two", "ACG", 3)}


def test_cells_and_streams(spark, tmp_path):
    assert formats.cells(spark, "null://5").count() == 5
    assert [r.h for r in formats.cells(spark, "init://4", "gaps").orderBy("k").collect()] == border("gaps", 4).tolist()
    formats.discard(formats.cells(spark, "null://5"))
    targets = spark.createDataFrame([(1, "ACGT"), (2, "TTTT")], "target_id long, target string")
    src = str(tmp_path / "in")
    spark.createDataFrame([(7, "ACGA"), (8, "TTT")], "seq_id long, seq string").write.parquet(src)
    q = online.watch(spark, src, targets, str(tmp_path / "cp"), "scored")
    try:
        q.processAllAvailable()
        got = {(r.seq_id, r.target_id): r.score for r in spark.table("scored").collect()}
        assert got == {(s, t): best(x, y, Edges())[0] for s, x in ((7, "ACGA"), (8, "TTT")) for t, y in ((1, "ACGT"), (2, "TTTT"))}
        assert {(r.target_id, r.score, r.seq_id) for r in online.best_so_far(spark.table("scored")).collect()} == {(1, 3, 7), (2, 3, 8)}
    finally:
        q.stop()


def test_split_columns_equal_unsplit(spark, tmp_path):
    a, b = dna(40), dna(45)
    got = online.split_columns(spark, a, b, 15, f"file://{tmp_path}/s").collect()
    assert max((r.score, -r.i, -r.j) for r in got) == (lambda x: (x[0], -x[1], -x[2]))(best(a, b, Edges()))
    assert int(K.best_scores([K.codes(a)], [K.codes(b)])[0][0]) == max(r.score for r in got)


def test_saved_rows(spark):
    s = spark.createDataFrame([(1, 600), (2, 64), (3, 0), (4, 65)], "seq_id long, len long")
    got = rows.special_rows(s, 64, 4)
    assert sorted((r.seq_id, r.row_id) for r in got.collect()) == [(1, 256), (1, 512), (1, 600), (2, 64), (4, 65)]
    assert {r.seq_id: r.max_gap for r in rows.largest_interval(got).collect()} == {1: 256, 2: 64, 4: 65}


def test_derived_is_the_published_rule():
    """Against the rule written out case by case."""
    rng, sc, seen = random.Random(6), Scores(), [0, 0, 0]
    for _ in range(20_000):
        best_, s = ((rng.randint(-60, 90), rng.randint(0, 90), rng.randint(0, 90)) for _ in range(2))
        n, m, least = rng.randint(20, 90), rng.randint(20, 90), rng.choice([-50, 0, 1])
        dz, dy, dx = (s[k] - best_[k] for k in range(3))
        if dz >= 0:
            want, case = False, 0
        elif least >= 0 and best_[0] > (abs(dx) + abs(dy)) // 2 or least < 0 and abs(dx) + abs(dy) > min(n, m):
            want, case = True, 1
        else:
            one_way = (dx <= 0 and dy <= 0) or (dx >= 0 and dy >= 0)
            gaps = abs(abs(dx) - abs(dy)) if one_way else abs(dx) + abs(dy)
            diagonal = min(abs(dx), abs(dy))
            want, case = -2 * diagonal - 2 * gaps * 2 <= dz <= diagonal - gaps * 2 / 2, 2
        seen[case] += 1
        assert topk.derived(best_, s, least, n, m, sc) == want
    assert min(seen) > 1000
    assert topk.derived((50, 60, 60), (20, 61, 61), 0, 500, 500, sc)


def test_linear_paths_are_optimal():
    for t in range(120):
        a, b = dna(RNG.randint(0, 60)), dna(RNG.randint(0, 60))
        if t % 2:
            b = a[: len(a) // 2] + dna(RNG.randint(0, 20)) + a[len(a) // 2 + RNG.randint(0, 10) :]
        want = best(a, b, Edges("+", "+"))[0]
        for small in (1, 16, 1024):
            ops = linear.path(K.codes(a), K.codes(b), small=small)
            assert linear.score_of(ops) == want
            assert (sum(x in "MXV" for x in ops), sum(x in "MXH" for x in ops)) == (len(a), len(b))


def test_meet_all_is_complete(spark):
    x, y = spark.range(70).withColumnRenamed("id", "a"), spark.range(45).withColumnRenamed("id", "b")
    got = pairs.meet_all(x, y).collect()
    assert len(got) == len({(r.a, r.b) for r in got}) == 70 * 45


def test_fasta_headers_chunks_and_line_ends(spark, tmp_path):
    (tmp_path / "x.fa").write_bytes(b">one > two\r\nAC gt\r\nAA\r\n>gi|1|ref|N_2| x>y\r\nTTTTT\r\n")
    got = fasta.read_fasta(spark, str(tmp_path / "x.fa"))
    assert sorted((r.description, r.accession, r.seq) for r in got.collect()) == [("gi|1|ref|N_2| x>y", "N_2", "TTTTT"), ("one > two", "one > two", "ACGTAA")]
    parts = fasta.fasta_chunks(got, 4, "accession").collect()
    assert sorted(tuple(r) for r in parts) == [("N_2", 0, "TTTT"), ("N_2", 1, "T"), ("one > two", 0, "ACGT"), ("one > two", 1, "AA")]


def test_flush_rows_equal_intervals(spark):
    got = spark.range(8).select(F.lit(1000).cast("long").alias("n"), F.lit(900).cast("long").alias("m"), "id").select("id", grid.flush_rows("n", "m", 70000, "id").alias("r")).collect()
    assert [r.r for r in sorted(got)] == [grid.flush_interval(1000, 900, 70000, k) for k in range(8)]
