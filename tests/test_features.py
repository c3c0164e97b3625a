"""FASTA by ranges, row budgets, early midpoints, gap walks, the table function and growing columns."""

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from helixweave.functions import kernels as K
from helixweave.functions import linear, table
from helixweave.functions.scoring import Edges
from helixweave.operators import align, crosspoints, meet, report, rows, wavefront
from helixweave.plans import registry
from helixweave.sources import cells, fasta, formats, tagged
from helixweave.streaming import columns


def plain_records(text, size, marked=False):
    out, head = [], None
    for k, line in enumerate(text.replace("\r\n", "\n").split("\n")):
        if line.startswith(">") or (k == 0 and not marked):
            head = [line.removeprefix(">"), ""]
            out.append(head)
        elif head:
            head[1] += "".join(c.upper() if "a" <= c <= "z" else c for c in line if c != " ")
    return {(d, n, s[n * size : (n + 1) * size]) for d, s in out for n in range(-(-len(s) // size))}, [d for d, _ in out]


@pytest.mark.parametrize("split", [7, 64, 1000, 10**7])
def test_fasta_records_over_many_splits(spark, tmp_path, split):
    rng = random.Random(split)
    line = lambda n: "".join(rng.choice("acgtNé -") for _ in range(n))
    text = ">gi|1|ref|A1| long > one\n" + "\n".join(line(60) for _ in range(40)) + "\r\n>empty\n>two\n\n" + line(500) + "\n" + line(3) + "\n>last\n" + line(61)
    Path(tmp_path, "x.fa").write_bytes(text.encode())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    try:
        heads, chunks = fasta.scan_fasta(spark, f"{tmp_path}/x.fa", 50)
        names = {r.record: r.description for r in heads.collect()}
        got = chunks.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
    want, order = plain_records(text, 50)
    assert [names[k] for k in sorted(names)] == order and sorted(names) == list(range(4))
    assert {(names[r.record], r.no, r.bases) for r in got} == want and len(got) == len(want)


def test_fasta_volumes_and_files_without_marks(spark, tmp_path):
    (tmp_path / "v").mkdir()
    for k, t in enumerate([">one\nAC\n", "GT\nTT\n>two\nA", "CCC\n"]):
        Path(tmp_path, "v", f"part-{k}").write_text(t)
    heads, chunks = fasta.scan_fasta(spark, f"{tmp_path}/v", 4, volumes=True)
    assert {r.record: r.description for r in heads.collect()} == {0: "one", 1: "two"}
    assert sorted((r.record, r.no, r.bases) for r in chunks.collect()) == [(0, 0, "ACGT"), (0, 1, "TT"), (1, 0, "ACCC")]
    heads, chunks = fasta.scan_fasta(spark, f"{tmp_path}/v", 4)
    assert sorted((r.file[-1], r.record, r.description) for r in heads.collect()) == [("0", 0, "one"), ("1", 0, "GT"), ("1", 1, "two"), ("2", 0, "CCC")]
    assert sorted((r.file[-1], r.record, r.bases) for r in chunks.collect()) == [("0", 0, "AC"), ("1", 0, "TT"), ("1", 1, "A")]
    Path(tmp_path, "none").write_text("")
    heads, chunks = fasta.scan_fasta(spark, f"{tmp_path}/none", 4)
    assert heads.count() == chunks.count() == 0


def test_documents_of_one_id_keep_their_lines_together(spark, tmp_path):
    """Lines of rows that repeat a doc_id were mixed when each line was sorted by itself."""
    docs = [(1, "a" * 150 + "b" * 30, "s"), (1, "C" * 200, "s"), (2, "x" * 70, "s"), (3, None, "s"), (4, "", "t"), (5, ">é" * 60, None)]
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.description: r.bases for r in registry.queries()["fasta_ranges"](spark, str(tmp_path)).collect()}
    first, second = "A" * 150 + "B" * 30, "C" * 200
    assert got.pop("s") in (first + second + "X" * 70, second + first + "X" * 70)
    assert got == {"": ".é" * 60}


def test_crosspoint_lists_share_files(spark, tmp_path):
    points = spark.range(3000).select((F.col("id") % 1000).alias("aid"), (F.col("id") % 1000 + 1).cast("string").alias("b,id"), F.floor(F.col("id") / 1000).cast("int").alias("ord"), F.lit(1).alias("type"), F.col("id").alias("i"), (-F.col("id")).alias("j"), F.lit(7).cast("long").alias("score"))
    points = points.withColumnRenamed("b,id", "bid").withColumn("bid", F.concat(F.lit('a "b", '), "bid"))
    formats.write_crosspoint_lists(points, f"{tmp_path}/lists", "aid", "bid")
    files = [p for p in Path(tmp_path, "lists").rglob("part-*")]
    assert 0 < len(files) < 50 and files[0].read_text().split("\n")[1] == "START"
    got = formats.read_crosspoint_lists(spark, f"{tmp_path}/lists", "aid long, bid string")
    assert got.dtypes == points.dtypes and sorted(got.collect()) == sorted(points.collect())


def test_rows_keep_a_budget(spark):
    saved = spark.createDataFrame([(k, 32 * r, 100 * (k + 1)) for k in range(6) for r in range(1, 14)], "aln long, row_id long, bytes long")
    for budget in (0, 99, 100, 450, 1300, 10**6):
        got = {}
        for r in rows.within_budget(saved, budget, "aln").collect():
            got.setdefault(r.aln, []).append((r.row_id, r.thinned))
        for k in range(6):
            size = 100 * (k + 1)
            kept = sorted(got.get(k, []))
            assert len(kept) * size <= budget
            if budget >= size:
                step = 2 ** kept[0][1] if kept else None
                assert not kept or [r for r, _ in kept] == [32 * step * i for i in range(1, len(kept) + 1)]
                # half the distance would not fit
                assert not kept or step == 1 or 13 // (step // 2) * size > budget


def test_border_kinds(spark):
    got = rows.border_kinds(spark.createDataFrame([(s,) for s in "*123+"], "start string")).collect()
    assert {(r.start, r.side): r.kind for r in got} == {(s, side): "zeroes" if s in free else "gaps" for s in "*123+" for side, free in (("R", "*13"), ("C", "*23"))}


def random_pair(rng):
    return ("".join(rng.choice("ACG") for _ in range(rng.randrange(1, 40))) for _ in range(2))


@pytest.mark.parametrize("step", [1, 5, 100])
def test_early_midpoints_lie_on_best_paths(step):
    rng = random.Random(step)
    for _ in range(60):
        a, b = (K.codes(x) for x in random_pair(rng))
        goal = int(K.best_scores([a], [b], Edges("+", "+"))[0][0])
        for both in (True, False):
            mid, j, kind, upper, lower, cells = meet.early_midpoint(a, b, goal, step, both)
            assert upper + lower + (3 if kind else 0) == goal and mid == len(a) // 2
            assert cells <= len(a) * len(b)
            parts = [linear.path(a[:mid], b[:j], 0, kind), linear.path(a[mid:], b[j:], kind, 0)]
            assert linear.score_of(parts[0]) + linear.score_of(parts[1], start=kind) == goal
    with pytest.raises(ValueError):
        meet.early_midpoint(a, b, goal + 1, step, True)


def test_early_midpoints_equal_whole_ones(spark):
    rng = random.Random(8)
    p = spark.createDataFrame([(k, *random_pair(rng)) for k in range(50)], "k long, a string, b string")
    scored = p.join(align.align_score(p, Edges("+", "+")).select("k", "score"), "k")
    names = ["k", "mid_i", "mid_j", "type", "upper", "lower"]
    early = meet.midpoints_early(scored, 4, both=False)
    assert sorted(early.select(*names).collect()) == sorted(meet.midpoints(p).select(*names).collect())
    full = sum(len(r.a) * len(r.b) for r in p.collect())
    assert early.agg(F.sum("cells")).first()[0] < 0.9 * full


def test_merge_walk_follows_the_operations():
    rng = random.Random(1)
    for _ in range(300):
        ops = "D" + "".join(rng.choice("DDHV") * rng.randrange(1, 4) for _ in range(rng.randrange(0, 8)))
        ops = ops.replace("D", "M")
        i0, j0 = rng.randrange(5), rng.randrange(5)
        want, i, j = [], i0, j0
        for o in ops:
            kind = "D" if o == "M" else o
            at = i, j
            i, j = i + (o != "H"), j + (o != "V")
            if want and want[-1][0] == kind:
                want[-1][3:] = [i, j]
            else:
                want.append([kind, *at, i, j])
        gaps = formats.gaps_of(i0 + 1, j0 + 1, ops)
        got = align.merge_walk((i0 + 1, j0 + 1, i, j), *(sorted(g) for g in gaps))
        assert [list(x) for x in got] == want, ops
    with pytest.raises(ValueError):
        align.merge_walk((1, 1, 4, 9), [], [])


def test_table_function_in_sql(spark):
    table.register(spark)
    rng = random.Random(2)
    p = spark.createDataFrame([(k, *random_pair(rng), "x") for k in range(40)] + [(99, None, "A", None), (98, "", "", "y")], "k long, a string, b string, note string")
    p.createOrReplaceTempView("some_pairs")
    got = spark.sql("SELECT * FROM align_score(TABLE(some_pairs), '*', '*') WHERE score > 2 ORDER BY k").collect()
    want = align.align_score(p).where("score > 2").orderBy("k").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and got[0].__fields__ == ["k", "note", "score", "end_i", "end_j"]
    for wrong in ("align_score(TABLE(some_pairs), 'x', '*')", "align_score(TABLE(SELECT 1 AS a), '*', '*')"):
        with pytest.raises(AnalysisException):
            spark.sql(f"SELECT * FROM {wrong}").collect()


def test_columns_grow_with_every_trigger(spark, tmp_path):
    rng = random.Random(6)
    pairs = [(k, k + 1, "".join(rng.choice("ACG") for _ in range(rng.randrange(0, 30))), "".join(rng.choice("ACG") for _ in range(rng.randrange(1, 60)))) for k in range(12)]
    size = 7
    for t in range(9):
        # chunks of a pair come in their order, but for pairs of odd number, whose first two are exchanged
        no = lambda k: t if t > 1 or k % 2 == 0 else 1 - t  # noqa: B023, E731
        part = [(k, b_, a, no(k), b[no(k) * size : (no(k) + 1) * size]) for k, b_, a, b in pairs if no(k) * size < len(b)]
        spark.createDataFrame(part, "aid long, bid long, a string, no int, bases string").coalesce(1).write.parquet(f"{tmp_path}/in/{t}")
        stream = spark.readStream.schema("aid long, bid long, a string, no int, bases string").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        columns.follow(stream, f"{tmp_path}/checkpoint", f"{tmp_path}/out")
        got = {r.aid: r for r in spark.read.parquet(f"{tmp_path}/out").groupBy("aid").agg(F.max_by(F.struct("columns", "score", "end_i", "end_j"), "columns").alias("x")).select("aid", "x.*").collect()}
        for k, _, a, b in pairs:
            seen = b[: (t + 1) * size] if t or k % 2 == 0 or len(b) <= size else ""
            if t == 0 and k % 2:
                assert k not in got or got[k].columns == 0
                continue
            if k % 2 and len(b) <= size and t == 0:
                continue
            want = K.best_scores([K.codes(a)], [K.codes(seen)], Edges())[0].tolist()
            assert [got[k].columns, got[k].score, got[k].end_i, got[k].end_j] == [len(seen), *want], (t, k)
    with pytest.raises(ValueError):
        columns.grow(spark.createDataFrame([], "aid long, bid long, a string, no int, bases string"), Edges("+", "+"))


@pytest.mark.parametrize("local", [True, False])
def test_no_path_through_a_block_beats_its_prospects(local):
    rng, sc = random.Random(9), K.Scores()
    edges, tile = (Edges() if local else Edges("+", "+")), 7
    for _ in range(25):
        a, b = (K.codes(x) for x in random_pair(rng))
        n, m = len(a), len(b)
        best = int(K.best_scores([a], [b], edges)[0][0])
        for i0 in range(0, n, tile):
            for j0 in range(0, m, tile):
                x, y = a[i0 : i0 + tile], b[j0 : j0 + tile]
                # every path that meets the block, by what leads to its cells and from them
                cells = [(i, j) for i in range(i0 + 1, i0 + len(x) + 1) for j in range(j0 + 1, j0 + len(y) + 1)]
                kind = Edges("*", "+") if local else edges
                rest = Edges("+", "*") if local else edges
                to = K.best_scores([a[:i] for i, _ in cells], [b[:j] for _, j in cells], kind)[:, 0]
                back = np.maximum(K.best_scores([a[i:] for i, _ in cells], [b[j:] for _, j in cells], rest)[:, 0], 0 if local else -(10**9))
                k = int(to.argmax())
                most, certain = wavefront.prospects(n, m, i0, j0, len(x), len(y), (int(to[k]), cells[k][0] - i0, cells[k][1] - j0), edges, sc)
                assert int((to + back).max()) <= most and certain <= best


@pytest.mark.parametrize("edges", ["*", "+"])
def test_pruned_runs_keep_their_scores(spark, tmp_path, edges):
    rng = random.Random(12)
    a = "".join(rng.choice("ACGT") for _ in range(90))
    b = a[:40] + "".join(rng.choice("ACGT") for _ in range(9)) + a[47:]
    want = K.best_scores([K.codes(a)], [K.codes(b)], Edges(edges, edges))[0].tolist()
    cells = {}
    for kind in ("block", "window"):
        path = f"file://{tmp_path}/{kind}"
        wavefront.align_large(spark, a, b, len(a), len(b), 12, path, Edges(edges, edges), prune=kind, stop_after=4)
        got = wavefront.align_large(spark, a, b, len(a), len(b), 12, path, Edges(edges, edges), prune=kind)
        score = wavefront.best_of(got).first()[0] if edges == "*" else wavefront.corner(spark, path, len(a), len(b), 12)
        assert score == want[0]
        seen = wavefront.statistics(spark, path)
        x = seen.agg(F.sum("blocks").alias("blocks"), F.sum("cells").alias("cells"), F.count("*").alias("steps"), F.min("mcups").alias("mcups")).first()
        assert x.steps == 8 + 8 - 1 and x.blocks == got.count() and 0 < x.cells <= len(a) * len(b) and x.mcups >= 0
        cells[kind] = x.cells
    assert cells["window"] < len(a) * len(b)
    with pytest.raises(ValueError):
        wavefront.align_large(spark, a, b, len(a), len(b), 12, f"file://{tmp_path}/no", prune="other")


@pytest.mark.parametrize("offset,count,reverse,step", [(0, None, False, 10**6), (7, None, True, 5), (3, 11, False, 4), (3, 11, True, 4), (95, 50, True, 3), (200, None, False, 9)])
def test_cell_files_by_ranges(spark, tmp_path, offset, count, reverse, step):
    data = [(k, k * k - 50, -k) for k in range(100)]
    path = f"{tmp_path}/c"
    cells.write_cells(spark.createDataFrame(data[:60], cells.SCHEMA).repartition(3), path)
    cells.write_cells(spark.createDataFrame(data[60:], cells.SCHEMA), path)
    got = spark.read.format("cells").options(offset=offset, reverse=reverse, step=step, **({} if count is None else {"count": count})).load(path)
    stream = [(k, *x[1:]) for k, x in enumerate(data[::-1] if reverse else data)]
    assert sorted(map(tuple, got.collect())) == stream[offset : None if count is None else offset + count]
    assert got.rdd.getNumPartitions() >= len(stream[offset : None if count is None else offset + count]) // step


def test_cell_files_refuse_gaps(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 1), (2, 1, 1)], cells.SCHEMA)
    with pytest.raises(Exception, match="consecutive"):
        cells.write_cells(df, f"{tmp_path}/c")
    cells.write_cells(spark.createDataFrame([(0, 1, 1), (1, 2, 2)], cells.SCHEMA), f"{tmp_path}/d")
    cells.write_cells(spark.createDataFrame([(0, 5, 6)], cells.SCHEMA), f"{tmp_path}/d", "overwrite")
    assert [tuple(r) for r in spark.read.format("cells").load(f"{tmp_path}/d").collect()] == [(0, 5, 6)]


def test_tagged_values():
    r = {"names": ["a é", "b"], "sizes": [300, 40], "score": -7, "stats": [1, 2, 3, 4], "span": [1, 300, 2, 40], "gaps0": [(200, 3), (5, 130)], "gaps1": []}
    data = tagged.write_tagged(r)
    assert data[:6] == b"CGFF\0\1" and data[-1] == 0
    got = {(s, f): v for s, f, v in tagged.fields(data)}
    assert len(got) == 13 and got["sequence0", "description"] == "a é" and got["params", "penalty"] == "2,-3,-2"
    assert got["result", "gaps"] == "1-300[5:130 200:3] 2-40[]" and got["result", "raw_score"] == "-7"
    linear_gap = data.replace(b"\3\2\xff\xff\xff\xfd\xff\xff\xff\xfe", b"\3\1\xff\xff\xff\xfe")
    assert {(s, f): v for s, f, v in tagged.fields(linear_gap)}["params", "penalty"] == "1,-2"
    for wrong in (b"CGFX" + data[4:], data[:4] + b"\1" + data[5:], data.replace(b"\1\0\0\0\4a", b"\7\0\0\0\4a")):
        with pytest.raises(ValueError):
            tagged.fields(wrong)


def test_turns_against_the_turn_before(spark, tmp_path):
    from helixweave.plans import registry

    data = [(1, 0, "user", "acgt acgt"), (1, 1, "bot", "xx ACGTAC"), (1, 2, "user", None), (1, 3, "user", "acg"), (2, 0, "user", "only"), (3, 5, "a", ""), (3, 6, "b", "q")]
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.score for r in registry.turn_echo(spark, str(tmp_path)).collect()}
    assert got == {(1, 1): 6, (1, 3): 3, (3, 6): 0}


def test_lists_of_neighbours_must_meet(spark):
    kind = "aln long, ord int, type int, i long, j long, score long"
    left = spark.createDataFrame([(1, 0, 0, 0, 0, 0), (1, 4, 0, 4, 4, 4)], kind)
    right = [(1, 0, 0, 4, 4, 4), (1, 3, 1, 4, 7, -5)]
    got = crosspoints.concat(left, spark.createDataFrame(right, kind), "aln").orderBy("ord").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0, 0, 0), (1, 4, 0, 4, 4, 4), (1, 7, 1, 4, 7, -5)]
    with pytest.raises(Exception, match="do not meet"):
        crosspoints.concat(left, spark.createDataFrame([(1, 0, 0, 5, 4, 4)], kind), "aln").collect()


def test_renderers(spark):
    p = align.align_path(spark.createDataFrame([(1, "ACGTTTACGT", "ACGTACGT"), (2, "A", "C")], "k long, a string, b string"), Edges("+", "+"))
    both = p.join(spark.createDataFrame([(1, "ACGTTTACGT", "ACGTACGT"), (2, "A", "C")], "k long, a string, b string"), "k")
    steps = {r.k: r.value for r in report.render(p, "steps", "k").collect()}
    assert steps[2] == "1X" and sum(int(x) for x in steps[1].replace("M", " ").replace("V", " ").split()) == 10
    text = {r.k: r.value.split("\n") for r in report.render(both, "text", "k").collect()}
    assert text[1][0].replace("-", "") == "ACGTTTACGT" and text[1][2].replace("-", "") == "ACGTACGT" and text[1][1].count("|") == 8
    assert {r.k: r.value.split("\n")[0] for r in report.render(p, "summary", "k").collect()} == {1: "score: 1", 2: "score: -3"}
    with pytest.raises(ValueError):
        report.render(p, "pdf", "k")
