"""Paths of many long pairs at once, by strips between saved rows.

A forward pass keeps every ``every``-th row of each pair's matrix, cut into pieces of ``width`` columns. The way
back is a table of points, one for each pair: an as-of lookup finds the saved row that a point's strip reaches up
to, and the strip's matrix is run in reverse from the point, piece by piece from right to left, until a reverse
border and the saved one add up to the goal; what lies further left is never computed, and what no path with this
score can reach is not even read. Each round moves all pairs one strip up, so there are as many jobs as rows that the
longest path crosses, whatever the number of pairs and of blocks. Sequences come in chunks (aln, no, bases) of
``width`` symbols: a strip's task holds its own symbols and one piece at a time. One huge pair is a table of one
pair, whose saved rows are the borders that a wavefront has written (``rows_of``).

The points cut the paths into partitions. ``refine`` splits partitions that are too large at rows of their own,
turning the matrix from round to round; ``solved`` aligns what is left, each partition by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixweave.functions import kernels as K
from helixweave.functions import linear
from helixweave.functions.scoring import INF, Edges, Scores, border

from .align import _slices
from .rows import asof_row
from .wavefront import _BLOCK, best_of

_PART = "aln long, i0 long, j0 long, i1 long, j1 long, start_type int, end_type int, a string, b string"
_POINT = "aln long, ord int, i long, j long, type int, score long, done boolean, cells long"


def save_rows(pairs: DataFrame, every: int, width: int, edges: Edges = Edges(), scores: Scores = Scores()) -> DataFrame:
    """(aln, row_id, no, h, g, score, end_i, end_j) of pairs (aln, a, b).

    Rows with row_id hold H and F of columns no * width .. (no + 1) * width, both inclusive, of every every-th matrix
    row; the one without row_id holds the best score and where it ends ((0, -1, -1) for an empty local alignment).
    """

    def run(batches):
        for batch in (x for whole in batches for x in _slices(whole)):
            both = [[K.codes(t or "") for t in batch.column(c).to_pylist()] for c in ("a", "b")]
            # ends of pairs of similar size together, rows pair by pair
            ends = K.best_scores(*both, edges, scores).tolist()
            for aln, a, b, best in zip(batch.column("aln").to_pylist(), *both, ends, strict=True):
                n, m = len(a), len(b)
                out = [(aln, None, None, None, None, *best)]
                h = border("zeroes" if edges.free_row else "gaps", m, scores)
                f, side = np.full(m + 1, -INF, np.int32), border("zeroes" if edges.free_column else "gaps", n, scores)
                # rows below the end are of no use
                for i in range(every, best[1], every):
                    h, f, _, _, _ = K.block(a[i - every : i], b, h, f, side[i - every : i + 1], np.full(every + 1, -INF, np.int32), edges.local, scores)
                    for no in range(-(-m // width)):
                        cols = slice(no * width, (no + 1) * width + 1)
                        out.append((aln, i, no, h[cols].tobytes(), f[cols].tobytes(), None, None, None))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["aln", "row_id", "no", "h", "g", "score", "end_i", "end_j"])

    return pairs.select("aln", "a", "b").mapInArrow(run, "aln long, row_id long, no int, h binary, g binary, score long, end_i long, end_j long")


class _Strip:
    """One point's way back to the saved row above it."""

    def __init__(self, r: dict, edges: Edges, sc: Scores):
        self.r, self.edges, self.sc = r, edges, sc
        self.x = K.codes(r["strip"])[::-1]
        self.used, self.cells, self.found = 0, 0, None
        n = len(self.x)
        _, side = linear.first_borders(n, 0, r["type"], True, sc)
        self.left_h, self.left_e = side, np.full(n + 1, -INF, np.int32)

    def _top(self, m: int) -> np.ndarray:
        """The reverse matrix's first row over the next m columns."""
        state, at = self.r["type"], self.used
        if state == 1:
            return np.full(m + 1, -INF, np.int32)
        top = border("gaps", at + m, self.sc, at)
        if at == 0 and state == 2:
            top[0] = -INF
        return top

    def piece(self, no: int, bases: str, h, g, width: int) -> None:
        r, n = self.r, len(self.x)
        y = K.codes(bases)[: r["j"] - no * width][::-1]
        m = len(y)
        goal, at = r["score"], r["j"] - self.used  # the piece's columns lead from at down to at - m
        bh, bf, rh, re, best = K.block(self.x, y, self._top(m), np.full(m + 1, -INF, np.int32), self.left_h, self.left_e, False, self.sc)
        # a later piece's first column is the last one of the piece before
        bf[0] = -INF if self.used else self.left_h[-1]
        self.cells += n * m
        if self.edges.local and best[0] == goal:
            self.found = (r["i"] - best[1], at - best[2], 0, 0, True)
            return
        if r["row"]:
            line, open_ = (np.frombuffer(v, np.int32)[: m + 1].astype(np.int64) for v in (h, g))
        else:
            line = border("zeroes" if self.edges.free_row else "gaps", at, self.sc, at - m).astype(np.int64)
            open_ = np.full(m + 1, -INF, np.int64)
        whole, through = line + bh[::-1] == goal, open_ + bf[::-1] + self.sc.gap_open == goal
        k = np.flatnonzero(whole | through)
        if len(k):
            # the first one met from the right
            k = int(k[-1])
            kind = 0 if whole[k] else 1
            j, e = at - m + k, self.edges
            done = kind == 0 and (not r["row"] and (e.free_row or not j) or not j and e.free_column or e.local and line[k] == 0)
            self.found = (r["row"], j, kind, int(line[k] if kind == 0 else open_[k]), bool(done))
            return
        self.used, self.left_h, self.left_e = self.used + m, rh, re
        if self.used == r["j"]:
            self._edge()

    def _edge(self) -> None:
        """The path leaves at the matrix's first column."""
        r, n = self.r, len(self.x)
        side = border("zeroes" if self.edges.free_column else "gaps", r["i"], self.sc, r["row"]).astype(np.int64)
        k = np.flatnonzero(side + self.left_h[::-1] == r["score"])
        if len(k):
            k = int(k[-1])
            i = r["row"] + k
            self.found = (i, 0, 0, int(side[k]), self.edges.free_column or i == 0)


def _walk(width: int, edges: Edges, sc: Scores):
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64()]
    names = [c.split()[0] for c in _POINT.split(", ")]

    def out(done):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], t) for k, t in enumerate(kinds)], names)

    def close(now: _Strip, done: list):
        if now.found is None:
            raise ValueError(f"the saved rows hold no path to {now.r['i']}, {now.r['j']}")
        done.append((now.r["aln"], now.r["ord"] + 1, *now.found, now.cells))

    def run(batches):
        now, done = None, []
        for batch in batches:
            heads = batch.column("strip").is_valid().to_pylist()
            for k, head in enumerate(heads):
                if head:
                    if now:
                        close(now, done)
                    now = _Strip(batch.slice(k, 1).to_pylist()[0], edges, sc)
                elif now.found is None:
                    # pieces beyond the goal are skipped
                    now.piece(*(batch.column(c)[k].as_py() for c in ("no", "bases", "h", "g")), width)
            if done:
                yield out(done)
                done = []
        if now:
            close(now, done)
            yield out(done)

    return run


def chunked(pairs: DataFrame, column: str, width: int) -> DataFrame:
    """(aln, no, bases): the sequences of one side in chunks of width symbols."""
    return pairs.select("aln", F.posexplode(F.regexp_extract_all(column, F.lit(f"(?s)(.{{1,{width}}})"), F.lit(1))).alias("no", "bases"))


def rows_of(spark: SparkSession, path: str, tile: int) -> DataFrame:
    """What save_rows gives, for the one pair (aln 0) whose wavefront was written to a path: a row for each row of blocks."""
    blocks = spark.read.schema(_BLOCK).option("basePath", path).parquet(f"{path}/diagonal=*")
    none = F.lit(None).cast("long")
    aln = F.lit(0).cast("long").alias("aln")
    rows = blocks.select(aln, ((F.col("by") + 1) * tile).cast("long").alias("row_id"), F.col("bx").alias("no"), F.col("row_h").alias("h"), F.col("row_f").alias("g"), none.alias("score"), none.alias("end_i"), none.alias("end_j"))
    top = best_of(blocks).where("score > 0")
    return rows.unionByName(top.select(aln, none.alias("row_id"), F.lit(None).cast("int").alias("no"), F.lit(None).cast("binary").alias("h"), F.lit(None).cast("binary").alias("g"), "score", F.col("i").alias("end_i"), F.col("j").alias("end_j")))


def _spelled(spans: DataFrame, chunks: DataFrame, low: str, high: str, width: int, name: str, *keys: str) -> DataFrame:
    """(keys, name): the symbols low .. high of each span (keys, aln, low, high), put together from chunks."""
    nos = F.explode(F.sequence(F.floor(F.col(low) / width).cast("int"), F.floor((F.col(high) - 1) / width).cast("int")))
    parts = spans.select("aln", *[k for k in keys if k != "aln"], low, high, nos.alias("no")).join(chunks, ["aln", "no"])
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "bases"))), lambda x: x["bases"]), "")
    got = parts.groupBy(*keys, low, high).agg(whole.alias(name))
    return got.select(*keys, F.expr(f"substring({name}, CAST({low} % {width} + 1 AS INT), CAST({high} - {low} AS INT))").alias(name))


def trace_points(spark: SparkSession, a: DataFrame, b: DataFrame, saved: DataFrame, width: int, path: str, min_dist: int = 128, edges: Edges = Edges(), scores: Scores = Scores()) -> DataFrame:
    """(aln, ord, i, j, type, score, done, cells): the points of each path, the end first; cells: computed on the way to it.

    a, b: chunks of the sequences; saved: what save_rows gave for the same width. All three are read every round and
    should be written tables. path: a folder that all executors share.
    """
    ends = saved.where("row_id is null and end_i >= 0")
    first = ends.select("aln", F.lit(0).alias("ord"), F.col("end_i").alias("i"), F.col("end_j").alias("j"), F.lit(0).alias("type"), "score", ((F.col("end_i") == 0) & F.lit(edges.free_row) | (F.col("end_j") == 0) & F.lit(edges.free_column) | (F.col("end_i") + F.col("end_j") == 0)).alias("done"), F.lit(0).cast("long").alias("cells"))
    first.write.parquet(f"{path}/points/round=0")
    rows = saved.where("row_id is not null")
    ids = rows.where("no = 0").select(F.col("aln").alias("seq_id"), "row_id")
    k, names = 0, [c.split()[0] for c in _POINT.split(", ")]
    keep = ["aln", "ord", "i", "j", "type", "score", "row"]
    while True:
        at = spark.read.schema(_POINT).parquet(f"{path}/points/round={k}").where("not done")
        if not at.limit(1).count():
            break
        # along the matrix's edge the rest is one gap
        flat = at.where("i = 0 or j = 0").select("aln", (F.col("ord") + 1).alias("ord"), *[F.lit(0).cast(t).alias(c) for c, t in (("i", "long"), ("j", "long"), ("type", "int"), ("score", "long"))], F.lit(True).alias("done"), F.lit(0).cast("long").alias("cells"))
        at = at.where("i > 0 and j > 0")
        row = asof_row(at.select(F.col("aln").alias("seq_id"), "i"), ids, min_dist).select(F.col("seq_id").alias("aln"), F.col("row_id").alias("row"))
        at = at.join(row, "aln").select(*keep)
        none = [F.lit(None).cast(t).alias(c) for c, t in (("no", "int"), ("bases", "string"), ("h", "binary"), ("g", "binary"))]
        heads = _spelled(at, a, "row", "i", width, "strip", "aln").join(at, "aln").select(*keep, "strip", *none)
        # a saved row holds at most a match for each of its rows: more columns than this cost more than the rest can gain
        least = F.col("j") - (F.col("i") - F.col("row")) - F.floor((F.col("i") * scores.match - F.col("score")) / scores.gap_ext) - 1
        near = (F.col("no") * F.lit(width) < F.col("j")) & ((F.col("no") + 1) * F.lit(width) >= F.col("least"))
        pieces = at.withColumn("least", least).join(b, "aln").where(near).drop("least")
        borders = rows.select("aln", F.col("row_id").alias("row"), "no", "h", "g")
        pieces = pieces.join(borders, ["aln", "row", "no"], "left").select(*keep, F.lit(None).cast("string").alias("strip"), "no", "bases", "h", "g")
        tasks = heads.unionByName(pieces).repartition("aln").sortWithinPartitions("aln", F.col("no").desc_nulls_first())
        tasks.mapInArrow(_walk(width, edges, scores), _POINT).unionByName(flat).select(*names).write.parquet(f"{path}/points/round={k + 1}")
        k += 1
    return spark.read.schema(_POINT).parquet(*[f"{path}/points/round={x}" for x in range(k + 1)])


def partitions(points: DataFrame, a: DataFrame, b: DataFrame, width: int) -> DataFrame:
    """(aln, i0, j0, i1, j1, start_type, end_type, a, b) between consecutive points, with the symbols they span.

    Mere gaps carry no symbols (null): their lengths say all.
    """
    now = points.select("aln", "ord", F.col("i").alias("i1"), F.col("j").alias("j1"), F.col("type").alias("end_type"))
    above = points.select("aln", (F.col("ord") - 1).alias("ord"), F.col("i").alias("i0"), F.col("j").alias("j0"), F.col("type").alias("start_type"))
    both = now.join(above, ["aln", "ord"]).where("i1 > i0 or j1 > j0")
    full = both.where("i1 > i0 and j1 > j0")
    key = ["aln", "ord"]
    got = both.join(_spelled(full, a, "i0", "i1", width, "a", *key), key, "left").join(_spelled(full, b, "j0", "j1", width, "b", *key), key, "left")
    return got.select(*[c.split()[0] for c in _PART.split(", ")])


def cut_points(a: np.ndarray, b: np.ndarray, start: int, end: int, rows: list[int], sc: Scores = Scores()) -> list[tuple[int, int, int]]:
    """(i, j, state) where an optimal path of a partition crosses the given rows (ascending, inside the partition)."""
    top, side = linear.first_borders(len(a), len(b), start, False, sc)
    h, f, kept, at = top, np.full(len(b) + 1, -INF, np.int32), [], 0
    for i in rows:
        h, f, _, _, _ = K.block(a[at:i], b, h, f, side[at : i + 1], np.full(i - at + 1, -INF, np.int32), False, sc)
        f[0] = side[i]
        kept.append((h, f))
        at = i
    out, i1, j1, state = [], len(a), len(b), end
    for i, (h, f) in zip(reversed(rows), reversed(kept), strict=True):
        h2, f2 = (v[::-1] for v in linear.last_row(a[i:i1][::-1], b[:j1][::-1], state, True, sc))
        whole, gap = h[: j1 + 1].astype(np.int64) + h2, f[: j1 + 1].astype(np.int64) + f2 + sc.gap_open
        goal = max(whole.max(), gap.max())
        j1 = int(np.flatnonzero((whole == goal) | (gap == goal))[0])
        i1, state = i, 0 if whole[j1] == goal else 1
        out.append((i1, j1, state))
    return out[::-1]




def _split(bound: int, least: int, turned: bool, sc: Scores):
    kinds = [*[pa.int64()] * 5, pa.int32(), pa.int32(), pa.string(), pa.string()]
    names = [c.split()[0] for c in _PART.split(", ")]

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                n, m = r["i1"] - r["i0"], r["j1"] - r["j0"]
                high = m if turned else n
                if not n or not m or max(n, m) <= bound or high <= least:  # a mere gap, or small enough
                    out.append([r[c] for c in names])
                    continue
                x, y, s, e = (r["b"], r["a"], linear.SWAP[r["start_type"]], linear.SWAP[r["end_type"]]) if turned else (r["a"], r["b"], r["start_type"], r["end_type"])
                parts = min(8, -(-high // least))
                rows = sorted({high * k // parts for k in range(1, parts)} - {0, high})
                cuts = [(0, 0, s), *cut_points(K.codes(x), K.codes(y), s, e, rows, sc), (high, len(y), e)]
                for (p, q, t), (p2, q2, t2) in zip(cuts, cuts[1:], strict=False):
                    if turned:
                        p, q, t, p2, q2, t2 = q, p, linear.SWAP[t], q2, p2, linear.SWAP[t2]
                    out.append([r["aln"], r["i0"] + p, r["j0"] + q, r["i0"] + p2, r["j0"] + q2, t, t2, r["a"][p:p2], r["b"][q:q2]])
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)], names)

    return run


def refine(spark: SparkSession, parts: DataFrame, bound: int, path: str, rounds: int = 15, least: int = 16, scores: Scores = Scores()) -> DataFrame:
    """Partitions of at most ``bound`` rows and columns: each round splits the larger ones at up to seven rows, in turned
    matrices every other round; it ends when two rounds make no more of them.

    Gaps along one side stay whole: they need no matrix. Rows of a split lie at least ``least`` apart.
    """
    parts = parts.select(*[c.split()[0] for c in _PART.split(", ")])
    parts.repartition(spark.sparkContext.defaultParallelism).write.parquet(f"{path}/refined/round=0")
    made, still = -1, 0
    for k in range(rounds):
        now = spark.read.schema(_PART).parquet(f"{path}/refined/round={k}")
        count, large = now.agg(F.count("*"), F.count_if(F.expr(f"i1 > i0 and j1 > j0 and greatest(i1 - i0, j1 - j0) > {bound}"))).first()
        still = still + 1 if count == made else 0
        if not large or still > 1:
            return now
        made = count
        # new partitions lie where their parent was: deal them out again
        now.repartition(spark.sparkContext.defaultParallelism).mapInArrow(_split(bound, least, bool(k % 2), scores), _PART).write.parquet(f"{path}/refined/round={k + 1}")
    return spark.read.schema(_PART).parquet(f"{path}/refined/round={rounds}")


def solved(parts: DataFrame, scores: Scores = Scores()) -> DataFrame:
    """(aln, i0, j0, i1, j1, ops, score): each partition's operations and score, in parallel; ops of a mere gap are null."""

    def value(r, ops) -> int:
        if ops is not None:
            return linear.score_of(ops, scores, r["start_type"])
        down, right = r["i1"] - r["i0"], r["j1"] - r["j0"]
        return -scores.gap_ext * (down + right) - (0 if r["start_type"] == (1 if down else 2) else scores.gap_open)

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            ops = [None if r["a"] is None or r["b"] is None else linear.path(K.codes(r["a"]), K.codes(r["b"]), r["start_type"], r["end_type"], scores) for r in rows]
            keep = ["aln", "i0", "j0", "i1", "j1"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(ops, pa.string()), pa.array(map(value, rows, ops), pa.int64())], [*keep, "ops", "score"])

    return parts.mapInArrow(run, "aln long, i0 long, j0 long, i1 long, j1 long, ops string, score long")


def joined(pieces: DataFrame) -> DataFrame:
    """(aln, start_i, start_j, end_i, end_j, ops, path_score): pieces of each path put together, in order."""
    ops = F.coalesce("ops", F.expr("concat(repeat('V', CAST(i1 - i0 AS INT)), repeat('H', CAST(j1 - j0 AS INT)))"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i0", "j0", ops.alias("ops")))), lambda x: x["ops"]), "")
    return pieces.groupBy("aln").agg((F.min("i0") + 1).alias("start_i"), (F.min("j0") + 1).alias("start_j"), F.max("i1").alias("end_i"), F.max("j1").alias("end_j"), whole.alias("ops"), F.sum("score").alias("path_score"))
