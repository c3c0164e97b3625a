"""Alignment of many pairs: scores, ends, paths and statistics.

Rows (pairs) run independently; each Arrow batch is cut into groups of similar length that the kernel
advances together. ``balanced`` deals pairs by their number of cells where lengths are skewed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixweave.functions import kernels as K
from helixweave.functions.scoring import Edges, Scores
from helixweave.functions.seeds import local_scores

#: Characters of both sequences that one kernel call sees at most.
STEP_CHARS = 4_000_000
#: Characters of the texts of either side that meet in one block, about; pairs of texts whose scores are held at once.
BLOCK_CHARS, BLOCK_PAIRS = 250_000, 1_000_000


def _slices(batch: pa.RecordBatch):
    used = at = 0
    for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
        size = len(a or "") + len(b or "")
        if i > at and used + size > STEP_CHARS:
            yield batch.slice(at, i - at)
            at, used = i, 0
        used += size
    if batch.num_rows > at:
        yield batch.slice(at)


def _codes(batch):
    return ([K.codes(x or "") for x in batch.column(c).to_pylist()] for c in ("a", "b"))


def _keep(df: DataFrame) -> str:
    return "".join(f"`{c}` {t}, " for c, t in df.dtypes if c not in ("a", "b"))


def balanced(pairs: DataFrame) -> DataFrame:
    """Pairs dealt round the shuffle partitions, so that few bytes that cost many cells still spread.

    Adaptive execution judges partitions by their bytes and would run a small table's pairs in one task.
    """
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(n)


def align_score(pairs: DataFrame, edges: Edges = Edges(), scores: Scores = Scores()) -> DataFrame:
    """Columns of pairs but the texts, with score, end_i, end_j (-1 for an empty local alignment)."""

    def run(batches):
        for whole in batches:
            for batch in _slices(whole):
                a, b = _codes(batch)
                got = K.best_scores(a, b, edges, scores)
                names = [c for c in batch.schema.names if c not in ("a", "b")]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(got[:, i]) for i in range(3))], [*names, "score", "end_i", "end_j"])

    return pairs.mapInArrow(run, _keep(pairs) + "score long, end_i long, end_j long")


def _chunks(texts: list[str], pairs: int):
    """Ranges of texts of about BLOCK_CHARS characters and of at most so many texts."""
    at = used = 0
    for k, x in enumerate(texts):
        if k > at and (used + len(x) > BLOCK_CHARS or k - at >= pairs):
            yield at, k
            at, used = k, 0
        used += len(x)
    if len(texts) > at:
        yield at, len(texts)


def _meet(sc: Scores):
    """(name, ids, scores) for each text of a block and each part of the items that it meets there (items come first)."""

    def scored(names, texts, ids, items):
        codes = [K.codes(x) for x in texts]
        for a, z in _chunks(items, BLOCK_PAIRS):
            # equal items are scored once
            own = {x: k for k, x in enumerate(dict.fromkeys(items[a:z]))}
            of = np.array([own[x] for x in items[a:z]])
            x, id_ = [K.codes(s) for s in own], np.array(ids[a:z], np.int64)
            for i, k in _chunks(texts, max(1, BLOCK_PAIRS // (z - a))):
                got = local_scores(x, codes[i:k], sc)[of].T
                off = pa.array(np.arange(k - i + 1, dtype=np.int32) * (z - a))
                lists = [pa.ListArray.from_arrays(off, pa.array(v)) for v in (np.tile(id_, k - i), np.ascontiguousarray(got).ravel())]
                yield pa.RecordBatch.from_arrays([pa.array(names[i:k]), *lists], ["name", "ids", "scores"])

    def run(batches):
        now, ids, items, names, texts, size = None, [], [], [], [], 0
        for batch in batches:
            for cell, id_, name, text in zip(*(batch.column(c).to_pylist() for c in ("cell", "id", "name", "text")), strict=True):
                if cell != now or size > BLOCK_CHARS:
                    yield from scored(names, texts, ids, items)
                    names, texts, size = [], [], 0
                if cell != now:
                    now, ids, items = cell, [], []
                if name is None:
                    ids.append(id_)
                    items.append(text)
                else:
                    names.append(name)
                    texts.append(text)
                    size += len(text)
        yield from scored(names, texts, ids, items)

    return run


def local_scores_of_all(left: DataFrame, right: DataFrame, scores: Scores = Scores()) -> DataFrame:
    """(columns of left but b, item_id, score): best local scores of every text b of left with every a of right (item_id, a).

    Equal texts of left are scored once. Both sides are dealt into groups of about BLOCK_CHARS characters, and every two
    groups meet in a block; a task runs one block after the other.
    """
    spark = left.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = left.withColumn("_name", F.md5("b"))
    texts = named.select("_name", "b").dropDuplicates(["_name"])
    room = lambda df, c: int(df.agg(F.sum(F.char_length(c) + 1)).first()[0] or 0) // BLOCK_CHARS + 1
    # few characters on the left still keep all tasks busy
    down = room(right, "a")
    across = max(room(texts, "b"), -(-least // down))
    deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    x = right.where("a is not null").select(deal("a", down).alias("g"), F.col("item_id").cast("long").alias("id"), F.lit(None).cast("string").alias("name"), F.col("a").alias("text"), every(across).alias("o"))
    y = texts.where("b is not null").select(every(down).alias("g"), F.lit(None).cast("long").alias("id"), F.col("_name").alias("name"), F.col("b").alias("text"), deal("_name", across).alias("o"))
    rows = x.unionByName(y).select((F.col("o") * down + F.col("g")).alias("cell"), "id", "name", "text")
    parts = min(across * down, max(least, 4096))
    rows = rows.repartitionById(parts, (F.col("cell") % parts).cast("int")).sortWithinPartitions("cell", F.asc_nulls_first("name"))
    got = rows.mapInArrow(_meet(scores), "name string, ids array<long>, scores array<int>").withColumnRenamed("name", "_name")
    pairs = named.drop("b").join(got, "_name").select(*[F.col(f"`{c}`") for c in left.columns if c != "b"], F.explode(F.arrays_zip("ids", "scores")).alias("_x"))
    return pairs.select(*[F.col(f"`{c}`") for c in left.columns if c != "b"], F.col("_x.ids").alias("item_id"), F.col("_x.scores").cast("long").alias("score"))


def align_edges(pairs: DataFrame, kinds: list[Edges], scores: Scores = Scores()) -> DataFrame:
    """align_score for several edge rules at once: one row for each pair and rule."""

    def run(batches):
        for whole in batches:
            for batch in _slices(whole):
                a, b = _codes(batch)
                names = [c for c in batch.schema.names if c not in ("a", "b")]
                for e in kinds:
                    got = K.best_scores(a, b, e, scores)
                    n = batch.num_rows
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([e.start] * n), pa.array([e.end] * n), *(pa.array(got[:, i]) for i in range(3))], [*names, "start_edge", "end_edge", "score", "end_i", "end_j"])

    return pairs.mapInArrow(run, _keep(pairs) + "start_edge string, end_edge string, score long, end_i long, end_j long")


def align_path(pairs: DataFrame, edges: Edges = Edges(), scores: Scores = Scores()) -> DataFrame:
    """One optimal alignment: score, first and last symbols (from 1; -1 if empty), and its operations.

    ops: M match, X mismatch, V gap on sequence b (a symbol of a alone), H gap on sequence a.
    """

    def run(batches):
        for whole in batches:
            for batch in _slices(whole):
                a, b = _codes(batch)
                p = K.best_paths(a, b, edges, scores)
                names = [c for c in batch.schema.names if c not in ("a", "b")]
                first = [(x.start[0] + 1, x.start[1] + 1) if x.end[0] >= 0 else (-1, -1) for x in p]
                cols = [pa.array([x.score for x in p], pa.int64()), *(pa.array([x[k] for x in first], pa.int64()) for k in (0, 1)), *(pa.array([x.end[k] for x in p], pa.int64()) for k in (0, 1)), pa.array([x.ops for x in p], pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *cols], [*names, "score", "start_i", "start_j", "end_i", "end_j", "ops"])

    return pairs.mapInArrow(run, _keep(pairs) + "score long, start_i long, start_j long, end_i long, end_j long, ops string")


def with_stats(paths: DataFrame, scores: Scores = Scores()) -> DataFrame:
    """Adds matches, mismatches, gap_openings, gap_extensions and the score that follows from them."""
    n = lambda r: F.regexp_count(F.col("ops"), F.lit(r)).cast("long")
    got = paths.withColumns({"matches": n("M"), "mismatches": n("X"), "gap_openings": n("V+") + n("H+"), "gap_extensions": n("[VH]")})
    value = F.col("matches") * scores.match + F.col("mismatches") * scores.mismatch - F.col("gap_openings") * scores.gap_open - F.col("gap_extensions") * scores.gap_ext
    return got.withColumn("stat_score", value)


def gap_runs(paths: DataFrame, *keys: str) -> DataFrame:
    """(keys, gap_seq, pos, len, delta): runs of gaps; pos is the last symbol before the gap in the gapped sequence.

    gap_seq 0: gap on sequence a (H), 1: gap on sequence b (V). delta: distance from the gap before in the same sequence.
    """
    lead = F.regexp_extract_all(F.col("ops"), F.lit("([MX]+|V+|H+)"), F.lit(1))
    runs = paths.select(*keys, "start_i", "start_j", F.posexplode(lead).alias("k", "run"))
    size, kind = F.char_length("run").cast("long"), F.left("run", F.lit(1))
    before = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    # symbols consumed before each run
    used = lambda start, other: F.col(start) - 1 + F.coalesce(F.sum(F.when(kind != other, size).otherwise(0)).over(before), F.lit(0))
    at = F.when(kind == "H", used("start_i", "H")).otherwise(used("start_j", "V"))
    got = runs.select(*keys, F.when(kind == "H", 0).when(kind == "V", 1).alias("gap_seq"), at.alias("pos"), size.alias("len")).where("gap_seq is not null")
    w = Window.partitionBy(*keys, "gap_seq").orderBy("pos")
    return got.withColumn("delta", F.col("pos") - F.lag("pos", 1, 0).over(w))


_SEGMENT = "kind string, seg long, i0 long, j0 long, i1 long, j1 long"


def merge_walk(span: tuple[int, int, int, int], gaps0: list[tuple[int, int]], gaps1: list[tuple[int, int]]) -> list[tuple]:
    """(kind, i0, j0, i1, j1) of the path of an alignment from its two sorted gap lists; D diagonal, H gap on a, V gap on b.

    A gap on a lies behind symbol pos of a, one on b behind symbol pos of b; where both lie at one point the path goes on
    with the one on a.
    """
    i, j, out, x, y = span[0] - 1, span[1] - 1, [], 0, 0
    while x < len(gaps0) or y < len(gaps1) or i < span[2]:
        # diagonal steps to the next gap of either list
        a = gaps0[x][0] - i if x < len(gaps0) else span[2] - i
        b = gaps1[y][0] - j if y < len(gaps1) else span[3] - j
        d = min(a, b)
        if d > 0:
            out.append(("D", i, j, i + d, j + d))
            i, j = i + d, j + d
        if x < len(gaps0) and a <= b:
            out.append(("H", i, j, i, j + gaps0[x][1]))
            j, x = j + gaps0[x][1], x + 1
        elif y < len(gaps1) and b <= a:
            out.append(("V", i, j, i + gaps1[y][1], j))
            i, y = i + gaps1[y][1], y + 1
        elif d <= 0:
            break
    if (i, j) != (span[2], span[3]):
        raise ValueError("the gaps do not fit the span")
    return out


def segments_of(packed: DataFrame, *keys: str) -> DataFrame:
    """(keys, kind, seg, i0, j0, i1, j1) of rows (keys, start_i, start_j, end_i, end_j, gaps0, gaps1), without operations."""

    def run(batches):
        for batch in batches:
            out, at = [], []
            for k, r in enumerate(batch.select(["start_i", "start_j", "end_i", "end_j", "gaps0", "gaps1"]).to_pylist()):
                lists = ([(g["pos"], g["len"]) for g in sorted(r[c], key=lambda g: g["pos"])] for c in ("gaps0", "gaps1"))
                got = merge_walk((r["start_i"], r["start_j"], r["end_i"], r["end_j"]), *lists)
                out += [(s[0], n, *s[1:]) for n, s in enumerate(got)]
                at += [k] * len(got)
            rows = pa.array(at, pa.int64())
            kinds = [pa.string(), *[pa.int64()] * 5]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in keys), *(pa.array([s[k] for s in out], t) for k, t in enumerate(kinds))], [*keys, *(c.split()[0] for c in _SEGMENT.split(", "))])

    types = dict(packed.dtypes)
    rows = packed.select(*keys, "start_i", "start_j", "end_i", "end_j", "gaps0", "gaps1")
    return rows.mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", " + _SEGMENT)
