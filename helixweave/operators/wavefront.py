"""One large pair as a wavefront of blocks.

Blocks of an anti-diagonal are rows of a DataFrame and run in parallel; a block needs the row border
of the block above and the column border of the block to its left, which meet it by joins on the block
numbers. After each diagonal the borders are written to the shared folder: lineage stays short, an
executor may be lost, and a later run resumes from the last diagonal written. Sequences are read by
the blocks in chunks of their own, so no task ever holds a whole sequence. Local alignments prune:
a block all of whose neighbours were prunable is skipped when even a perfect rest of the diagonal
could not beat the best score so far.
"""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from helixweave.functions import kernels as K
from helixweave.functions.scoring import INF, Edges, Scores, border
from helixweave.sources.state import RunState

_BLOCK = "by int, bx int, score long, i long, j long, pruned boolean, certain long, cells long, row_h binary, row_f binary, col_h binary, col_e binary"


def chunks(spark: SparkSession, seq: str | DataFrame, size: int) -> DataFrame:
    """(no, bases) of a sequence given as a string or already as such chunks."""
    if isinstance(seq, str):
        return spark.createDataFrame([(k // size, seq[k : k + size]) for k in range(0, len(seq), size)], "no int, bases string")
    return seq


def prospects(n: int, m: int, i0: int, j0: int, height: int, width: int, best: tuple[int, int, int], edges: Edges, sc: Scores) -> tuple[int, int]:
    """(most that a path through a block can reach, what is certain after it); best: score, row and column in the block."""
    s, i, j = best
    if edges.local:
        return s + sc.match * min(n - i0, m - j0), s
    gap = lambda k: sc.gap_open + k * sc.gap_ext if k > 0 else 0
    down, right = n - i0, m - j0
    # a path that is inside a gap here has paid for opening it
    most = s + sc.match * min(down, right) - sc.gap_ext * max(0, abs(down - right) - max(height, width))
    down, right = n - i0 - i, m - j0 - j
    return most, s + sc.mismatch * min(down, right) - gap(abs(down - right))


def _run(n: int, m: int, tile: int, edges: Edges, sc: Scores, best: int, prune: bool):
    def borders(row, i0, j0, height, width):
        if row["row_h"] is not None:
            top_h, top_f = np.frombuffer(row["row_h"], np.int32), np.frombuffer(row["row_f"], np.int32)
        else:
            top_h = border("zeroes" if edges.free_row else "gaps", j0 + width, sc, j0) if i0 == 0 else np.full(width + 1, -INF, np.int32)
            top_f = np.full(width + 1, -INF, np.int32)
        if row["col_h"] is not None:
            left_h, left_e = np.frombuffer(row["col_h"], np.int32), np.frombuffer(row["col_e"], np.int32)
        else:
            left_h = border("zeroes" if edges.free_column else "gaps", i0 + height, sc, i0) if j0 == 0 else np.full(height + 1, -INF, np.int32)
            left_e = np.full(height + 1, -INF, np.int32)
        return top_h, top_f, left_h, left_e

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                a, b = K.codes(r["a"]), K.codes(r["b"])
                i0, j0 = r["by"] * tile, r["bx"] * tile
                if r["skip"]:
                    # nothing through here can win: borders that no path comes back from
                    dead = np.full(len(b) + 1, 0 if edges.local else -INF, np.int32)
                    dead_c = np.full(len(a) + 1, 0 if edges.local else -INF, np.int32)
                    low, low_c = np.full(len(b) + 1, -INF, np.int32), np.full(len(a) + 1, -INF, np.int32)
                    out.append((r["by"], r["bx"], -INF, -1, -1, True, -INF, 0, dead.tobytes(), low.tobytes(), dead_c.tobytes(), low_c.tobytes()))
                    continue
                h, f, rh, re, (s, i, j) = K.block(a, b, *borders(r, i0, j0, len(a), len(b)), edges.local, sc)
                most, certain = prospects(n, m, i0, j0, len(a), len(b), (s, i, j), edges, sc)
                # a global path may be the certain one itself
                hopeless = prune and (most <= best if edges.local else most < best)
                out.append((r["by"], r["bx"], s, i0 + i, j0 + j, hopeless, certain, len(a) * len(b), h.tobytes(), f.tobytes(), rh.tobytes(), re.tobytes()))
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), *[pa.binary()] * 4]
            names = ["by", "bx", "score", "i", "j", "pruned", "certain", "cells", "row_h", "row_f", "col_h", "col_e"]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names)

    return run


def align_large(spark: SparkSession, seq0: str | DataFrame, seq1: str | DataFrame, n: int, m: int, tile: int, path: str, edges: Edges = Edges(), scores: Scores = Scores(), prune: bool | str = True, stop_after: int | None = None) -> DataFrame:
    """Block results (by, bx, score, i, j, pruned) of one pair, read from ``path``; resumes what is there.

    Every diagonal is one directory; its rows keep the borders, which are the special rows of the run. prune: "block"
    (or True), "window", or "" (or False) for none; alignments that neither are local nor end in the corner never prune.
    """
    kind = "block" if prune is True else prune or ""
    if kind not in ("", "block", "window"):
        raise ValueError(f"no such pruning: {kind}")
    kind = kind if (edges.local and edges.end == "*") or (edges.start, edges.end) == ("+", "+") else ""
    a = chunks(spark, seq0, tile).select(F.col("no").alias("by"), F.col("bases").alias("a"))
    b = chunks(spark, seq1, tile).select(F.col("no").alias("bx"), F.col("bases").alias("b"))
    high, wide = -(-n // tile), -(-m // tile)
    state = RunState(spark, f"{path}/state", {"n": n, "m": m, "tile": tile, "edges": edges.start + edges.end, "prune": kind})
    done, best = state.load()
    best = best if done or edges.local else -INF
    cuts = [tuple(x["live"]) if x.get("live") else None for x in state.steps()][-2:]
    schema = spark.createDataFrame([], _BLOCK).schema
    for d in range(done, high + wide - 1):
        if stop_after is not None and d >= stop_after:
            break
        began = time.perf_counter()
        left, right = max(0, d - high + 1), min(d, wide - 1)
        if kind == "window":
            left, right = window(d, left, right, cuts, n, m, tile, best, edges, scores)
        cells = spark.range(left, right + 1).select((F.lit(d) - F.col("id")).cast("int").alias("by"), F.col("id").cast("int").alias("bx"))
        before = lambda k: spark.read.schema(schema).parquet(f"{path}/diagonal={d - k}") if d >= k else spark.createDataFrame([], schema)  # noqa: B023, E731
        one, two = before(1), before(2)
        up = one.select((F.col("by") + 1).alias("by"), "bx", "row_h", "row_f", F.col("pruned").alias("p1"))
        side = one.select("by", (F.col("bx") + 1).alias("bx"), "col_h", "col_e", F.col("pruned").alias("p2"))
        todo = cells.join(a, "by").join(b, "bx").join(up, ["by", "bx"], "left").join(side, ["by", "bx"], "left")
        skip = F.lit(False)
        if kind == "block":
            corner = two.select((F.col("by") + 1).alias("by"), (F.col("bx") + 1).alias("bx"), F.col("pruned").alias("p3"))
            todo = todo.join(corner, ["by", "bx"], "left")
            skip = F.coalesce((F.col("by") > 0) & (F.col("bx") > 0) & F.col("p1") & F.col("p2") & F.col("p3"), F.lit(False))
        todo = todo.withColumn("skip", skip).select("by", "bx", "a", "b", "row_h", "row_f", "col_h", "col_e", "skip")
        seen = Observation()
        live = F.when(~F.col("pruned"), F.col("bx"))
        found = todo.repartition("by").mapInArrow(_run(n, m, tile, edges, scores, best, bool(kind)), _BLOCK)
        found.observe(seen, F.max("certain").alias("certain"), F.count("*").alias("blocks"), F.count_if("pruned").alias("hopeless"), F.sum("cells").alias("cells"), F.min(live).alias("first"), F.max(live).alias("last")).write.mode("overwrite").parquet(f"{path}/diagonal={d}")
        x = seen.get
        best = max(best, x["certain"] if x["certain"] is not None else best)
        cuts = [*cuts, (x["first"], x["last"]) if x["first"] is not None else None][-2:]
        state.save(d + 1, best, {"blocks": x["blocks"], "hopeless": x["hopeless"], "cells": x["cells"] or 0, "live": cuts[-1], "seconds": time.perf_counter() - began})
    return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/diagonal=*").select("by", "bx", "score", "i", "j", "pruned")


def window(d: int, left: int, right: int, cuts: list, n: int, m: int, tile: int, best: int, edges: Edges, sc: Scores) -> tuple[int, int]:
    """First and last column of the blocks of diagonal d that a live block leads to, or where a path may begin.

    cuts: first and last live column of the two diagonals before (None: no live block).
    """
    if d == 0:
        return left, right
    reach = []
    if cuts and cuts[-1]:
        reach += [cuts[-1][0], cuts[-1][1] + 1]
    if len(cuts) > 1 and cuts[-2]:
        reach += [cuts[-2][0] + 1, cuts[-2][1] + 1]
    # along the edges a path may come from the border alone
    for bx in {left, right}:
        by = d - bx
        if bx == 0 or by == 0:
            i0, j0 = by * tile, bx * tile
            top = 0 if edges.local else int(border("gaps", i0 + j0, sc, i0 + j0)[0]) if i0 + j0 else 0
            most = prospects(n, m, i0, j0, min(tile, n - i0), min(tile, m - j0), (top, 0, 0), edges, sc)[0]
            if most > best or (not edges.local and most == best):
                reach.append(bx)
    reach = [max(left, min(right, x)) for x in reach]
    return (min(reach), max(reach)) if reach else (left, left - 1)


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """(step, blocks, hopeless, cells, seconds, mcups) of each diagonal of a run, as its state has them."""
    rows = [(k, x["blocks"], x["hopeless"], x["cells"], x["seconds"], x["cells"] / 1e6 / max(x["seconds"], 1e-9)) for k, x in enumerate(RunState(spark, f"{path}/state", {}).steps())]
    return spark.createDataFrame(rows, "step long, blocks long, hopeless long, cells long, seconds double, mcups double")


def corner(spark: SparkSession, path: str, n: int, m: int, tile: int) -> int:
    """The score of a finished global alignment: H in the last corner."""
    y, x = (n - 1) // tile, (m - 1) // tile
    last = spark.read.schema(_BLOCK).parquet(f"{path}/diagonal={x + y}").where((F.col("by") == y) & (F.col("bx") == x)).select("row_h").first()[0]
    return int(np.frombuffer(last, np.int32)[-1])


def best_of(blocks: DataFrame) -> DataFrame:
    """(score, i, j) of the best block cell: score desc, i asc, j asc."""
    return blocks.agg(F.max(F.struct("score", (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))).alias("x")).select("x.score", (-F.col("x.i")).alias("i"), (-F.col("x.j")).alias("j"))
