"""Readable alignments and block views."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixweave.functions import kernels as K
from helixweave.functions.scoring import Edges, Scores

from .align import with_stats


_LINE = "block long, query string, bars string, subject string, block_score long"


def spelled(a: str, b: str, start_i: int, start_j: int, ops: str, width: int, scores: Scores) -> list[tuple]:
    """(block, query, bars, subject, block_score): both gapped sequences, spelled once from start to end and cut."""
    # the symbols that each operation uses, as places in the sequences
    o = np.frombuffer(ops.encode(), np.uint8)
    on_a, on_b = o != ord("H"), o != ord("V")
    out = []
    value = np.where(o == ord("M"), scores.match, np.where(o == ord("X"), scores.mismatch, -scores.gap_ext)).astype(np.int64)
    gap = ~(on_a & on_b)
    value -= scores.gap_open * (gap & (np.append(0, o[:-1]) != o))
    i, j = start_i - 1, start_j - 1
    for k in range(0, len(o), width):
        part = slice(k, k + width)
        row = []
        for used, text, at in ((on_a[part], a, i), (on_b[part], b, j)):
            symbols = iter(text[at : at + int(used.sum())])
            row.append("".join(next(symbols) if u else "-" for u in used.tolist()))
        i, j = i + int(on_a[part].sum()), j + int(on_b[part].sum())
        out.append((k // width, row[0], "".join("|" if x == "M" else " " for x in ops[part]), row[1], int(value[part].sum())))
    return out


def lines(paths: DataFrame, *keys: str, width: int = 60, scores: Scores = Scores()) -> DataFrame:
    """(keys, block, query, bars, subject, block_score, total_score) of paths that still carry a and b.

    One pass over each path cuts it into blocks of width columns; totals are a running sum. The last total must
    equal the path's score, or the query fails.
    """

    def run(batches):
        for batch in batches:
            out, at = [], []
            for k, r in enumerate(batch.select(["a", "b", "start_i", "start_j", "ops"]).to_pylist()):
                got = spelled(r["a"], r["b"], r["start_i"], r["start_j"], r["ops"], width, scores)
                out += got
                at += [k] * len(got)
            rows = pa.array(at, pa.int64())
            kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(rows) for c in (*keys, "score")), *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))], [*keys, "score", *(c.split()[0] for c in _LINE.split(", "))])

    types = dict(paths.dtypes)
    rows = paths.where("end_i >= 0").select(*keys, "score", "a", "b", "start_i", "start_j", "ops")
    got = rows.mapInArrow(run, "".join(f"`{k}` {types[k]}, " for k in keys) + "score long, " + _LINE)
    w = Window.partitionBy(*keys)
    got = got.withColumns({"total_score": F.sum("block_score").over(w.orderBy("block")), "_last": F.col("block") == F.max("block").over(w)})
    right = ~F.col("_last") | (F.col("total_score") == F.col("score"))
    got = got.withColumn("total_score", F.when(right, F.col("total_score")).otherwise(F.raise_error(F.lit("report and score differ"))))
    return got.select(*keys, "block", "query", "bars", "subject", "block_score", "total_score")


def _text(paths: DataFrame, *keys: str) -> DataFrame:
    body = F.concat_ws("\n", "query", "bars", "subject")
    rows = F.array_sort(F.collect_list(F.struct("block", body.alias("t"))))
    return lines(paths, *keys).groupBy(*keys).agg(F.array_join(F.transform(rows, lambda x: x["t"]), "\n\n").alias("value"))


def _summary(paths: DataFrame, *keys: str) -> DataFrame:
    got = with_stats(paths)
    part = lambda name, *cols: F.concat(F.lit(f"{name}: "), F.concat_ws(" ", *[F.col(c).cast("string") for c in cols]))
    body = F.concat_ws("\n", part("score", "score"), part("sequence 0", "start_i", "end_i"), part("sequence 1", "start_j", "end_j"), part("matches, mismatches", "matches", "mismatches"), part("gaps opened, extended", "gap_openings", "gap_extensions"))
    return got.select(*keys, F.when(F.col("end_i") >= 0, body).otherwise("no alignment").alias("value"))


def _steps(paths: DataFrame, *keys: str) -> DataFrame:
    runs = F.regexp_extract_all("ops", F.lit("(M+|X+|V+|H+)"), F.lit(1))
    return paths.select(*keys, F.array_join(F.transform(runs, lambda x: F.concat(F.char_length(x).cast("string"), F.left(x, F.lit(1)))), "").alias("value"))


#: The ways to render paths: name, what it is, and a function of (paths, *keys) that gives (keys, value).
FORMATS = {
    "text": ("blocks of both sequences and what they have in common", _text),
    "summary": ("score, ends and counts", _summary),
    "steps": ("run lengths of the operations", _steps),
}


def render(paths: DataFrame, form: str, *keys: str) -> DataFrame:
    """(keys, value): each path as text in one of FORMATS; "text" needs a and b and has no row for an empty path."""
    if form not in FORMATS:
        raise ValueError(f"formats are {', '.join(FORMATS)}")
    return FORMATS[form][1](paths, *keys)


def block_scores(pairs: DataFrame, height: int, width: int, edges: Edges = Edges(), scores: Scores = Scores()) -> DataFrame:
    """(keys, n, m, by, bx, i0, j0, i1, j1, score, i, j): the best cell of each block of every pair."""
    keys = [c for c in pairs.columns if c not in ("a", "b")]

    def run(batches):
        from helixweave.functions.scoring import INF, border

        for batch in batches:
            out = []
            names = batch.schema.names
            for r in batch.to_pylist():
                a, b = K.codes(r["a"] or ""), K.codes(r["b"] or "")
                n, m = len(a), len(b)
                top = border("zeroes" if edges.free_row else "gaps", m, scores).astype(np.int32)
                low = np.full(m + 1, -INF, np.int32)
                side = border("zeroes" if edges.free_column else "gaps", n, scores)
                for i in range(0, n, height):
                    i2 = min(n, i + height)
                    lh, le = side[i : i2 + 1], np.full(i2 - i + 1, -INF, np.int32)
                    new_h, new_f = top.copy(), low.copy()
                    for j in range(0, m, width):
                        j2 = min(m, j + width)
                        h, f, lh, le, (s, bi, bj) = K.block(a[i:i2], b[j:j2], top[j : j2 + 1], low[j : j2 + 1], lh, le, edges.local, scores)
                        new_h[j + (j > 0) : j2 + 1], new_f[j + 1 : j2 + 1] = h[(j > 0) :], f[1:]
                        out.append([*(r[k] for k in names if k not in ("a", "b")), n, m, i // height, j // width, i, j, i2, j2, s, i + bi, j + bj])
                    top, low = new_h, new_f
            if out:
                fields = [f for f in batch.schema if f.name not in ("a", "b")]
                types = [f.type for f in fields] + [pa.int64()] * 11
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [f.name for f in fields] + ["n", "m", "by", "bx", "i0", "j0", "i1", "j1", "score", "i", "j"])

    types = dict(pairs.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + [f"{c} long" for c in ("n", "m", "by", "bx", "i0", "j0", "i1", "j1", "score", "i", "j")])
    return pairs.mapInArrow(run, schema)
