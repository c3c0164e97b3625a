"""Exact top-k inner-product search by a three-phase uniform threshold.

The lists of the threshold algorithm are vertical: the components of a vector are dealt into
``slices``, and a candidate's score is the sum of its local scores over the slices.

1. Each task gathers the k best totals it can see among the heads of its local score lists; the
   k-th best over all tasks is a lower bound of the answer's k-th score.
2. That cutoff is broadcast. A candidate that reaches it has a local score of at least
   cutoff / slices in some slice, so only such entries are collected; an entry whose known local
   scores plus cutoff / slices for each unknown one stay below the cutoff is dropped.
3. What remains is resolved to exact totals, and each task passes on its own k best.

Queries go round in blocks of fixed size, so what is broadcast (vectors and cutoffs of one block)
has a fixed bound; candidates are never moved. Where there are several blocks, the answers of each are
written before the next one's vectors are fetched.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do
rows without id; vectors of another length than the query's are no candidates; a repeated query id
is answered once, by its largest vector, and rows that share the query's id are never candidates;
equal scores are ordered by the smaller id; repeated candidate rows each count; vectors of any length
are used whole; an empty table of vectors or of queries gives an empty result. Further columns, of any
name, are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

#: Queries in one block; bounds the broadcast at QUERY_BLOCK * dimension * 8 bytes.
QUERY_BLOCK = 4096
CHUNK = 1024


def quantised(vectors: DataFrame, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v): integer components floor(scale * x), without vectors that take no part."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & (F.size("x") > 0) & fine).select("id", F.transform("x", lambda c: F.floor(c * F.lit(scale)).cast("long")).alias("v"))


def _matrices(batch: pa.RecordBatch, dim: int):
    """Ids and integer vectors of the rows with dim components."""
    v = batch.column("v")
    off = np.asarray(v.offsets)
    keep = np.flatnonzero(np.diff(off) == dim)
    flat = np.asarray(v.values.to_numpy(zero_copy_only=False)) if len(v.values) else np.empty(0, np.int64)
    ids = batch.column("id").to_numpy(zero_copy_only=False)[keep]
    x = flat[(off[keep][:, None] + np.arange(dim)).ravel()].reshape(len(keep), dim) if len(keep) else np.empty((0, dim), np.int64)
    return ids, x


def _product(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """x @ q.T, exact: in the narrowest type that holds every partial sum."""
    top = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(x.shape[1], 1)
    kind = np.float32 if top < 2**24 else np.float64 if top < 2**53 else np.int64
    return (x.astype(kind) @ q.astype(kind).T).T


def _keep_best(state: tuple[np.ndarray, np.ndarray], score: np.ndarray, ids: np.ndarray, k: int):
    """The k best (score desc, id asc) of each row; absent entries have the lowest score."""
    s, i = np.concatenate([state[0], score], 1), np.concatenate([state[1], ids], 1)
    order = np.lexsort((i, -s), axis=1)[:, :k]
    return np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)


_LOW = np.iinfo(np.int64).min + 1


def _scan(dim: int, slices: int, k: int, block, cutoffs=None):
    """Tasks of phase 1 (no cutoffs) or of phases 2 and 3."""
    cuts = np.linspace(0, dim, min(slices, dim) + 1).astype(int)

    def run(batches):
        qid, q = block.value
        q = q.astype(np.int64)
        best = np.full((len(qid), 0), _LOW), np.full((len(qid), 0), -1)
        tau = None if cutoffs is None else cutoffs.value
        for batch in batches:
            ids, x = _matrices(batch, dim)
            for at in range(0, len(ids), CHUNK):
                some, rows = ids[at : at + CHUNK], x[at : at + CHUNK]
                local = [_product(rows[:, a:b], q[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                if tau is None:
                    # phase 1: heads of the local lists, by their exact totals
                    heads = [np.argpartition(-s, min(k, len(some) - 1), axis=1)[:, : k + 1] for s in local]
                    pick = np.sort(np.concatenate(heads, 1), axis=1)
                    fresh = np.ones(pick.shape, bool)
                    fresh[:, 1:] = pick[:, 1:] != pick[:, :-1]
                    total = sum(np.take_along_axis(s, pick, 1).astype(np.int64) for s in local)
                    total[~fresh | (some[pick] == qid[:, None])] = _LOW
                    best = _keep_best(best, total, some[pick], k)
                    continue
                # phase 2: entries of the local lists that reach cutoff / slices
                floor_ = (tau / len(local))[:, None]
                bound, seen = np.zeros(local[0].shape), np.zeros(local[0].shape, bool)
                for s in local:
                    hit = s >= floor_
                    seen |= hit
                    bound += np.where(hit, s, floor_)
                # rounding of the bound must never drop an entry; exact totals decide below
                r, c = np.nonzero(seen & (bound >= tau[:, None] - 1.0 - np.abs(tau[:, None]) * 1e-9))
                # phase 3: exact totals of what remains
                total = sum(s[r, c].astype(np.int64) for s in local)
                fine = (total >= tau[r]) & (some[c] != qid[r])
                r, c, total = r[fine], c[fine], total[fine]
                if len(r):
                    order = np.lexsort((some[c], -total, r))
                    r, c, total = r[order], c[order], total[order]
                    rank = np.arange(len(r)) - np.searchsorted(r, r)
                    top = rank < k
                    s, i = np.full((len(qid), k), _LOW), np.full((len(qid), k), -1)
                    s[r[top], rank[top]], i[r[top], rank[top]] = total[top], some[c[top]]
                    best = _keep_best(best, s, i, k)
        r, c = np.nonzero(best[0] > _LOW)
        yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(best[1][r, c].astype(np.int64)), pa.array(best[0][r, c].astype(np.int64))], ["query_id", "vec_id", "score"])

    return run


def _first_k(df: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exact_topk(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 20, slices: int = 4) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of ``vectors`` (id, v) for each of ``queries`` (id, v)."""
    out = "query_id long, vec_id long, score long"
    queries = queries.groupBy("id").agg(F.max("v").alias("v")).withColumn("dim", F.size("v"))
    found = []
    kinds = sorted(tuple(r) for r in queries.groupBy("dim").count().collect())
    several = len(kinds) > 1 or sum(n for _, n in kinds) > QUERY_BLOCK
    for dim, n in kinds:
        of_dim = queries.where(F.col("dim") == dim)
        blocks = -(-n // QUERY_BLOCK)
        for b in range(blocks):
            # blocks by the id's hash; a block is cut again if the hash left it too large
            rows = of_dim.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "v").collect()
            for at in range(0, len(rows), QUERY_BLOCK):
                part = rows[at : at + QUERY_BLOCK]
                qid, q = np.array([r[0] for r in part], np.int64), np.array([r[1] for r in part], np.int64).reshape(len(part), dim)
                q = q.astype(np.int16) if np.abs(q).max(initial=0) < 2**15 else q
                block = spark.sparkContext.broadcast((qid, q))
                lists = vectors.mapInArrow(_scan(dim, slices, k, block), out)
                tau = {r[0]: r[1] for r in _first_k(lists, k).groupBy("query_id").agg(F.min("score"), F.count("*").alias("n")).where(F.col("n") == k).select("query_id", "min(score)").collect()}
                # fewer than k candidates in sight: no cutoff, everything is resolved
                cutoff = spark.sparkContext.broadcast(np.array([tau.get(i, -(2**62)) for i in qid.tolist()], np.int64))
                best = vectors.mapInArrow(_scan(dim, slices, k, block, cutoff), out)
                if several:
                    best = cut(_first_k(best, k).select("query_id", "vec_id", "score"), spark)
                    block.destroy()
                    cutoff.destroy()
                found.append(best)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return _first_k(reduce(DataFrame.union, found), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
