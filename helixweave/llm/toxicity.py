"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text (each counted once): its words, pairs and triples of neighbours, and pairs with
one or two words between, hashed to BUCKETS. Words are runs of letters and digits, A-Z folded.
Executors hash the features of at most MAX_TRAIN labelled documents; one task walks through them, an
epoch after the other in the order of a hash, by FTRL-proximal (a learning rate for each coordinate,
L1 for sparsity). The driver sees only the weights that are not 0 and broadcasts them; their table has
a fixed size. Scoring reads every whole text once and moves nothing.

Edge cases: null and empty texts score the bias alone; texts of any length are read whole, step by step;
labels that are null take no part, a document with several labels counts as toxic if any says so; rows
that repeat a doc_id are each scored, and each learned from; without a usable label (or with empty
tables) all scores are 0; kept columns may have any name, also ``text`` or ``k0``.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import NON_ALNUM, U64, Words, binary, mix, raw, small_batches, steps

BUCKETS = 1 << 20
#: Bytes of text of a step, about.
STEP = 500_000
#: Labelled documents that training reads at most; they are taken in the order of a hash of their id.
MAX_TRAIN = 8000
EPOCHS, ALPHA, BETA, L1, L2 = 2, 1.0, 1.0, 12.0, 1.0
#: What an error on a toxic document counts, against 1 on another: few are toxic. (These values were chosen
#: with one fold of the training documents held back.)
TOXIC = 4.0
_BIAS = 0


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every feature occurrence in a batch of texts."""
    w = Words(buf, off, gap=NON_ALNUM)
    h, row = w.hash, w.owner()
    rows, ids = [row], [h]
    for gap, salt in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9), (3, 0x27D4EB2F165667C5)):
        same = row[gap:] == row[:-gap]
        rows.append(row[:-gap][same])
        ids.append(mix(h[:-gap] * U64(salt) + h[gap:])[same])
    same = row[2:] == row[:-2]
    rows.append(row[:-2][same])
    ids.append(mix(h[:-2] * U64(0x9E3779B97F4A7C15) + h[1:-1] * U64(0xD6E8FEB86659FD93) + h[2:])[same])
    return np.concatenate(rows), (np.concatenate(ids) >> U64(44)).astype(np.int64) % (BUCKETS - 1) + 1


def _examples(batches):
    for whole in batches:
        for batch in steps(whole, "text", STEP):
            row, idx = features(*raw(batch.column("text")))
            # every text has the bias feature
            code = np.unique(np.concatenate([row * BUCKETS + idx, np.arange(batch.num_rows) * BUCKETS + _BIAS]))
            cut = np.searchsorted(code, np.arange(batch.num_rows + 1) * BUCKETS)
            idx = code % BUCKETS
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), binary([packed(idx[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)])], ["doc_id", "toxic", "idx"])


def packed(idx: np.ndarray) -> bytes:
    """Rising numbers as their differences, of two bytes each where these suffice; the first byte tells."""
    gaps = np.diff(idx, prepend=0)
    return b"\x02" + gaps.astype(np.uint16).tobytes() if gaps.max(initial=0) < 65536 else b"\x04" + gaps.astype(np.uint32).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data[1:], np.uint16 if data[0] == 2 else np.uint32), dtype=np.int64)


def ftrl(examples: Iterable[tuple[int, np.ndarray]]) -> np.ndarray:
    """Weights after one walk of FTRL-proximal over (label, feature indexes)."""
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)

    def weights(i):
        zi, sparse = z[i], np.where(i == _BIAS, 0.0, L1)  # the bias is never held at 0
        return np.where(np.abs(zi) <= sparse, 0.0, -(zi - np.sign(zi) * sparse) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for y, idx in examples:
        w = weights(idx)
        g = (1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y) * (TOXIC if y else 1)
        old = n[idx]
        z[idx] += g - (np.sqrt(old + g * g) - np.sqrt(old)) / ALPHA * w
        n[idx] = old + g * g
    return weights(np.arange(BUCKETS)).astype(np.float32)


def _fit(batches):
    """The one training task: examples stream through it, what it holds has a fixed size."""
    seen = 0

    def walk():
        nonlocal seen
        for batch in batches:
            y = batch.column("toxic").to_pylist()
            for label, idx in zip(y, batch.column("idx"), strict=True):
                seen += 1
                yield label, unpacked(idx.as_py())

    w = ftrl(walk())
    if seen:
        at = np.flatnonzero(w).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([binary([at]), binary([w[at]])], ["idx", "weight"])


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, weights) other than 0, learned from at most MAX_TRAIN labelled ids for which ``learn`` holds."""
    small_batches(spark)
    known = labels.where(F.col("toxic").isNotNull() & learn).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # the ids are at most MAX_TRAIN, so their side of the join is of proven size
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    text = docs.where(learn).select("doc_id", F.col("text").cast("binary").alias("text"))
    rows = text.join(F.broadcast(known), "doc_id").select("doc_id", "toxic", "text").mapInArrow(_examples, "doc_id long, toxic int, idx binary")
    # each epoch has an order of its own, by a hash that no partitioning changes
    rows = rows.select(F.explode(F.sequence(F.lit(1), F.lit(EPOCHS))).alias("epoch"), "doc_id", "toxic", "idx")
    rows = rows.repartition(1).sortWithinPartitions("epoch", F.xxhash64("epoch", "doc_id"), "doc_id", F.xxhash64("idx"))
    got = rows.select("toxic", "idx").mapInArrow(_fit, "idx binary, weight binary").first()
    return got and (np.frombuffer(got[0], np.uint32), np.frombuffer(got[1], np.float32))


def _scorer(model):
    def run(batches):
        at, weight = model.value
        w = np.zeros(BUCKETS, np.float32)
        w[at] = weight
        for whole in batches:
            for batch in steps(whole, "text", STEP):
                row, idx = features(*raw(batch.column("text")))
                hit = np.flatnonzero(w[idx])
                code = np.unique(row[hit] * BUCKETS + idx[hit])
                total = np.bincount(code // BUCKETS, weights=w[code % BUCKETS], minlength=batch.num_rows) + w[_BIAS]
                score = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array(score)], [*batch.schema.names[:-1], "score"])

    return run


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, learn, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of docs, with score (0 to 1) and predicted (1 where score >= 0.5)."""
    w = train(spark, docs, labels, learn)
    shared = spark.sparkContext.broadcast(w or (np.array([_BIAS], np.uint32), np.array([-1e3], np.float32)))
    # the kept columns travel under names of their own, so none can clash with the text or the score
    own = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, own, strict=True)), F.col("text").cast("binary").alias("text"))
    got = rows.mapInArrow(_scorer(shared), T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())]))
    return got.select(*(F.col(k).alias(c) for c, k in zip(keep, own, strict=True)), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
