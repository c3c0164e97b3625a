"""Language identification by a bidirectional gated recurrent network over bytes.

A text is read in windows of WINDOW bytes, forwards and backwards. At every byte the two states give
a distribution over the learned languages; a document's distribution is the mean over all its bytes.
The network is trained in numpy by backpropagation through time (Adam, cross-entropy at every
position) on random windows of at most PER_LANG documents of each language, drawn by a hash of the
id. Scoring reads whole texts and moves nothing; what is broadcast are a few thousand weights.

Edge cases: a text that is null or has no letter gets ``und`` with score 0; if nothing can be learned
(also from an empty table) every text does; ties go to the language first in order; texts of any length
are read whole; rows that repeat are labelled each; kept columns may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import raw, steps

HIDDEN, WINDOW, BATCH = 8, 96, 1024
#: Training documents of each language; all languages are learned.
PER_LANG = 400
ROUNDS, TRAIN_WINDOW, TRAIN_BATCH, RATE = 350, 48, 128, 0.02


def _squash(x, tmp):
    """x / (1 + |x|) in place: the network's bounded activation, several times cheaper than tanh."""
    np.abs(x, out=tmp)
    tmp += np.float32(1)
    x /= tmp
    return x


def _gate(x, tmp):
    """The activation moved to 0..1, in place."""
    _squash(x, tmp)
    x *= np.float32(0.5)
    x += np.float32(0.5)
    return x


def _slope(y):
    """Derivative of the activation from its value."""
    return (1 - np.abs(y)) ** 2


def new_weights(classes: int, hidden: int = HIDDEN, seed: int = 3) -> dict[str, np.ndarray]:
    """inp: byte to gates, for both directions; rec: state to gates; out, bias: states to languages."""
    rng = np.random.default_rng(seed)
    f = lambda s, *shape: (rng.standard_normal(shape) * s).astype(np.float32)
    return {"inp": f(0.5, 2, 256, 3 * hidden), "rec": f(hidden**-0.5, 2, 3 * hidden, hidden), "out": f(0.3, classes, 2 * hidden), "bias": np.zeros((classes, 1), np.float32)}


def forward(w: dict, x: np.ndarray, keep: bool = False):
    """States of both directions, (T, 2, H, B); x: bytes (T, B). The second direction reads backwards."""
    t, b = x.shape
    h = w["rec"].shape[2]
    inp = np.ascontiguousarray(w["inp"].transpose(0, 2, 1))
    both = np.stack([x, x[::-1]], 1)
    state, saved = np.zeros((2, h, b), np.float32), []
    states = np.empty((t, 2, h, b), np.float32)
    g = np.empty((2, 3 * h, b), np.float32)
    tmp = np.empty((2, 2 * h, b), np.float32)
    for i in range(t):
        for d in (0, 1):
            np.take(inp[d], both[i, d], axis=1, out=g[d], mode="clip")
        u = np.matmul(w["rec"], state)
        g[:, : 2 * h] += u[:, : 2 * h]
        rz = _gate(g[:, : 2 * h], tmp)
        n = rz[:, :h] * u[:, 2 * h :]
        n += g[:, 2 * h :]
        _squash(n, tmp[:, :h])
        old = state
        state = old - n
        state *= rz[:, h:]
        state += n
        states[i, 0], states[t - 1 - i, 1] = state[0], state[1]
        if keep:
            saved.append((old, rz.copy(), n, u[:, 2 * h :]))
    return states, (both, saved)


def probabilities(w: dict, states: np.ndarray) -> np.ndarray:
    """(classes, T, B) distribution at every position."""
    t, _, h, b = states.shape
    z = np.matmul(w["out"], states.reshape(t, 2 * h, b)) + w["bias"]
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z.transpose(1, 0, 2)


def gradients(w: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean loss over all positions and its gradients, by backpropagation through time."""
    states, (both, saved) = forward(w, x, keep=True)
    t, _, h, b = states.shape
    p = probabilities(w, states)
    loss = -float(np.log(p[y, :, np.arange(b)] + 1e-9).mean())
    dz = p.copy()
    dz[y, :, np.arange(b)] -= 1
    dz /= t * b
    dz = np.ascontiguousarray(dz.transpose(1, 0, 2))
    flat = states.reshape(t, 2 * h, b)
    grad = {"out": np.einsum("tcb,thb->ch", dz, flat), "bias": dz.sum((0, 2))[:, None], "rec": np.zeros_like(w["rec"]), "inp": np.zeros_like(w["inp"])}
    ds = np.matmul(w["out"].T, dz).reshape(t, 2, h, b)
    back = np.zeros((2, h, b), np.float32)
    rec_t = w["rec"].transpose(0, 2, 1)
    for i in range(t - 1, -1, -1):
        old, rz, n, un = saved[i]
        r, z = rz[:, :h], rz[:, h:]
        dh = back + np.stack([ds[i, 0], ds[t - 1 - i, 1]])
        dn = dh * (1 - z) * _slope(n)
        dzt = dh * (old - n) * 0.5 * _slope(2 * z - 1)
        dr = dn * un * 0.5 * _slope(2 * r - 1)
        du = np.concatenate([dr, dzt, dn * r], 1)
        grad["rec"] += np.matmul(du, old.transpose(0, 2, 1))
        back = dh * z + np.matmul(rec_t, du)
        da = np.concatenate([dr, dzt, dn], 1)
        for d in (0, 1):
            np.add.at(grad["inp"][d], both[i, d], da[d].T)
    return loss, grad


def fit(texts: list[list[bytes]], rounds: int = ROUNDS, seed: int = 5) -> dict[str, np.ndarray]:
    """Weights from the texts of each language."""
    rng = np.random.default_rng(seed)
    w = new_weights(len(texts))
    m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        y = rng.integers(0, len(texts), TRAIN_BATCH)
        x = np.full((TRAIN_BATCH, TRAIN_WINDOW), 32, np.uint8)
        for i, c in enumerate(y):
            t = texts[c][rng.integers(len(texts[c]))]
            a = int(rng.integers(max(1, len(t) - TRAIN_WINDOW + 1)))
            piece = np.frombuffer(t[a : a + TRAIN_WINDOW], np.uint8)
            x[i, : len(piece)] = piece
        _, grad = gradients(w, np.ascontiguousarray(x.T), y)
        rate = RATE * min(1, 2 * (1 - step / (rounds + 1)))
        for k, g in grad.items():
            np.clip(g, -1, 1, out=g)
            m[k] += 0.1 * (g - m[k])
            v[k] += 0.01 * (g * g - v[k])
            w[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def train(docs: DataFrame, learn) -> tuple[list[str], dict | None]:
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    count = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(count)
    if not langs:
        return [], None
    share = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, PER_LANG / count[k]))])
    drawn = rows.where((F.xxhash64("doc_id").bitwiseAND(F.lit(2**31 - 1)) / F.lit(2.0**31)) < share[F.col("lang")])
    # the draw is of about PER_LANG a language; the limit holds if hashes are uneven
    drawn = drawn.orderBy(F.xxhash64("doc_id", "lang"), "doc_id", "lang", F.xxhash64("text")).limit(2 * PER_LANG * len(langs))
    got = drawn.select("lang", "doc_id", F.col("text").cast("binary").alias("text")).toArrow().to_pylist()
    got.sort(key=lambda r: (r["lang"], r["doc_id"], r["text"]))
    texts = [[r["text"] for r in got if r["lang"] == k and r["text"]] for k in langs]
    langs, texts = [k for k, t in zip(langs, texts, strict=True) if t], [t for t in texts if t]
    return (langs, fit(texts)) if len(langs) > 1 else (langs, None)


def pooled(w: dict, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, classes) mean distribution over all bytes of each text."""
    size = np.diff(off)
    per = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), per)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    start = off[row] + nth * WINDOW
    # the last window of a text is moved back to lie inside it; what it repeats does not count
    moved = np.where((nth == per[row] - 1) & (per[row] > 1), off[row + 1] - WINDOW, start)
    skip, stop = start - moved, np.minimum(off[row + 1] - moved, WINDOW)
    padded = np.concatenate([buf, np.full(WINDOW, 32, np.uint8)])
    total = np.zeros((len(size), len(w["bias"])))
    for at in range(0, len(row), BATCH):
        s = slice(at, at + BATCH)
        x = padded[moved[s][:, None] + np.arange(WINDOW)]
        if (stop[s] < WINDOW).any():
            x = np.where(np.arange(WINDOW) < stop[s][:, None], x, np.uint8(32))
        p = probabilities(w, forward(w, np.ascontiguousarray(x.T))[0])
        i = np.arange(WINDOW)[:, None]
        mass = np.einsum("ctb,tb->bc", p, ((i >= skip[s]) & (i < stop[s])).astype(np.float32))
        np.add.at(total, row[s], mass)
    return total / np.maximum(size, 1)[:, None]


def _predict(model):
    def run(batches):
        langs, w = model.value
        for whole in batches:
            for batch in steps(whole, "text", 1_000_000):
                buf, off = raw(batch.column("text"))
                p = pooled(w, buf, off) if w is not None else np.ones((batch.num_rows, 1)) * (np.diff(off) > 0)[:, None]
                best = p.argmax(1)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(batch.num_columns - 1)), pa.array([langs[i] for i in best.tolist()], pa.string()), pa.array(np.clip(p.max(1), 0, 1))], [*batch.schema.names[:-1], "lang_pred", "score"])

    return run


def language_id(spark: SparkSession, docs: DataFrame, learn, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of docs with lang_pred and score (0 to 1)."""
    langs, w = train(docs, learn)
    shared = spark.sparkContext.broadcast((langs or ["und"], w))
    # the kept columns travel under names of their own
    own = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, own, strict=True)), F.col("text").rlike(r"\p{L}").alias("letters"), F.col("text").cast("binary").alias("text"))
    named = F.coalesce("letters", F.lit(False)) & F.lit(bool(langs))
    got = rows.mapInArrow(_predict(shared), T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    return got.select(*(F.col(k).alias(c) for c, k in zip(keep, own, strict=True)), F.when(named, F.col("lang_pred")).otherwise("und").alias("lang_pred"), F.when(named, F.col("score")).otherwise(0.0).alias("score"))
