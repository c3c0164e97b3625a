"""Shared pieces of the corpus operators: table access, reliable cuts of lineage, vectorised
tokenising of Arrow text batches, packed shuffles and connected components.

The Arrow helpers work on the raw byte buffer of a whole batch, so no Python loop runs per word.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixweave.sources.session import workers_find_package

U64 = np.uint64
#: Bytes of text that one vectorised step handles at most (one text larger than this is a step of its own).
STEP_BYTES = 2_000_000


#: Bytes of an Arrow batch on its way to Python, where the session keeps Spark's default of 64 MB.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Python workers and the JVM beside them hold a batch of texts at a time: it need not be large."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in ("67108864b", "64MB", "64m"):
        spark.conf.set(key, f"{BATCH_BYTES}b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return workers_find_package(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of input files for each partition of a packed shuffle, at most.
PART_BYTES = 64 << 20


def n_parts(spark: SparkSession, df: DataFrame | None = None) -> int:
    """Partitions of packed shuffles: the session's setting, and more where df's files hold more than PART_BYTES each."""
    small_batches(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    if df is not None:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if size < 1 << 55:  # beyond: Spark does not know the size
            parts = max(parts, -(-size // PART_BYTES))
    return parts


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. In local mode (tests), where none is named, a temporary one is set."""
    d = spark.conf.get("spark.checkpoint.dir", None) or getattr(shared_dir, "own", None)
    if not d:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="checkpoints-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        d = shared_dir.own = "file://" + own
    return d.rstrip("/")


def cut(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Write df to the shared folder and read it back: later reads survive the loss of any executor."""
    small_batches(spark)
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id", mod: int = 5, rest: int = 0):
    """True for rows that must not be learned from; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest, F.lit(True))


# ---------------------------------------------------------------- Arrow text batches


def _classes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gap = np.zeros(256, bool)
    gap[[0x20, *range(0x09, 0x0E)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    symbol = gap.copy()
    for b in range(128):
        symbol[b] |= not chr(b).isalnum()
    return gap, lower, symbol


SPACE, LOWER, NON_ALNUM = _classes()
IDENTITY = np.arange(256, dtype=np.uint8)
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_R = U64(0x9E3779B97F4A7C15)
_RI = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def powers(base: U64, n: int, key: str) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept between calls."""
    got = _powers.get(key)
    if got is None or len(got) < n + 1:
        a = np.full(max(n + 1, 1 << 16), base, U64)
        a[0] = 1
        got = np.cumprod(a, dtype=U64)
        if n < 8 * STEP_BYTES:
            _powers[key] = got
    return got


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every bit of h over all 64 (in place)."""
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xA0761D6478BD642F)
    h ^= h >> U64(32)
    return h


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a binary array (null: empty), offsets from 0."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = pc.fill_null(arr, b"")
    wide = pa.types.is_large_binary(arr.type) or pa.types.is_large_string(arr.type)
    off = np.frombuffer(arr.buffers()[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = arr.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes of text each, so that memory stays bounded."""
    if not batch.num_rows:
        return
    _, off = raw(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words of a batch of texts: 64-bit hashes, byte spans, and for each text the range of its words."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, gap: np.ndarray = SPACE, fold: np.ndarray = LOWER):
        n = len(buf)
        self.buf, self.off = buf, off
        if not n:
            self.start = self.end = np.empty(0, np.int64)
            self.hash, self.at = np.empty(0, U64), np.zeros(len(off), np.int64)
            return
        solid = ~gap[buf]
        before, after = np.empty(n, bool), np.empty(n, bool)
        before[0] = after[-1] = True
        np.logical_not(solid[:-1], out=before[1:])
        np.logical_not(solid[1:], out=after[:-1])
        before[off[:-1][off[:-1] < n]] = True
        after[off[1:][off[1:] > 0] - 1] = True
        self.start = np.flatnonzero(solid & before)
        self.end = np.flatnonzero(solid & after) + 1
        sums = np.zeros(n + 1, U64)
        value = np.where(gap, U64(0), _BYTE[fold])[buf]
        value *= powers(_R, n, "r")[:n]
        np.cumsum(value, out=sums[1:])
        h = sums[self.end] - sums[self.start]
        h *= powers(_RI, n, "ri")[self.start]
        self.hash = mix(h)
        self.at = np.searchsorted(self.start, off)

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))

    def runs(self, k: int) -> np.ndarray:
        """Indexes of the words that begin k consecutive words of one text."""
        n = len(self.hash)
        ok = np.zeros(n, bool)
        if n >= k:
            ok[: n - k + 1] = True
            last = self.at[1:]
            for back in range(1, k):
                i = last - back
                ok[i[(i >= self.at[:-1])]] = False
        return np.flatnonzero(ok)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hashes modulo 2**64 of all k-windows of h, by one cumulative sum."""
    n = len(h)
    if n < k:
        return np.empty(0, U64)
    p = np.zeros(n + 1, U64)
    np.cumsum(h * powers(_R, n, "r")[:n], out=p[1:])
    return mix((p[k:] - p[:-k]) * powers(_RI, n, "ri")[: n - k + 1])


def binary(items: Iterable) -> pa.Array:
    return pa.array([None if x is None else (x if isinstance(x, bytes) else x.tobytes()) for x in items], pa.binary())


def lookup(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Position of each key in sorted_keys, -1 where absent."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    i = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[i] == keys, i, -1)


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of the component of each of n nodes under the edges a-b."""
    lab = np.arange(n)
    if not len(a):
        return lab
    while True:
        low = np.minimum(lab[a], lab[b])
        new = lab.copy()
        np.minimum.at(new, lab[a], low)
        np.minimum.at(new, lab[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == lab).all():
            return lab
        lab = new


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """(node, component) with the smallest node of each component, for edges (a, b).

    Alternating large-star and small-star rounds; each round is two aggregations with map-side
    combine, and every round is written to the shared folder. Nothing is collected but two sums.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e, mark = cut(e, spark), None
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a")
        e = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        e = cut(e, spark)
        now = tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if now == mark:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
        mark = now
