"""Vector code compression: product codes by partial-distance search.

A vector of whole numbers floor(scale * x) is cut into ``parts`` equal parts. Each part position has a codebook of
``entries`` entries, which starts as that part of the vectors with the smallest ids, ascending. In each round every
part goes to its nearest entry (squared Euclidean distance, ties to the lower index), and an entry becomes the
floor of its parts' mean; entries without parts stay. At last all parts are assigned again.

The search is partial: components are processed in descending variance over the codebook. After the first one
the entry that is nearest so far gets its complete distance, which is the best so far; then, component by
component, masks drop every (part, entry) pair whose sum already strictly exceeds the best complete distance of
its part. Pairs that may still tie stay, so the result is that of a full search.

Each task passes on sums and counts of its entries alone; the driver holds the codebooks, whose size is set by
parameters and the vectors' length, not by their number. Vectors are read once a round and never moved.

Edge cases: vectors that are null, empty, or hold null or non-finite components take no part; nor do vectors of
another length than the one with the smallest id, or with components beyond what whole distances of a vector of
that length hold in 64 bits (2**27 for 64 components). A length that ``parts`` does not divide is filled
up with zeros. Rows without vec_id are coded but start no entry; rows that repeat an id start one entry (the
smallest vector) and are coded each; fewer ids than entries give smaller codebooks. Null labels are one label. An
empty table gives an empty result. Further columns, of any name, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

SCALE, PARTS, ENTRIES, ROUNDS = 256.0, 16, 64, 2
#: Rows that one vectorised step searches: with 64 entries, 262,144 pairs of a part and an entry.
STEP_ROWS = 4096


def whole(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """(vec_id, label, v): components floor(scale * x) of the vectors that take part, whatever their length."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    got = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", x.alias("x")).where(fine & (F.size("x") > 0))
    # so many squares of twice as much stay below 2**63
    top = F.pow(F.lit(2.0), F.floor((F.lit(60) - F.ceil(F.log2(F.size("x")))) / 2))
    got = got.where(F.forall("x", lambda c: F.abs(c * F.lit(scale)) <= top))
    return got.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * F.lit(scale)).cast("long")).alias("v"))


def _matrix(batch: pa.RecordBatch, dim: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with dim components, and their components (rows, parts, width)."""
    v = batch.column("v")
    off = np.asarray(v.offsets)
    rows = np.flatnonzero(np.diff(off) == dim)
    width = -(-dim // parts)
    out = np.zeros((len(rows), parts * width), np.int64)
    if len(rows):
        flat = v.values.to_numpy(zero_copy_only=False)
        out[:, :dim] = flat[off[rows][:, None] + np.arange(dim)]
    return rows, out.reshape(len(rows), parts, width)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of book (entries, width) to each row of x, ties to the lower index."""
    n, k = len(x), len(book)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # the variance only orders the work
    order = np.argsort(-book.astype(float).var(axis=0), kind="stable")
    total = np.square(x[:, order[0], None] - book[None, :, order[0]])
    guess = total.argmin(1)
    best = np.square(x - book[guess]).sum(1)
    row, entry = np.nonzero(total <= best[:, None])
    sums = total[row, entry]
    for d in order[1:]:
        sums = sums + np.square(x[row, d] - book[entry, d])
        alive = sums <= best[row]
        row, entry, sums = row[alive], entry[alive], sums[alive]
    # pairs come by row and entry: the first of the smallest sums has the lowest index
    first = np.flatnonzero(np.diff(row, prepend=-1))
    least = np.minimum.reduceat(sums, first)
    hit = np.flatnonzero(sums == least[row])
    hit = hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]
    return entry[hit], least


def _coded(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows, parts) and total errors (rows)."""
    codes, error = np.empty(x.shape[:2], np.int64), np.zeros(len(x), np.int64)
    for p in range(x.shape[1]):
        for a in range(0, len(x), STEP_ROWS):
            codes[a : a + STEP_ROWS, p], d = nearest(x[a : a + STEP_ROWS, p], books[p])
            error[a : a + STEP_ROWS] += d
    return codes, error


def _sums(dim: int, books: np.ndarray):
    """Sums and counts of each entry's parts over a whole task."""
    parts, entries, width = books.shape

    def run(batches):
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            _, x = _matrix(batch, dim, parts)
            codes, _ = _coded(x, books)
            slot = (codes + np.arange(parts) * entries).ravel()
            np.add.at(total, slot, x.reshape(-1, width))
            count += np.bincount(slot, minlength=len(count))
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(total[used].tolist(), pa.list_(pa.int64()))], ["slot", "n", "total"])

    return run


def _first_entries(vectors: DataFrame, entries: int):
    """The vectors of the smallest ids, one for each id; every task passes on at most ``entries``."""

    def run(batches):
        kept: dict[int, list] = {}
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            last = sorted(kept)[entries - 1] if len(kept) >= entries else None
            few = np.unique(ids if last is None else ids[ids <= last])[:entries]
            for k in np.flatnonzero(np.isin(ids, few)).tolist():
                v = batch.column("v")[k].as_py()
                kept[int(ids[k])] = min(kept.get(int(ids[k]), v), v)
            kept = {i: kept[i] for i in sorted(kept)[:entries]}
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int64()), pa.array(list(kept.values()), pa.list_(pa.int64()))], ["vec_id", "v"])

    heads = vectors.where("vec_id is not null").select("vec_id", "v").mapInArrow(run, "vec_id long, v array<long>")
    return heads


def codebooks(spark: SparkSession, vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[int, np.ndarray]:
    """(length of the vectors, codebooks (parts, entries, width)) of vectors (vec_id, v)."""
    least = vectors.where("vec_id is not null").agg(F.min(F.struct("vec_id", "v"))).first()[0]
    if least is None:
        return 0, np.empty((parts, 0, 0), np.int64)
    dim = len(least[1])
    same = vectors.where(F.size("v") == dim)
    heads = _first_entries(same, entries).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").limit(entries).collect()
    width = -(-dim // parts)
    start = np.zeros((len(heads), parts * width), np.int64)
    start[:, :dim] = [r[1] for r in heads]
    books = np.ascontiguousarray(start.reshape(len(heads), parts, width).transpose(1, 0, 2))
    for _ in range(rounds):
        sums = same.select("v").mapInArrow(_sums(dim, books), "slot int, n long, total array<long>")
        # entries times parts rows, whatever the number of vectors; sums are decimals, which cannot overflow
        each = sums.select("slot", "n", F.posexplode("total").alias("place", "x")).groupBy("slot", "place").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
        books = books.copy()
        for slot, place, n, x in each.collect():
            books[slot // books.shape[1], slot % books.shape[1], place] = int(x) // n
    return dim, books


def books_sha256(books: np.ndarray) -> str:
    """Of all components as decimal numbers, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def _encode(dim: int, books: np.ndarray):
    digits = np.array([f"{k:02x}" for k in range(max(books.shape[1], 1))], "S")

    def run(batches):
        for batch in batches:
            rows, x = _matrix(batch, dim, books.shape[0])
            codes, error = _coded(x, books)
            text = [b"".join(c).decode() for c in digits[codes].tolist()]
            kept = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept.column("vec_id"), kept.column("label"), pa.array(text, pa.string()), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def compress(spark: SparkSession, vectors: DataFrame, scale: float = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, label, code, error, label_error), codebooks): codes as hex digits, two for each part (at most 256 entries)."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's index has two hex digits")
    v = whole(vectors, scale)
    kind = dict(v.dtypes)["label"]
    dim, books = codebooks(spark, v, parts, entries, rounds)
    if not dim:
        none = v.where(F.lit(False))
        return none.select("vec_id", "label", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")]), books
    coded = cut(v.where(F.size("v") == dim).mapInArrow(_encode(dim, books), f"vec_id long, label {kind}, code string, error long"), spark)
    each = coded.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    # beyond 64 bits: null
    each = each.select(F.col("label").alias("_label"), F.expr("try_cast(total as bigint)").alias("label_error"))
    got = coded.join(each, F.col("label").eqNullSafe(F.col("_label")))
    return got.select("vec_id", "label", "code", "error", "label_error"), books
