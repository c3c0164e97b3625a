"""Exact substring dedup: remove words covered by token windows that start in an earlier document.

Every window of ``k`` consecutive words gets a Rabin-Karp hash (modulo 2**64 over mixed 64-bit word
hashes, from one cumulative sum per batch). A batch first settles windows it already holds in an
earlier document, then deals the rest by hash into packed blobs, one row for each batch and
partition, so a window's count and smallest document come together in one task with 8 bytes a
window. Flagged positions go back to their documents, merge into maximal intervals, and the words
outside them are kept. Texts are moved once, compressed.

Two different windows share a hash with probability about (windows / 2**64); nothing else is inexact.

Edge cases: null and empty texts have no words; rows without doc_id neither remove nor lose words;
rows that repeat a doc_id do not remove each other's words; texts shorter than k stay whole, texts of any
length are compared whole; an empty table gives an empty result. Further columns, of any name, are ignored.
"""

from __future__ import annotations

import zlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Words, binary, mix, n_parts, raw, rolling, steps

_SHIFT = U64(40)


def _dealt(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> _SHIFT) % U64(parts)).astype(np.int64)


def _text_keys(buf, off) -> np.ndarray:
    """A 64-bit hash of each whole text: with doc_id it names a row."""
    return np.array([zlib.crc32(buf[a:b]) | (zlib.adler32(buf[a:b]) << 32) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], U64).view(np.int64)


def _flags(parts: int, doc: np.ndarray, key: np.ndarray, row: np.ndarray, pos: np.ndarray):
    """Packed rows (part, kind 0, ...) that carry flagged window starts back to their documents."""
    if not len(row):
        return
    home = _home(doc, key, parts)
    to = home[row]
    order = np.lexsort((pos, row, to))
    to, row, pos = to[order], row[order], pos[order].astype(np.int64)
    cuts = np.flatnonzero(np.diff(to, prepend=-1))
    for a, b in zip(cuts, [*cuts[1:], len(to)], strict=True):
        r, first, n = np.unique(row[a:b], return_index=True, return_counts=True)
        gaps = np.diff(pos[a:b], prepend=0)
        gaps[first] = pos[a:b][first]
        yield int(to[a]), doc[r], key[r], n, gaps


def _home(doc: np.ndarray, key: np.ndarray, parts: int) -> np.ndarray:
    return _dealt(mix(doc.astype(np.int64).view(U64) * U64(0x9E3779B97F4A7C15) + key.view(U64)), parts)


def _windows(parts: int, k: int):
    """Map side of the count: packed windows by hash, and flags that the batch itself settles."""

    def run(batches):
        for whole in batches:
            for batch in steps(whole, "text"):
                buf, off = raw(batch.column("text"))
                doc = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
                w = Words(buf, off, fold=np.arange(256))
                key = _text_keys(buf, off)
                at = w.runs(k)
                h = rolling(w.hash, k)[at]
                row = np.searchsorted(w.at, at, "right") - 1
                # rows of one text without words share their start with the next text
                pos = at - w.at[row]
                order = np.lexsort((doc[row], h))
                hs, ds = h[order], doc[row][order]
                head = np.ones(len(hs), bool)
                head[1:] = hs[1:] != hs[:-1]
                first = ds[np.maximum.accumulate(np.where(head, np.arange(len(hs)), 0))]
                late = np.zeros(len(h), bool)
                late[order] = ds > first
                rows = {"part": [], "kind": [], "doc": [], "key": [], "n": [], "pos": [], "hash": []}

                def put(part, kind, d, t, n, p, x, rows=rows):
                    for c, v in zip(rows, (part, kind, d, t, n, p, x), strict=True):
                        rows[c].append(v)

                for part, d, t, n, gaps in _flags(parts, doc, key, row[late], pos[late]):
                    put(part, 0, d, t, n.astype(np.uint32), gaps.astype(np.uint32), b"")
                # the smallest document of each hash goes on, for every position it has there
                h, row, pos = h[~late], row[~late], pos[~late]
                to = _dealt(h, parts)
                order = np.argsort(to.astype(np.uint32), kind="stable")
                to, h, row, pos = to[order], h[order], row[order], pos[order]
                cuts = np.flatnonzero(np.diff(to, prepend=-1))
                for a, b in zip(cuts, [*cuts[1:], len(to)], strict=True):
                    r, at_, n = np.unique(row[a:b], return_index=True, return_counts=True)
                    gaps = np.diff(pos[a:b], prepend=0)
                    gaps[at_] = pos[a:b][at_]
                    put(int(to[a]), 1, doc[r], key[r], n.astype(np.uint32), gaps.astype(np.uint16 if gaps.max() < 65536 else np.uint32), h[a:b])
                if rows["part"]:
                    yield pa.RecordBatch.from_arrays([pa.array(rows["part"], pa.int32()), pa.array(rows["kind"], pa.int8()), *(binary(rows[c]) for c in ("doc", "key", "n", "pos", "hash"))], list(rows))

    return run


_PACK = "part int, kind tinyint, doc binary, key binary, n binary, pos binary, hash binary"


def _starts(gaps: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Absolute positions from the gaps of each row's list."""
    total = np.cumsum(gaps)
    ends = np.cumsum(n)
    before = np.concatenate([[0], total[ends[:-1] - 1]]) if len(n) else np.empty(0, np.int64)
    return total - np.repeat(before, n)


def _counted(parts: int):
    """Reduce side: all windows of one hash range; flags those that start in an earlier document."""

    def run(batches):
        docs, keys, rows, starts, hashes, base = [], [], [], [], [], 0
        for batch in batches:
            for kind, d, t, n, p, x, part in zip(*(batch.column(c).to_pylist() for c in ("kind", "doc", "key", "n", "pos", "hash", "part")), strict=True):
                if kind == 0:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([0], pa.int8()), *(pa.array([v], pa.binary()) for v in (d, t, n, p))], ["part", "kind", "doc", "key", "n", "pos"])
                    continue
                n = np.frombuffer(n, np.uint32).astype(np.int64)
                h = np.frombuffer(x, U64)
                gaps = np.frombuffer(p, np.uint16 if len(p) == 2 * len(h) else np.uint32).astype(np.int64)
                docs.append(np.frombuffer(d, np.int64))
                keys.append(np.frombuffer(t, np.int64))
                rows.append((np.repeat(np.arange(len(n)), n) + base).astype(np.int32))
                starts.append(_starts(gaps, n).astype(np.int32))
                hashes.append(h)
                base += len(n)
        if not docs:
            return
        doc, key, row, pos, h = (np.concatenate(x) for x in (docs, keys, rows, starts, hashes))
        del docs, keys, rows, starts, hashes
        order = np.argsort(h)
        h, d = h[order], doc[row[order]]
        cuts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        least = np.repeat(np.minimum.reduceat(d, cuts), np.diff(cuts, append=len(h)))
        order = order[d > least]
        del h, d, least
        for part, a, t, n, gaps in _flags(parts, doc, key, row[order], pos[order]):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([0], pa.int8()), *(binary([v]) for v in (a, t, n.astype(np.uint32), gaps.astype(np.uint32)))], ["part", "kind", "doc", "key", "n", "pos"])

    return run


def _texts(parts: int):
    """Texts, compressed, to the partition where their flags meet."""

    def run(batches):
        for whole in batches:
            for batch in steps(whole, "text"):
                buf, off = raw(batch.column("text"))
                doc = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                key = _text_keys(buf, off)
                none = batch.column("doc_id").is_null().to_pylist()
                packed = [zlib.compress(memoryview(buf[a:b]), 1) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(_home(doc, key, parts), pa.int32()), pa.array([1] * len(doc), pa.int8()), binary([None if x else doc[i : i + 1] for i, x in enumerate(none)]), binary([key[i : i + 1] for i in range(len(doc))]), pa.nulls(len(doc), pa.binary()), pa.array(packed, pa.binary())], ["part", "kind", "doc", "key", "n", "pos"])

    return run


def _rebuilt(k: int):
    """Flags come first (sorted), then the texts of the partition, one batch at a time."""

    def run(batches):
        flags: dict[tuple, list] = {}
        for batch in batches:
            out = []
            for kind, d, t, n, p in zip(*(batch.column(c).to_pylist() for c in ("kind", "doc", "key", "n", "pos")), strict=True):
                if kind == 0:
                    n = np.frombuffer(n, np.uint32).astype(np.int64)
                    pos = _starts(np.frombuffer(p, np.uint32).astype(np.int64), n).astype(np.int32)
                    for i, (a, b) in enumerate(zip(np.cumsum(n) - n, np.cumsum(n), strict=True)):
                        flags.setdefault((d[8 * i : 8 * i + 8], t[8 * i : 8 * i + 8]), []).append(pos[a:b])
                    continue
                words = zlib.decompress(p).split()
                hit = flags.get((d, t)) if d is not None else None
                spans: list[tuple[int, int]] = []
                if hit:
                    at = np.unique(np.concatenate(hit))
                    new = np.flatnonzero(np.diff(at, prepend=-k - 1) > k)
                    spans = list(zip(at[new].tolist(), (at[np.append(new[1:] - 1, len(at) - 1)] + k).tolist(), strict=True))
                    gone = np.zeros(len(words) + 1, np.int8)
                    for a, b in spans:
                        gone[a:b] = 1
                    kept = list(compress(words, (gone == 0).tolist()))
                else:
                    kept = words
                out.append((None if d is None else int.from_bytes(d, "little", signed=True), len(words), len(words) - len(kept), [{"start": a, "stop": b} for a, b in spans], b" ".join(kept).decode()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _OUT.types, strict=True)], schema=_OUT)

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.string())])


def substring_dedup(spark: SparkSession, docs: DataFrame, k: int = 13) -> DataFrame:
    """(doc_id, n_words, n_removed, removed, kept): maximal removed word intervals and the kept words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    parts = n_parts(spark, rows)
    back = "part int, kind tinyint, doc binary, key binary, n binary, pos binary"
    flags = rows.where("doc_id is not null").mapInArrow(_windows(parts, k), _PACK).repartitionById(parts, F.col("part")).mapInArrow(_counted(parts), back)
    texts = rows.mapInArrow(_texts(parts), back)
    return flags.union(texts).repartitionById(parts, F.col("part")).sortWithinPartitions("kind").mapInArrow(_rebuilt(k), "doc_id long, n_words long, n_removed long, removed array<struct<start:long,stop:long>>, kept string")
