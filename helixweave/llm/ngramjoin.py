"""Exact n-gram Jaccard self-join by signature trees, with the components of its links.

* Documents with equal shingle sets form one class, counted before anything is compared; only its
  smallest document goes on.
* Prefix filter: with the shingles of a document in one global order (those frequent in a bounded
  sample last, an order that only steers cost), two documents within the threshold share one of
  their first n - ceil(t * n) + 1 shingles. Documents that share such a key form a bucket.
* Within a bucket a signature tree decides: a leaf holds the bitmap of a document's hashed shingles
  and its size, an inner node the OR of the bitmaps below, the range of sizes and the largest number
  of shingles that a bitmap hides by collisions. A traversal of node pairs from the root drops a pair
  if even popcount(A & B) plus the hidden shingles is below the overlap that its sizes need.
* Leaf pairs that survive connect documents to families; a family's full sets are shipped once, and
  the same tree, now followed by exact intersection, gives the links. Pairs that earlier links
  already connect are skipped, and only spanning edges leave a task, never all pairs.
* Buckets and families above CAP members are cut into tiles, joined tile pair by tile pair, so no
  task holds more than two tiles. Nothing is dropped.

Edge cases: null or empty texts have an empty set and are their own component; texts of fewer words
than n have their whole word sequence as one shingle; a null doc_id is its own (null) component; an
empty table gives an empty result; texts of any length have all their shingles. Rows that repeat a
doc_id are kept; an id is one node, which has the links of all its texts, and n_shingles is each
row's own. Further columns of docs, of any name, are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, Words, binary, components, cut, labels_of, lookup, mix, n_parts, raw, steps

#: Bits of a signature for each shingle, rounded up to a power of two; least and most 64-bit words.
SIG_BITS, SIG_LEAST, SIG_MOST = 2, 4, 1024
#: Members of a tile.
CAP = 4096
#: Documents (by a hash of the id) and shingles of the table that tells which shingles are frequent, at
#: most; it only orders a document's shingles, and any order gives the same links.
SAMPLE_DOCS, FREQUENT = 6000, 200_000
#: Pairs of nodes that a traversal compares at once, and bytes of their signatures.
_PAIRS, _PAIR_BYTES = 100_000, 8 << 20
#: Bytes of text of a step, about.
STEP = 500_000


def shingle_sets(buf: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    w = Words(buf, off)
    at = w.runs(n)
    mult = [U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)]

    def combine(first, k):
        h = np.full(len(first), U64(k) * U64(0x27D4EB2F165667C5))
        for j in range(k):
            h += w.hash[first + j] * mult[j % 3] ** U64(j // 3 + 1)
        return mix(h)

    h, begin = combine(at, n), np.searchsorted(at, w.at)
    out = [np.unique(h[a:b]) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
    for i in np.flatnonzero((w.counts() > 0) & (w.counts() < n)).tolist():
        out[i] = combine(w.at[i : i + 1], int(w.at[i + 1] - w.at[i]))
    return out


def width(n: int) -> int:
    """64-bit words of the signature of n shingles: a power of two."""
    need = -(-SIG_BITS * n // 64)
    return min(SIG_MOST, max(SIG_LEAST, 1 << (need - 1).bit_length() if need > 1 else 1))


def signature(s: np.ndarray) -> np.ndarray:
    words = width(len(s))
    sig = np.zeros(64 * words, np.uint8)
    sig[(s & U64(64 * words - 1)).astype(np.intp)] = 1
    return np.packbits(sig, bitorder="little").view(U64)


def folded(sig: np.ndarray, words: int) -> np.ndarray:
    """Rows of signatures cut to ``words`` words: bits are hashes modulo the width, so halves are OR-ed."""
    while sig.shape[1] > words:
        half = sig.shape[1] // 2
        sig = sig[:, :half] | sig[:, half:]
    return sig


class Tree:
    """Signature tree over documents given in size order; node pairs are traversed level by level."""

    def __init__(self, size: np.ndarray, sig: np.ndarray, num: int, den: int):
        self.num, self.den = num, den
        hidden = size - np.bitwise_count(sig).sum(1)
        self.levels = [(sig, size, size, hidden)]
        while len(self.levels[-1][1]) > 1:
            s, lo, hi, hid = self.levels[-1]
            at = np.arange(0, len(lo), 2)
            self.levels.append((np.bitwise_or.reduceat(s, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(hid, at)))

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        sig, lo, hi, hid = self.levels[level]
        ok = (hi[a] * self.den >= lo[b] * self.num) & (hi[b] * self.den >= lo[a] * self.num)
        i = np.flatnonzero(ok)
        most = np.bitwise_count(sig[a[i]] & sig[b[i]]).sum(1, dtype=np.int64) + np.minimum(hid[a[i]], hid[b[i]])
        # overlap o of sizes x, y links if o * (den + num) >= num * (x + y)
        ok[i] = most * (self.den + self.num) >= self.num * (lo[a[i]] + lo[b[i]])
        return ok

    def pairs(self):
        """Chunks of leaf pairs (a < b) that may link."""
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, a, b = todo.pop()
            most = max(1024, min(_PAIRS, _PAIR_BYTES // self.levels[level][0][0].nbytes))
            if len(a) > most:
                todo += [(level, a[i : i + most], b[i : i + most]) for i in range(0, len(a), most)]
                continue
            if level == 0:
                keep = a < b
                a, b = a[keep], b[keep]
            ok = self._possible(level, a, b)
            a, b = a[ok], b[ok]
            if level == 0:
                if len(a):
                    yield a, b
                continue
            if len(a):
                n = len(self.levels[level - 1][1])
                x = np.stack([2 * a, 2 * a, 2 * a + 1, 2 * a + 1], 1).ravel()
                y = np.stack([2 * b, 2 * b + 1, 2 * b, 2 * b + 1], 1).ravel()
                ok = (x < n) & (y < n) & (x <= y)
                todo.append((level - 1, x[ok], y[ok]))


def _star(doc: np.ndarray, lab: np.ndarray):
    """Spanning edges (document, smallest document of its component)."""
    least = np.full(len(doc), np.iinfo(np.int64).max)
    np.minimum.at(least, lab, doc)
    to = least[lab]
    keep = to != doc
    return doc[keep], to[keep]


def _merge(lab: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return labels_of(len(lab), np.concatenate([np.arange(len(lab)), a]), np.concatenate([lab, b]))


def _light(n: int, num: int, den: int, hot):
    def run(batches):
        for whole in batches:
            for batch in steps(whole, "text", STEP):
                sets = shingle_sets(*raw(batch.column("text")), n)
                every = np.concatenate(sets) if sets else np.empty(0, U64)
                rare = lookup(every, hot.value) < 0
                at, keys, sigs, names = 0, [], [], []
                for s in sets:
                    r = rare[at : at + len(s)]
                    at += len(s)
                    p = len(s) - -(-num * len(s) // den) + 1 if len(s) else 0
                    keys.append(np.concatenate([s[r][:p], s[~r][: max(0, p - int(r.sum()))]]).view(np.int64))
                    sigs.append(signature(s) if len(s) else None)
                    names.append(hashlib.blake2b(s, digest_size=16).digest() if len(s) else None)
                off = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.binary()), pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(keys))), binary(sigs)], ["doc_id", "n", "name", "keys", "sig"])

    return run


def _blocks(batches):
    """Tables that hold whole buckets only, for partitions sorted by bucket."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        k = t.column("bucket").to_numpy()
        last = int(np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))[-1])
        held = t.slice(last)
        if last:
            yield t.slice(0, last)
    if held is not None:
        yield held


def _bounds(t: pa.Table) -> np.ndarray:
    k = t.column("bucket").to_numpy()
    return np.concatenate([np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])), [len(k)]])


def _candidates(size, sigs, tile, num: int, den: int):
    """Chunks of index pairs whose sizes and signatures allow a link (documents in order of size).

    Documents of equal signature width meet in one tree; those of the next width join them, folded.
    """
    words = np.array([len(x) // 8 for x in sigs])
    tiles = not (tile == tile[0]).all()
    for w in np.unique(words).tolist():
        at = np.flatnonzero((words == w) | (words == 2 * w))
        own = words[at] == w
        if own.sum() == 0 or len(at) < 2:
            continue
        # size order makes sizes of nodes narrow
        sig = np.empty((len(at), w), U64)
        for wide in (w, 2 * w):  # twice as wide at most: sizes that may link differ by less
            pick = np.flatnonzero(words[at] == wide)
            if len(pick):
                sig[pick] = folded(np.frombuffer(b"".join([sigs[i] for i in at[pick]]), U64).reshape(len(pick), wide), w)
        for a, b in Tree(size[at], sig, num, den).pairs():
            keep = own[a] | own[b]
            a, b = at[a[keep]], at[b[keep]]
            if tiles:
                keep = tile[a] != tile[b]
                a, b = a[keep], b[keep]
            if len(a):
                yield a, b


class _Edges:
    """Edge arrays on their way out, in batches of some size."""

    def __init__(self):
        self.a, self.b, self.n = [], [], 0

    def add(self, a, b):
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.n += len(a)

    def flush(self, least: int = 0):
        if self.n > least:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(self.a)), pa.array(np.concatenate(self.b))], ["a", "b"])
            self.__init__()


def _families(num: int, den: int):
    """Spanning candidate edges of each bucket."""

    def run(batches):
        out = _Edges()
        for t in _blocks(batches):
            doc, size, tile = (t.column(c).to_numpy() for c in ("doc_id", "n", "tile"))
            sigs = t.column("sig").to_pylist()
            cuts = _bounds(t)
            many = np.diff(cuts)
            # buckets of two, all at once
            i = cuts[:-1][many == 2]
            i = i[(size[i] * den >= size[i + 1] * num) & (size[i + 1] * den >= size[i] * num)]
            words = np.array([len(x) // 8 for x in sigs])
            for w in np.unique(words[i]).tolist():
                j = i[(words[i] == w) & (words[i + 1] == w)]
                if len(j):
                    x, y = (np.frombuffer(b"".join([sigs[k] for k in at]), U64).reshape(len(at), w) for at in (j, j + 1))
                    hid = np.minimum(size[j] - np.bitwise_count(x).sum(1), size[j + 1] - np.bitwise_count(y).sum(1))
                    ok = (np.bitwise_count(x & y).sum(1, dtype=np.int64) + hid) * (den + num) >= num * (size[j] + size[j + 1])
                    out.add(np.maximum(doc[j], doc[j + 1])[ok], np.minimum(doc[j], doc[j + 1])[ok])
            odd = np.zeros(len(many), bool)
            odd[np.searchsorted(cuts, i[words[i] != words[i + 1]])] = True
            for g in np.flatnonzero((many > 2) | odd).tolist():
                at = np.arange(cuts[g], cuts[g + 1])
                at = at[np.lexsort((doc[at], size[at]))]
                lab = np.arange(len(at))
                for a, b in _candidates(size[at], [sigs[k] for k in at], tile[at], num, den):
                    new = lab[a] != lab[b]
                    if new.any():
                        lab = _merge(lab, a[new], b[new])
                out.add(*_star(doc[at], lab))
            yield from out.flush(50_000)
        yield from out.flush()

    return run


def _links(num: int, den: int):
    """Spanning edges of the exact links of each family."""

    def run(batches):
        out = _Edges()
        for t in _blocks(batches):
            docs, tiles, blobs = t.column("doc_id").to_numpy(), t.column("tile").to_numpy(), t.column("shingles").to_pylist()
            cuts = _bounds(t)
            for at, to in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                sets = [np.frombuffer(x, U64) for x in blobs[at:to]]
                size = np.array([len(s) for s in sets])
                order = np.lexsort((docs[at:to], size))
                doc, tile, size, sets = docs[at:to][order], tiles[at:to][order], size[order], [sets[i] for i in order]
                lab = np.arange(len(doc))
                for a, b in _candidates(size, [signature(s).tobytes() for s in sets], tile, num, den):
                    while True:
                        new = lab[a] != lab[b]
                        a, b = a[new], b[new]
                        if not len(a):
                            break
                        # a few hundred pairs at a time: what they connect need not be tested again
                        x, y, a, b = a[:256], b[:256], a[256:], b[256:]
                        hit = np.array([_overlap(sets[i], sets[j]) * (den + num) >= num * (len(sets[i]) + len(sets[j])) for i, j in zip(x.tolist(), y.tolist(), strict=True)])
                        if hit.any():
                            lab = _merge(lab, x[hit], y[hit])
                out.add(*_star(doc, lab))
            yield from out.flush(50_000)
        yield from out.flush()

    return run


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    return int((lookup(a, b) >= 0).sum())


def _tiled(rows: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Rows with (bucket, tile): one bucket for each key, or one for each tile pair of a large key."""
    t = F.ceil(F.col("members") / F.lit(CAP)).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), t).cast("int")
    rows = rows.join(counts, key).withColumn("tiles", t).withColumn("tile", own)
    pair = lambda o: F.xxhash64(F.col(key), F.least("tile", o), F.greatest("tile", o))
    few = F.when(F.col("tiles") == 1, F.array(F.col(key).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), pair))
    return rows.select(F.explode(few).alias("bucket"), *[c for c in rows.columns if c not in (key, "members", "tiles")])


def jaccard_components(spark: SparkSession, docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) for links of at least percent % Jaccard similarity of n-word shingles."""
    num, den = percent, 100
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    parts = n_parts(spark, rows)

    def sets(batches):
        for whole in batches:
            for batch in steps(whole, "text", STEP):
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), binary(shingle_sets(*raw(batch.column("text")), n))], [*(c for c in batch.schema.names if c != "text"), "shingles"])

    def fresh(batches):
        # the join brings an id's rows one after another: of rows that repeat one set goes on
        now, known = None, set()
        for batch in sets(batches):
            keep = []
            for k, (b, d, t, x) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "doc_id", "tile", "shingles")), strict=True)):
                if d != now:
                    now, known = d, set()
                key = b, t, hashlib.blake2b(x, digest_size=16).digest()
                if key not in known:
                    known.add(key)
                    keep.append(k)
            yield batch if len(keep) == batch.num_rows else batch.take(pa.array(keep, pa.int64()))

    def seen(batches):
        for batch in sets(batches):
            flat = np.concatenate([np.frombuffer(x, U64) for x in batch.column("shingles").to_pylist()] or [np.empty(0, U64)])
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64))], ["h"])

    one_in = F.lit(max(1, rows.count() // SAMPLE_DOCS))
    often = rows.where(F.pmod(F.xxhash64("doc_id"), one_in) == 0).select("text").mapInArrow(seen, "h long").groupBy("h").count().where("count >= 3")
    often = np.array([r[0] for r in often.orderBy(F.desc("count"), "h").limit(FREQUENT).select("h").toLocalIterator()], np.int64).view(U64)
    hot = spark.sparkContext.broadcast(np.sort(often))

    light = cut(rows.mapInArrow(_light(n, num, den, hot), "doc_id long, n long, name binary, keys array<long>, sig binary"), spark)
    hot.destroy()
    some = light.where("name is not null and doc_id is not null")
    # what depends on the text alone is the same in all rows of a class
    reps = cut(some.groupBy("name").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "keys", "sig")]), spark)

    keyed = reps.select("doc_id", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    in_buckets = _tiled(keyed, shared, "key")
    # in the order of size, a member whose neighbours are too small or too large links with none
    w = Window.partitionBy("bucket").orderBy("n", "doc_id")
    fits = (F.lag("n").over(w) * den >= F.col("n") * num) | (F.lead("n").over(w) * num <= F.col("n") * den)
    fitting = in_buckets.withColumn("fits", fits).where("fits")
    # the same documents meet under many keys; a list of them (of two tiles at most) is one bucket
    lists = fitting.groupBy("bucket").agg(F.array_sort(F.collect_set(F.struct("doc_id", "tile"))).alias("members"))
    lists = cut(lists.groupBy("members").agg(F.min("bucket").alias("bucket")), spark)
    member = lists.select("bucket", F.explode("members").alias("m")).select("bucket", "m.doc_id", "m.tile")
    rich = member.join(reps.select("doc_id", "n", "sig"), "doc_id")
    edges = rich.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_families(num, den), "a long, b long")
    family = components(edges, spark)

    sizes = family.groupBy("component").agg(F.count("*").alias("members"))
    placed = _tiled(family.select(F.col("node").alias("doc_id"), "component"), sizes, "component")
    # a text moves once, to its id; only members go on, as sets. No size of table changes this plan.
    wanted = rows.join(placed.hint("merge"), "doc_id").select("bucket", "doc_id", "tile", "text").mapInArrow(fresh, "bucket long, doc_id long, tile int, shingles binary")
    links = wanted.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_links(num, den), "a long, b long")
    # an id with several texts belongs to the class of each
    several = some.select("doc_id", "name").distinct().groupBy("doc_id").agg(F.collect_list("name").alias("names")).where(F.size("names") > 1)
    same = several.select("doc_id", F.explode("names").alias("name")).join(reps.select("name", F.col("doc_id").alias("rep")), "name").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    linked = components(links.union(same), spark)

    named = reps.select("name", F.col("doc_id").alias("rep")).join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("name", F.coalesce("component", "rep").alias("class_component"))
    return light.select("doc_id", "n", "name").join(named, "name", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_component", "doc_id")).alias("component_id"))
