"""Benchmark decontamination with DataFrame functions only: SimHash of item-sized windows.

A document leaks an item if some window of as many words as the item has a weighted-shingle
similarity (sum of minima over sum of maxima of the counts of the five-word shingles) of at least 0.8.

1. Words are lower-cased runs of letters and digits; every document gets the array of its shingle
   hashes. A window that shares no shingle with an item has similarity 0, so documents without any
   shingle of the benchmark stop here (a semi-join on shingles; Spark picks broadcast or shuffle by
   the size of the benchmark side). The others are written once, with their arrays.
2. Around shared shingles lie the windows. A window of similarity t has at most (1 - t) of its
   shingles unmatched, so its first match of the item lies in its first (1 - t) * size places: each
   match opens the windows that start there, back to the match before it. How many shingles a window
   shares is not looked at here; that is left to the fingerprints.
3. Each window is fingerprinted: for each of 64 bits the shingles that set it vote (eight-bit counters
   packed eight to a word, summed by an aggregate), and the majority is the bit.
4. Multi-index: the fingerprint is cut into BLOCKS of 8 bits. Two fingerprints within RADIUS differ in
   at most RADIUS // BLOCKS bits of some block, so items are listed under every block value within
   that distance, and windows of the same size join on (size, block, value); the first block that
   agrees yields the pair. RADIUS is far above the distance expected at similarity 0.8.
5. Pairs within RADIUS are verified by the exact similarity.

Edge cases: null or empty texts and items of fewer than five words have no five-word shingle and take
no part, nor do rows without doc_id; the only window of a document shorter than the item is the whole
document; repeated items each count; rows that repeat a doc_id give one row for each item they leak;
texts of any length are searched whole; an empty table on either side gives an empty result. Further
columns, of any name, are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, n_parts

SHINGLE, SIMILARITY = 5, 0.8
BLOCKS, RADIUS = 8, 23
#: Distance within a block that RADIUS leaves for the closest of BLOCKS blocks.
NEAR = RADIUS // BLOCKS


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(word_hashes: Column) -> Column:
    """64-bit hashes of all runs of SHINGLE words."""
    n = F.size(word_hashes) - SHINGLE
    at = lambda i: F.xxhash64(*[F.get(word_hashes, i + j) for j in range(SHINGLE)])
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), at)).otherwise(F.array().cast("array<bigint>"))


def hashed(df: DataFrame, *keep: str) -> DataFrame:
    """keep, n_words, grams (one hash for each five-word shingle, in order)."""
    w = df.select(*keep, F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("w"))
    return w.select(*keep, F.size("w").alias("n_words"), shingles(F.col("w")).alias("grams"))


#: Each byte with its bits spread to eight one-byte counters.
_SPREAD = [sum((v >> b & 1) << 8 * b for b in range(8)) for v in range(256)]


_TABLE = f"array({', '.join(f'{x}L' for x in _SPREAD)})"


def with_simhash(df: DataFrame, grams: str, out: str) -> DataFrame:
    """Adds the majority vote of the bits of all grams, a tie or an empty list counting as 0.

    Packed counters hold up to 127 votes without touching a sign bit; longer lists are counted bit by bit.
    """
    lanes = [f"aggregate({grams}, 0L, (acc, h) -> acc + get({_TABLE}, CAST(shiftrightunsigned(h, {8 * i}) & 255 AS INT)))" for i in range(8)]
    counts = [f"aggregate({grams}, 0L, (acc, h) -> acc + (shiftrightunsigned(h, {i}) & 1))" for i in range(64)]
    df = df.withColumn("_votes", F.expr(f"CASE WHEN size({grams}) <= 127 THEN array({', '.join(lanes)}) ELSE array({', '.join(counts)}) END"))
    bits = [f"shiftleft(CAST(CASE WHEN size({grams}) <= 127 THEN shiftrightunsigned(get(_votes, {i // 8}), {8 * (i % 8)}) & 255 ELSE get(_votes, {i}) END * 2 > size({grams}) AS BIGINT), {i})" for i in range(64)]
    return df.withColumn(out, F.expr(" | ".join(bits))).drop("_votes")


def _block(fp: Column, b: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * b).bitwiseAND(F.lit(255)).cast("int")


def _listed(b: int, masks: list[int]) -> Column:
    """All values of block b within NEAR bits of the item's."""
    return F.transform(F.array(*map(F.lit, masks)), lambda m: F.struct(F.lit(b).alias("block"), _block(F.col("item_fp"), b).bitwiseXOR(m).alias("value")))


def similarity(a: Column, b: Column) -> Column:
    """Sum of minima over sum of maxima of the counts in two lists of grams."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(times(a, x), times(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def contaminated(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, word): the best window of each leaked item; word: its first word."""
    # arrays are written before they are filtered: a pushed filter would compute them inside itself
    bench = cut(hashed(items.select("item_id", "text"), "item_id"), spark).where(f"n_words >= {SHINGLE}")
    bench = cut(with_simhash(bench, "grams", "item_fp"), spark)
    marks = bench.select("item_id", "n_words", F.explode("grams").alias("gram"))

    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the outer form infers no filter on the array either
    gram_at = hashed(texts, "doc_id").select("doc_id", F.posexplode_outer("grams").alias("at", "gram"))
    hits = cut(gram_at.join(marks.select("gram").distinct(), "gram", "left_semi"), spark)

    # positions of each item's shingles in each document
    found = hits.join(marks.distinct(), "gram").groupBy("doc_id", "item_id", "n_words").agg(F.array_sort(F.collect_set("at")).alias("at"))
    size = F.col("n_words") - (SHINGLE - 1)
    slack = F.floor(size * F.lit(1 - SIMILARITY) + 1e-9).cast("int")
    found = found.withColumn("size", size).withColumn("slack", slack)
    runs = F.transform("at", lambda p, i: F.struct(F.greatest(p - F.col("slack"), F.lit(0), F.when(i > 0, F.get("at", i - 1) + 1).otherwise(0)).alias("a"), p.alias("b")))
    starts = F.explode(F.flatten(F.transform(runs, lambda r: F.sequence(r["a"], r["b"]))))
    places = found.select("doc_id", "n_words", "size", starts.alias("word")).distinct()
    per_doc = places.groupBy("doc_id").agg(F.collect_list(F.struct("n_words", "size", "word")).alias("places"))

    # partitions by number: adaptive execution would put the few bytes of these documents into a few tasks
    parts = n_parts(spark, texts)
    near = cut(hashed(texts.repartition(parts, "doc_id").join(per_doc.repartition(parts, "doc_id"), "doc_id"), "doc_id", "places"), spark)
    near = near.select("doc_id", "grams", F.explode("places").alias("p"))
    # a document shorter than the item is one window; similar enough, its first match lies near its begin
    fits = (F.col("p.word") + F.col("p.size") <= F.size("grams")) | ((F.col("p.word") == 0) & (F.col("p.size") > F.size("grams")))
    windows = near.where(fits).select("doc_id", F.col("p.n_words").alias("n_words"), F.col("p.word").alias("word"), F.slice("grams", F.col("p.word") + 1, F.col("p.size")).alias("window"))
    windows = cut(windows, spark).repartition(parts, "doc_id", "n_words", "word")
    windows = cut(with_simhash(windows, "window", "fp"), spark)

    blocks = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), _block(F.col("fp"), b).alias("value")) for b in range(BLOCKS)]))
    masks = [m for m in range(256) if m.bit_count() <= NEAR]
    listed = F.explode(F.flatten(F.array(*[_listed(b, masks) for b in range(BLOCKS)])))
    index = bench.select("item_id", "n_words", "item_fp", "grams", listed.alias("k")).select("item_id", "n_words", "item_fp", "grams", "k.block", "k.value")
    pairs = windows.select("doc_id", "n_words", "word", "window", "fp", blocks.alias("k")).select("*", "k.block", "k.value").drop("k").join(index, ["n_words", "block", "value"])
    # one row for each pair: that of the first block in which the two are near
    diff = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.coalesce(*[F.when(F.bit_count(_block(diff, b)) <= NEAR, F.lit(b)) for b in range(BLOCKS)])
    pairs = pairs.where((first == F.col("block")) & (F.bit_count(diff) <= RADIUS))
    sure = pairs.withColumn("similarity", similarity(F.col("window"), F.col("grams"))).where(F.col("similarity") >= SIMILARITY)
    best = F.max(F.struct("similarity", (-F.col("word")).alias("word")))
    return sure.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.similarity").alias("similarity"), (-F.col("b.word")).cast("long").alias("word"))
