"""Packing into optimal length buckets.

Texts are counted in words plus one end symbol and cut into sequences of at most ``max_len`` tokens.
The histogram of sequence lengths has at most max_len entries whatever the corpus; dynamic
programming over it picks the bucket boundaries of least padding. In each bucket sequences form
batches of at most ``budget`` tokens with padding. A sequence names the words of the text that it holds
(first_word, n_words) and whether the end symbol follows them, so that its tokens can be cut out. Places in a bucket come from counts of (bucket,
shard) and numbers inside each shard, so no bucket is ever sorted in one task; the number of shards follows from the
number of sequences, so places do not depend on the session's partitions.

Edge cases: a null or empty text is one sequence of the end symbol alone; a text of any length is cut,
never truncated; a bucket's last batch may be smaller; fewer lengths than buckets give one bucket a
length; an empty table gives an empty result. Rows that repeat are packed each, those without doc_id
too. Further columns of docs, of any name, are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut

MAX_LEN, BUCKETS, BUDGET = 2048, 16, 16_384
#: Sequences for each shard, about, until there are MAX_SHARDS of them.
SHARD_ROWS, MAX_SHARDS = 256, 1 << 20


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper ends of at most ``buckets`` buckets with the least total padding, by dynamic programming."""
    if not lengths:
        return []
    x, n = np.asarray(lengths, float), np.concatenate([[0], np.cumsum(counts)]).astype(float)
    tokens = np.concatenate([[0], np.cumsum(x * np.diff(n))])
    m, k = len(x), min(buckets, len(x))
    best = np.full(m + 1, np.inf)
    best[0] = 0
    choice = np.zeros((k + 1, m + 1), int)
    for b in range(1, k + 1):
        new = np.full(m + 1, np.inf)
        for j in range(b, m + 1):
            # the last bucket holds lengths i .. j-1 and pads them to x[j-1]
            cost = best[:j] + x[j - 1] * (n[j] - n[:j]) - (tokens[j] - tokens[:j])
            i = int(cost.argmin())
            new[j], choice[b, j] = cost[i], i
        best = new
    ends, j = [], m
    for b in range(k, 0, -1):
        ends.append(int(x[j - 1]))
        j = int(choice[b, j])
    return ends[::-1]


def pack(spark: SparkSession, docs: DataFrame, max_len: int = MAX_LEN, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """(doc_id, part, first_word, n_words, ends, n_tokens, bucket_len, batch, slot): batches count from 0 in each bucket."""
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    rows = docs.select("doc_id", (words + 1).cast("long").alias("total"))
    parts = F.sequence(F.lit(0), ((F.col("total") - 1) / max_len).cast("int"))
    # the written table fixes row order for the numbering below
    seqs = rows.select("doc_id", "total", F.explode(parts).alias("part"))
    n = F.least(F.lit(max_len), F.col("total") - F.col("part") * max_len)
    ends = (F.col("part") + 1) * max_len >= F.col("total")
    seqs = cut(seqs.select("doc_id", "part", (F.col("part") * max_len).cast("long").alias("first_word"), (n - ends.cast("long")).alias("n_words"), ends.alias("ends"), n.alias("n_tokens")), spark)
    histogram = seqs.groupBy("n_tokens").count().orderBy("n_tokens").collect()
    tops = boundaries([r[0] for r in histogram], [r[1] for r in histogram], buckets)
    if not tops:
        return seqs.select("doc_id", "part", "first_word", "n_words", "ends", "n_tokens", F.lit(0).cast("long").alias("bucket_len"), F.lit(0).cast("long").alias("batch"), F.lit(0).alias("slot"))
    bucket = F.lit(tops[-1])
    for e in reversed(tops[:-1]):
        bucket = F.when(F.col("n_tokens") <= e, F.lit(e)).otherwise(bucket)
    # by the number of sequences alone, so that places do not depend on the session
    shards = max(1, min(MAX_SHARDS, sum(r[1] for r in histogram) // SHARD_ROWS))
    shard = F.pmod(F.xxhash64("doc_id", "part"), F.lit(shards)).cast("int")
    rows = seqs.withColumn("bucket_len", bucket.cast("long")).withColumn("shard", shard)
    # buckets times shards counts; their running sums are the first places of the shards
    sizes = rows.groupBy("bucket_len", "shard").count()
    before = F.sum("count").over(Window.partitionBy("bucket_len").orderBy("shard")) - F.col("count")
    offset = sizes.select("bucket_len", "shard", before.alias("before"))
    local = F.row_number().over(Window.partitionBy("bucket_len", "shard").orderBy("doc_id", "part", "n_tokens")) - 1
    placed = rows.withColumn("local", local).join(offset, ["bucket_len", "shard"]).withColumn("place", F.col("before") + F.col("local"))
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_len")))
    return placed.select("doc_id", "part", "first_word", "n_words", "ends", "n_tokens", "bucket_len", F.floor(F.col("place") / room).alias("batch"), (F.col("place") % room).cast("int").alias("slot"))
