"""Geometry: partitions, block grids, even and weighted splits, flush schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def even_split(length: Column, parts: int) -> Column:
    """Array of parts + 1 positions floor(length * k / parts)."""
    return F.transform(F.sequence(F.lit(0), F.lit(parts)), lambda k: F.floor(length * k / F.lit(parts)).cast("long"))


def split_weighted(seqs: DataFrame, weights: list[int]) -> DataFrame:
    """(seq_id, part, j0, j1): the parts of each sequence in proportion to the weights, from 1, inclusive."""
    total = sum(weights)
    ends = [sum(weights[:k]) for k in range(len(weights) + 1)]
    at = lambda c: F.floor(F.col("len") * F.lit(c) / F.lit(total)).cast("long")
    parts = F.array(*[F.struct(F.lit(k + 1).cast("long").alias("part"), (at(ends[k]) + 1).alias("j0"), at(ends[k + 1]).alias("j1")) for k in range(len(weights))])
    return seqs.select("seq_id", F.explode(parts).alias("p")).select("seq_id", "p.*")


def blocks(pairs: DataFrame, height: int, width: int, *keys: str) -> DataFrame:
    """(keys, by, bx, i0, i1, j0, j1, diagonal) of the blocks over sequences of n and m symbols."""
    rows = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / height)))
    cols = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / width)))
    got = pairs.where("n > 0 and m > 0").withColumn("by", rows).withColumn("bx", cols)
    return got.select(*keys, "by", "bx", (F.col("by") * height).alias("i0"), F.least((F.col("by") + 1) * height, F.col("n")).alias("i1"), (F.col("bx") * width).alias("j0"), F.least((F.col("bx") + 1) * width, F.col("m")).alias("j1"), (F.col("by") + F.col("bx")).alias("diagonal"))


def shifted(parts: DataFrame, down: Column | str, right: Column | str) -> DataFrame:
    """Partitions (i0, j0, i1, j1) moved by an offset, with height, width, area, and whether nothing but a gap fits in."""
    at = lambda c, by: (F.col(c) + (F.col(by) if isinstance(by, str) else by)).alias(c)
    keep = [c for c in parts.columns if c not in ("i0", "j0", "i1", "j1")]
    got = parts.select(*keep, at("i0", down), at("j0", right), at("i1", down), at("j1", right))
    got = got.withColumns({"height": F.col("i1") - F.col("i0"), "width": F.col("j1") - F.col("j0")})
    return got.withColumns({"area": F.col("height") * F.col("width"), "flat": (F.col("height") == 0) | (F.col("width") == 0)})


def row_major(parts: DataFrame, *keys: str) -> DataFrame:
    """Adds place: partitions of each matrix in the order of their dependencies, by rows, then by columns."""
    return parts.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("i0", "j0")) - 1)


def downsample(scores: DataFrame, most: int, *keys: str) -> DataFrame:
    """Largest score of each cell of a grid of at most most x most cells over (by, bx)."""
    size = scores.groupBy(*keys).agg((F.max("by") + 1).alias("h"), (F.max("bx") + 1).alias("w"))
    cell = lambda x, n: F.floor(F.col(x) * F.least(F.lit(most), F.col(n)) / F.col(n)).cast("long")
    return scores.join(size, list(keys)).groupBy(*keys, cell("by", "h").alias("y"), cell("bx", "w").alias("x")).agg(F.max("score").alias("score"))


def prune_flags(scores: DataFrame, match: int, *keys: str) -> DataFrame:
    """Adds best and prunable: whether no path through the block's best cell can beat the pair's best score.

    Columns: i1, j1 ends of the block, n, m lengths, score the block's best.
    """
    best = F.max("score").over(Window.partitionBy(*keys))
    left = F.least(F.col("n") - F.col("i0"), F.col("m") - F.col("j0"))
    return scores.withColumn("best", best).withColumn("prunable", F.col("score") + match * left <= F.col("best"))


def prune_counters(flags: DataFrame, *keys: str) -> DataFrame:
    """(keys, blocks, pruned, cells, pruned_cells) of rows with i0, i1, j0, j1 and prunable."""
    cells = (F.col("i1") - F.col("i0")) * (F.col("j1") - F.col("j0"))
    flags = flags.select(*keys, cells.alias("cells"), F.col("prunable").cast("long").alias("gone"))
    return flags.groupBy(*keys).agg(F.count("*").alias("blocks"), F.sum("gone").alias("pruned"), F.sum("cells").alias("cells"), F.sum(F.col("cells") * F.col("gone")).alias("pruned_cells"))


def flush_rows(n: str, m: str, limit: int, step: str) -> Column:
    """flush_interval of columns."""
    return F.expr(f"greatest(1L, shiftright({n} * {m} * 8 div {limit} + 1, CAST({step} div 2 AS INT)))")


def flush_interval(n: int, m: int, limit: int, step: int = 0) -> int:
    """Rows between saved rows, for limit bytes of saved cells; halves every two steps."""
    if limit <= 0:
        return 0
    return max(1, (n * m * 8 // limit + 1) >> (step // 2))
