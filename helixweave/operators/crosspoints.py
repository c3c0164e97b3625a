"""Points of an optimal path as rows (aln, ord, type, i, j, score). Types: 0 match, 1 gap on a, 2 gap on b."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def from_paths(paths: DataFrame, every: int, *keys: str) -> DataFrame:
    """The ends of the path and every every-th of its steps, with the score so far.

    Steps are cut into pieces of ``every``; what each moves and is worth adds up by running sums over the pieces.
    """
    pieces = F.regexp_extract_all("ops", F.lit(f"(.{{1,{every}}})"), F.lit(1))
    got = paths.where("end_i >= 0").select(*keys, "start_i", "start_j", F.posexplode(pieces).alias("k", "piece"))
    w = Window.partitionBy(*keys).orderBy("k")
    n = lambda r: F.regexp_count("piece", F.lit(r)).cast("long")
    # a gap that goes on from the piece before was opened there
    head, last = F.left("piece", F.lit(1)), F.right("piece", F.lit(1))
    goes_on = F.coalesce(F.lag(last).over(w) == head, F.lit(False)) & head.isin("V", "H")
    value = n("M") - 3 * n("X") - 2 * n("[VH]") - 3 * (n("V+") + n("H+") - goes_on.cast("long"))
    got = got.withColumns({"di": n("[MXV]"), "dj": n("[MXH]"), "v": value})
    ends = got.select(
        *keys,
        (F.col("k") * every + F.char_length("piece")).alias("ord"),
        F.when(last == "H", 1).when(last == "V", 2).otherwise(0).alias("type"),
        (F.col("start_i") - 1 + F.sum("di").over(w)).alias("i"),
        (F.col("start_j") - 1 + F.sum("dj").over(w)).alias("j"),
        F.sum("v").over(w).alias("score"),
    )
    starts = paths.where("end_i >= 0").select(*keys, F.lit(0).alias("ord"), F.lit(0).alias("type"), (F.col("start_i") - 1).alias("i"), (F.col("start_j") - 1).alias("j"), F.lit(0).cast("long").alias("score"))
    return starts.unionByName(ends)


def concat(left: DataFrame, right: DataFrame, *keys: str) -> DataFrame:
    """The list of one part followed by that of its neighbour, which begins with the point that the first one ends with.

    That point is kept once; places go on from it. A neighbour that begins elsewhere is an error.
    """
    w = Window.partitionBy(*keys)
    end = left.withColumn("top", F.max("ord").over(w)).where("ord = top").select(*keys, "top", *[F.col(c).alias(f"_{c}") for c in ("type", "i", "j")])
    both = right.withColumn("low", F.min("ord").over(w)).join(end, list(keys))
    meets = (F.col("ord") > F.col("low")) | ((F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j")) & (F.col("type") == F.col("_type")))
    place = F.when(meets, F.col("ord") - F.col("low")).otherwise(F.raise_error(F.lit("the lists do not meet")))
    rest = both.withColumn("place", place).where("place > 0").select(*keys, (F.col("top") + F.col("place")).cast("int").alias("ord"), "type", "i", "j", "score")
    return left.select(*keys, "ord", "type", "i", "j", "score").unionByName(rest)


def segments(points: DataFrame, *keys: str) -> DataFrame:
    """Consecutive points: (keys, ord, i0, j0, i1, j1, di, dj, d_score)."""
    w = Window.partitionBy(*keys).orderBy("ord")
    got = points.select(*keys, "ord", F.lag("i").over(w).alias("i0"), F.lag("j").over(w).alias("j0"), F.col("i").alias("i1"), F.col("j").alias("j1"), (F.col("score") - F.lag("score").over(w)).alias("d_score"))
    return got.where("i0 is not null").withColumns({"di": F.col("i1") - F.col("i0"), "dj": F.col("j1") - F.col("j0")})


def largest(points: DataFrame, *keys: str) -> DataFrame:
    """Largest height and width of the partitions that are no mere gap."""
    return segments(points, *keys).where("di <> 0 and dj <> 0").groupBy(*keys).agg(F.max("di").alias("max_di"), F.max("dj").alias("max_dj"))


def reverse(points: DataFrame, *keys: str) -> DataFrame:
    """The points seen from the other end, with the sequences exchanged; needs n, m."""
    w = Window.partitionBy(*keys).orderBy(F.desc("ord"))
    kind = F.when(F.col("type") == 1, 2).when(F.col("type") == 2, 1).otherwise(F.col("type"))
    return points.select(*keys, (F.row_number().over(w) - 1).alias("ord"), kind.alias("type"), (F.col("m") - F.col("j")).alias("i"), (F.col("n") - F.col("i")).alias("j"), "score")


def merge(points: DataFrame, more: DataFrame, *keys: str) -> DataFrame:
    """Both lists in path order; a point equal to the one before it goes."""
    both = points.select(*keys, "type", "i", "j", "score").unionByName(more.select(*keys, "type", "i", "j", "score"))
    w = Window.partitionBy(*keys).orderBy("i", "j", "type", "score")
    same = (F.lag("i").over(w) == F.col("i")) & (F.lag("j").over(w) == F.col("j")) & (F.lag("type").over(w) == F.col("type"))
    kept = both.withColumn("same", F.coalesce(same, F.lit(False))).where("not same").drop("same")
    return kept.withColumn("ord", F.row_number().over(w) - 1)
