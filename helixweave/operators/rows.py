"""Saved rows of the matrix: selection, as-of and containment lookups, and the match of two borders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def special_rows(seqs: DataFrame, block: int, every: int) -> DataFrame:
    """(seq_id, row_id): the last row of each every-th block row, and of the last."""
    ids = F.transform(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("len") / block).cast("long")), lambda k: F.least(k * F.lit(block).cast("long"), F.col("len")))
    keep = F.filter(ids, lambda r: (r % (block * every) == 0) | (r == F.col("len")))
    return seqs.where("len > 0").select("seq_id", F.explode(keep).alias("row_id"))


def within_budget(saved: DataFrame, budget: int, *keys: str) -> DataFrame:
    """Saved rows (keys, row_id, bytes, ..) of which every 2**k-th stays, with the smallest k that keeps a budget of bytes.

    bytes: the size of one whole row; rows of a matrix have one size. A budget below one row keeps none.
    """
    w = Window.partitionBy(*keys)
    place, most = F.row_number().over(w.orderBy("row_id")), F.floor(F.lit(budget) / F.col("bytes"))
    got = saved.withColumns({"place": place, "n": F.count("*").over(w), "most": most})
    # floor(n / 2**k) rows stay
    fits = F.filter(F.sequence(F.lit(0), F.lit(40)), lambda k: F.floor(F.col("n") / F.pow(F.lit(2.0), k)) <= F.col("most"))
    got = got.withColumn("thinned", F.get(fits, F.lit(0)))
    return got.where((F.col("most") > 0) & (F.col("place") % F.pow(F.lit(2.0), "thinned").cast("long") == 0)).drop("place", "n", "most")


def border_kinds(edges: DataFrame) -> DataFrame:
    """(.., side, kind) for rows with start: how the first row (R) and column (C) of a matrix are filled.

    zeroes where the start may lie anywhere along that side, gaps elsewhere.
    """
    side = F.explode(F.array(F.struct(F.lit("R").alias("side"), F.lit("*13").alias("free")), F.struct(F.lit("C").alias("side"), F.lit("*23").alias("free")))).alias("s")
    kind = F.when(F.instr("s.free", F.col("start")) > 0, "zeroes").otherwise("gaps")
    return edges.select("*", side).select("*", F.col("s.side").alias("side"), kind.alias("kind")).drop("s")


def largest_interval(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("seq_id").orderBy("row_id")
    gap = F.col("row_id") - F.lag("row_id", 1, 0).over(w)
    return rows.select("seq_id", gap.alias("gap")).groupBy("seq_id").agg(F.max("gap").alias("max_gap"))


def asof_row(points: DataFrame, rows: DataFrame, min_dist: int = 128) -> DataFrame:
    """For each (seq_id, i): the greatest saved row more than min_dist above it; row 0 serves any i > 0; else null.

    Points and rows are sorted together once; there is no non-equi join.
    """
    p = points.select("seq_id", F.col("i").alias("at"), F.lit(1).alias("kind"), F.col("i"), F.lit(None).cast("long").alias("row_id"))
    r = rows.where("row_id > 0").select("seq_id", (F.col("row_id") + min_dist + 1).alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("i"), "row_id")
    w = Window.partitionBy("seq_id").orderBy("at", "kind", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    got = p.unionByName(r).withColumn("row", F.max("row_id").over(w)).where("kind = 1")
    return got.select("seq_id", "i", F.when(F.col("row").isNotNull(), F.col("row")).when(F.col("i") > 0, F.lit(0)).cast("long").alias("row_id"))


def containing(points: DataFrame, parts: DataFrame, width: int, *keys: str) -> DataFrame:
    """Points (keys, i, j) with the partition (i0 < i <= i1, j0 < j <= j1) that holds them.

    Partitions are listed under every stripe of width rows that they meet, so this is an equi-join.
    """
    stripe = F.explode(F.sequence(F.floor(F.col("i0") / width), F.floor((F.col("i1") - 1) / width)))
    p = points.withColumn("stripe", F.floor((F.col("i") - 1) / width))
    q = parts.where("i1 > i0 and j1 > j0").withColumn("stripe", stripe)
    return p.join(q, [*keys, "stripe"]).where("i0 < i and i <= i1 and j0 < j and j <= j1").drop("stripe")


def match_borders(forward: DataFrame, backward: DataFrame, goal: int, gap_open: int = 3) -> DataFrame:
    """First k at which a forward and a backward border add up to the goal: (id, k, type, score).

    forward, backward: (id, h array, g array) over the same k. type 0: H + H = goal; 1: G + G + open = goal.
    A sum above the goal is an error.
    """
    both = forward.join(backward.select("id", F.col("h").alias("h2"), F.col("g").alias("g2")), "id")
    ks = F.sequence(F.lit(0), F.size("h") - 1)
    sums = F.transform(ks, lambda k: F.struct(k.alias("k"), (F.get("h", k) + F.get("h2", k)).alias("hh"), (F.get("g", k) + F.get("g2", k) + gap_open).alias("gg")))
    over = F.exists(sums, lambda s: (s["hh"] > goal) | (s["gg"] > goal))
    hit = F.get(F.filter(sums, lambda s: (s["hh"] == goal) | (s["gg"] == goal)), F.lit(0))
    got = both.select("id", F.when(over, F.raise_error(F.lit("borders add up to more than the goal"))).otherwise(hit).alias("x"), "h", "g")
    kind = F.when(F.col("x.hh") == goal, 0).otherwise(1)
    return got.where("x is not null").select("id", F.col("x.k").cast("long").alias("k"), kind.alias("type"), F.when(F.col("x.hh") == goal, F.get("h", F.col("x.k"))).otherwise(F.get("g", F.col("x.k"))).cast("long").alias("score"))
