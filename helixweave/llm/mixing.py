"""Mixing sources to target weights by Pareto order sampling.

* Sources share the mix in proportion to their weights; a target stops at ``cap`` times its source's size,
  and the excess goes to the others by weight until none is above its cap.
* In a source with target T and size S a document is expected in c * weight copies (at most ``cap``), where c
  makes the expected words T; without weights c = T / S. Its whole copies are certain. The fraction p that is
  left is its inclusion probability for one more copy.
* Such documents are ranked by their random odds u / (1 - u) over their inclusion odds p / (1 - p), smallest
  first, and taken in that order while the words that the whole copies leave of the target last. The sample's
  fixed size is counted in words, not in documents, since targets are words.

u is a hash of doc_id, so reruns agree. No source is sorted in one task: words are counted by (source, digit),
where the digits are those of the rank in base 256; documents below the digit in which the words run out are
taken, those above are not, and only those of that digit go on to the next one. When at most ``GROUP`` of a
source's documents are open they meet in one task, are taken in order where they still fit, and at last one
that does not fit is taken if that brings the words nearer to the target.

Edge cases: a null or empty text has size 0 and takes no words; a null source is a source, the last one; rows
without doc_id take part, with one u for all of them; ties of u are broken by the text's hash, and what is left
are equal rows, of which any may be taken; repeated rows count and are taken each by itself; texts are counted
whole, whatever their length; sources without words have target 0; an empty table gives an empty result.
Further columns of docs, of any name, are ignored unless ``keep`` names them.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, n_parts

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, CAP = (5, 2, 1), 3
#: Open documents of a source that one task decides, at most.
GROUP = 4096
#: Bits of the random number and of one digit of the rank.
BITS, DIGIT = 48, 8


def uniform(doc_id: str | Column = "doc_id") -> Column:
    """A whole number below 2**BITS from the hash of an id (null: as the empty id)."""
    name = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit("mix|"), name).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _digit(level: int) -> Column:
    """The level-th digit of the rank: of the odds, then two of the text's hash, then of a hash of the row."""
    odds = BITS // DIGIT
    if level < odds:
        return F.shiftright("rank", BITS - DIGIT * (level + 1)).bitwiseAND(255)
    name, at = (F.col("tie"), level - odds) if level < odds + 2 else (F.xxhash64("rid"), level - odds - 2)
    return F.shiftrightunsigned(name, 64 - DIGIT * (at + 1)).bitwiseAND(255)


def numbered(spark: SparkSession, names: DataFrame, column: str) -> DataFrame:
    """names with ``place``: from 0, in ascending order of the column, nulls last; the sort is distributed."""
    parts = n_parts(spark)
    sorted_ = cut(names.repartitionByRange(parts, F.col(column).asc_nulls_last()).withColumn("part", F.spark_partition_id()), spark)
    # one row for each partition: their running sum is the place of its first name
    counts = sorted_.groupBy("part").count()
    before = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("before"))
    local = F.row_number().over(Window.partitionBy("part").orderBy(F.col(column).asc_nulls_last())) - 1
    return sorted_.withColumn("local", local).join(before, "part").withColumn("place", F.col("before") + F.col("local")).drop("part", "local", "before")


def targets(spark: SparkSession, sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, total: float | None = None) -> DataFrame:
    """sizes (source, source_size) with share and target: words of the mix, ``total`` in all (all words, if not given)."""
    shares = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    got = cut(numbered(spark, sizes, "source").select("source", "source_size", shares.alias("share")), spark)
    if total is None:
        total = got.agg(F.sum("source_size")).first()[0] or 0
    top, level, known = F.col("source_size") * F.lit(float(cap)), 0.0, -1
    while True:
        # words of one unit of weight; every round caps more sources, or ends
        full = (F.col("share") * F.lit(level) > top) if known >= 0 else F.lit(False)
        n, gone, free = got.agg(F.count_if(full), F.sum(F.when(full, top)), F.sum(F.when(~full, F.col("share")))).first()
        if n == known or not free:
            break
        known, level = n, (total - (gone or 0.0)) / free
    return got.withColumn("target", F.least(top, F.col("share") * F.lit(float(level))))


def _rates(rows: DataFrame, sources: DataFrame, cap: float, spark: SparkSession) -> DataFrame:
    """sources with rate: expected copies of a document of weight 1, so that each source's expected words are its target."""
    same = lambda x: x.withColumnRenamed("source", "_source")
    got = sources.withColumn("rate", F.lit(None).cast("double"))
    known = -1
    while True:
        each = rows.join(same(got), F.col("source").eqNullSafe(F.col("_source")))
        full = F.coalesce(F.col("rate") * F.col("weight") > cap, F.lit(False))
        sums = each.groupBy("source").agg(F.count_if(full).alias("full"), F.sum(F.when(full, F.col("size") * F.lit(float(cap))).otherwise(0.0)).alias("gone"), F.sum(F.when(~full, F.col("size") * F.col("weight")).otherwise(0.0)).alias("free"))
        new = got.join(same(sums), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        # where all documents are full, the rate stays
        got = cut(new.withColumn("rate", F.when(F.col("free") > 0, (F.col("target") - F.col("gone")) / F.col("free")).otherwise(F.coalesce("rate", F.lit(0.0)))), spark)
        n = got.agg(F.sum("full")).first()[0]
        got = got.drop("full", "gone", "free")
        if n == known or n is None:
            return got
        known = n


def _chosen(table: pa.Table) -> pa.Table:
    """One source's open documents with extra: taken in order where they fit, and at last one that brings the words nearer."""
    rank, tie, rid, size = (table.column(c).to_numpy() for c in ("rank", "tie", "rid", "size"))
    rest, extra, over = table.column("rest")[0].as_py(), np.zeros(len(rank), np.int64), None
    for k in np.lexsort((rid, tie.view(np.uint64), rank)):
        if size[k] <= rest:
            extra[k] = 1
            rest -= size[k]
        elif over is None or size[k] < size[over]:
            over = k
    if over is not None and size[over] - rest < rest:
        extra[over] = 1
    return table.append_column("extra", pa.array(extra))


def _sampled(spark: SparkSession, rows: DataFrame, group: int) -> list[DataFrame]:
    """rows (source, size, rank, tie, rid, rest, ...) with extra, 1 for documents of the sample."""
    names, out, level = rows.columns, [], 0
    open_rows = rows
    schema = ", ".join(f"`{c}` {t}" for c, t in [*rows.dtypes, ("extra", "bigint")])
    while True:
        digit = _digit(level)
        counts = open_rows.groupBy("source", digit.alias("digit")).agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.first("rest").alias("rest"))
        w = Window.partitionBy("source")
        counts = counts.select("source", "digit", "words", "rest", F.sum("n").over(w).alias("n"), F.sum("words").over(w.orderBy("digit")).alias("until"))
        past = F.col("until") > F.col("rest")
        marks = counts.groupBy("source").agg((F.first("n") > group).alias("many"), F.min(F.when(past, F.col("digit"))).alias("edge"), F.coalesce(F.max(F.when(~past, F.col("until"))), F.lit(0)).alias("below"), F.count("*").alias("digits"))
        marks = cut(marks.withColumnRenamed("source", "_source"), spark)
        many, split = marks.agg(F.count_if("many"), F.count_if(F.col("many") & ((F.col("digits") > 1) | F.col("edge").isNull()) | ~F.col("many"))).first()
        if many and not split:
            # this digit tells nothing apart
            level += 1
            continue
        got = open_rows.join(marks, F.col("source").eqNullSafe(F.col("_source")))
        if not many:
            out.append(got.select(*names).groupBy("source").applyInArrow(_chosen, schema))
            return out
        state = F.when(~F.col("many"), "few").when(digit == F.col("edge"), "next").otherwise("sure")
        got = cut(got.select(*names, "below", (digit < F.coalesce("edge", F.lit(256))).cast("long").alias("extra"), state.alias("state")), spark)
        out.append(got.where("state = 'sure'").select(*names, "extra"))
        out.append(got.where("state = 'few'").select(*names).groupBy("source").applyInArrow(_chosen, schema))
        open_rows = got.where("state = 'next'").withColumn("rest", F.col("rest") - F.col("below")).select(*names)
        level += 1


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, total: float | None = None, weight: str | None = None, keep: tuple[str, ...] = (), group: int = GROUP) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) and the columns ``keep`` of every row of docs.

    weights: of the sources, in ascending order, repeating; total: words of the mix; weight: a column of docs
    by which documents of one source differ in their expected copies (null or negative: 0).
    """
    own = [f"k{i}" for i in range(len(keep))]
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    heavy = F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(f"`{weight}`").cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words.alias("size"), uniform().alias("u"), F.xxhash64("text").alias("tie"), heavy.alias("weight"), F.monotonically_increasing_id().alias("rid"), *[F.col(f"`{c}`").alias(k) for c, k in zip(keep, own, strict=True)])
    # written, so that rows keep their numbers
    rows = cut(rows, spark)
    sources = targets(spark, rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap, total)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sources = sources.withColumn("rate", rate) if weight is None else _rates(rows, sources, float(cap), spark)
    light = rows.drop(*own).join(sources.drop("share").withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    light = light.withColumn("copies", F.least(F.lit(float(cap)), F.col("rate") * F.col("weight")))
    light = light.withColumn("p", F.col("copies") - F.floor("copies")).withColumn("copies", F.floor("copies").cast("long"))
    left = light.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("sure")).withColumnRenamed("source", "_source")
    u = (F.col("u") + 0.5) / float(1 << BITS)
    odds = u / (1 - u) * (1 - F.col("p")) / F.col("p")
    rank = F.least(F.floor(odds / (1 + odds) * float(1 << BITS)), F.lit((1 << BITS) - 1)).cast("long")
    light = light.join(left, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rest = F.round("target").cast("long") - F.col("sure")
    names = ["rid", "doc_id", "source", "size", "source_size", "target", "copies"]
    light = cut(light.select(*names, "tie", F.when(F.col("p") > 0, rank).alias("rank"), rest.alias("rest")), spark)
    parts = [light.where("rank is null").withColumn("extra", F.lit(0).cast("long"))] + _sampled(spark, light.where("rank is not null"), group)
    got = reduce(DataFrame.unionByName, [x.select(*names, "extra") for x in parts])
    got = got.withColumn("copies", F.col("copies") + F.col("extra"))
    if own:
        got = got.join(rows.select("rid", *own), "rid")
    return got.select(*names[1:], *[F.col(k).alias(c) for c, k in zip(keep, own, strict=True)])


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row as often as it has copies."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
