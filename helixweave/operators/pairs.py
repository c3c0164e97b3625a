"""Sequences and pairs of sequences as DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def clean(text: Column) -> Column:
    """Blanks and line ends out, a-z to upper case, in one pass."""
    return F.translate(text, _LOW + " \r\n", _UP)


def sequences(df: DataFrame, id_col: str, text: Column) -> DataFrame:
    """(seq_id, seq, len); null texts are no sequences."""
    return df.select(F.col(id_col).cast("long").alias("seq_id"), text.alias("seq")).where("seq is not null").withColumn("len", F.char_length("seq").cast("long"))


def event_sequences(events: DataFrame) -> DataFrame:
    """One sequence for each user: a symbol for each event, in order of time.

    The events of a user are sorted inside an array, so no window sorts the whole table.
    """
    steps = F.array_sort(F.collect_list(F.struct("ts", "event_id", F.upper(F.substring("event_type", 1, 1)).alias("c"))))
    got = events.where("user_id is not null and event_type is not null").groupBy(F.col("user_id").cast("long").alias("seq_id")).agg(F.array_join(F.transform(steps, lambda x: x["c"]), "").alias("seq"))
    return got.withColumn("len", F.char_length("seq").cast("long"))


def _groups(df: DataFrame) -> int:
    """Groups whose pairs are about as many as the session's shuffle partitions, at least 16."""
    return max(16, math.ceil(math.sqrt(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def meet_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every row of left with every row of right, where that is the question asked (streams may be on the left).

    Both sides are dealt into groups, and each pair of groups is one key of an equi-join: no nested loop, no
    hot key, and no side has to fit in memory.
    """
    groups = _groups(right)
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    own = lambda df: F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(groups)).cast("int")
    x = left.select("*", own(left).alias("_x")).select("*", every.alias("_y"))
    y = right.select("*", own(right).alias("_y")).select("*", every.alias("_x"))
    return x.join(y, ["_x", "_y"]).drop("_x", "_y")


def all_pairs(seqs: DataFrame) -> DataFrame:
    """(aid, bid, a, b) for every two sequences, aid < bid.

    All pairs is the operator itself. Sequences are dealt into groups and each pair of groups is one
    key of an equi-join, so the work spreads over tasks without a nested-loop join and no side has to
    fit in memory.
    """
    groups = _groups(seqs)
    s = seqs.select("seq_id", "seq", F.pmod(F.xxhash64("seq_id"), F.lit(groups)).cast("int").alias("g"))
    others = F.sequence(F.lit(0), F.lit(groups - 1))
    key = F.explode(F.transform(others, lambda o: F.least("g", o) * groups + F.greatest("g", o)))
    x = s.select("seq_id", "seq", "g", key.alias("cell"))
    a, b = x.select(F.col("seq_id").alias("aid"), F.col("seq").alias("a"), "cell", F.col("g").alias("ga")), x.select(F.col("seq_id").alias("bid"), F.col("seq").alias("b"), "cell", F.col("g").alias("gb"))
    one_cell = F.col("cell") == F.least("ga", "gb") * groups + F.greatest("ga", "gb")
    return a.join(b, "cell").where(one_cell & (F.col("aid") < F.col("bid"))).select("aid", "bid", "a", "b")


def same_where_known(a: DataFrame, b: DataFrame, known: list[str], key: str) -> DataFrame:
    """Rows of a and b of one key that agree in every column that both know."""
    b = b.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in known], *[c for c in b.columns if c != key and c not in known])
    fit = F.lit(True)
    for c in known:
        fit &= F.col(c).isNull() | F.col(f"_{c}").isNull() | (F.col(c) == F.col(f"_{c}"))
    return a.join(b, key).where(fit).drop(*[f"_{c}" for c in known])
