"""Reading and writing of crosspoints, alignments and borders.

Parquet is the native store. The text and binary forms exist for exchange: crosspoints as START, one
``type,i,j,score`` line each, END, one list a file or many; alignments as one compact binary value a row (gap positions as
base-128 differences).
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixweave.functions.scoring import Scores, border
from helixweave.functions.sequences import read_varint, varint


def crosspoints_text(points: DataFrame, *keys: str) -> DataFrame:
    """(keys, value): one text for each list of points."""
    row = F.struct("ord", F.concat_ws(",", *[F.col(c).cast("string") for c in ("type", "i", "j", "score")]).alias("t"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["t"]), "\n")
    return points.groupBy(*keys).agg(F.concat(F.lit("START\n"), body, F.lit("\nEND\n")).alias("value"))


def write_crosspoints(points: DataFrame, path: str, *keys: str) -> None:
    """One text file for each list, in a folder named by its keys; lists are added to those that are there."""
    crosspoints_text(points, *keys).write.mode("append").partitionBy(*keys).option("lineSep", "\n").text(path)


def read_crosspoints(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """(file, keys, ord, type, i, j, score) of text files of crosspoints; lines after END do not count.

    keys: columns that the names of the folders give.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), *keys, F.regexp_extract("value", r"(?s)START\s(.*?)END", 1).alias("body"))
    rows = text.select("file", *keys, F.posexplode(F.regexp_extract_all("body", F.lit(r"(?m)^(\s*-?\d+\s*,\s*-?\d+\s*,\s*-?\d+\s*,\s*-?\d+)"), F.lit(1))).alias("ord", "line"))
    part = lambda k: F.trim(F.get(F.split("line", ","), F.lit(k)))
    return rows.select("file", *keys, "ord", part(0).cast("int").alias("type"), part(1).cast("long").alias("i"), part(2).cast("long").alias("j"), part(3).cast("long").alias("score"))


def write_crosspoint_lists(points: DataFrame, path: str, *keys: str) -> None:
    """Lists one after the other in a text file for each task, each with a line of its keys before START."""
    name = F.to_json(F.array(*[F.col(k).cast("string") for k in keys]))
    lists = crosspoints_text(points, *keys)
    lists.select(F.concat(name, F.lit("\n"), F.col("value")).alias("value")).write.mode("append").option("lineSep", "\n").text(path)


def read_crosspoint_lists(spark: SparkSession, path: str, keys: str) -> DataFrame:
    """(keys, ord, type, i, j, score) of files of many lists; keys: columns with types, as their lines give them in order.

    A list is a row, so files of any number of lists are split among tasks.
    """
    lists = spark.read.option("lineSep", "\nEND\n").text(path).withColumn("value", F.split("value", "\nSTART\n", 2)).where("size(value) = 2")
    name = F.from_json(F.regexp_extract(F.get("value", F.lit(0)), r"([^\n]*)$", 1), "array<string>")
    columns = [F.get("_name", F.lit(k)).cast(t).alias(c) for k, (c, t) in enumerate(x.split() for x in keys.split(","))]
    rows = lists.select(name.alias("_name"), F.posexplode(F.split(F.get("value", F.lit(1)), "\n")).alias("ord", "line"))
    rows = rows.select(*columns, "ord", F.split("line", ",").alias("_at"))
    part = lambda k: F.trim(F.get("_at", F.lit(k)))
    return rows.select(*[x.split()[0] for x in keys.split(",")], "ord", part(0).cast("int").alias("type"), *[part(k).cast("long").alias(c) for k, c in ((1, "i"), (2, "j"), (3, "score"))])


def encode_alignment(score: int, span: tuple[int, int, int, int], gaps0: list, gaps1: list) -> bytes:
    """Score and span as big-endian integers, then both gap lists: count, and (position difference, length) pairs."""
    out = struct.pack(">q4q", score, *span)
    for gaps in (gaps0, gaps1):
        out += varint(len(gaps))
        last = 0
        for pos, n in sorted(gaps):
            out += varint(pos - last) + varint(n)
            last = pos
    return out


def decode_alignment(data: bytes) -> tuple:
    score, *span = struct.unpack_from(">q4q", data)
    at, lists = 40, []
    for _ in range(2):
        n, at = read_varint(data, at)
        gaps, last = [], 0
        for _ in range(n):
            d, at = read_varint(data, at)
            size, at = read_varint(data, at)
            last += d
            gaps.append((last, size))
        lists.append(gaps)
    return score, tuple(span), *lists


def gaps_of(start_i: int, start_j: int, ops: str) -> tuple[list, list]:
    """(position, length) of the gaps on a and on b: the last symbol consumed before the gap."""
    i, j, gaps = start_i - 1, start_j - 1, ([], [])
    k = 0
    while k < len(ops):
        o, e = ops[k], k + 1
        while e < len(ops) and o in "VH" and ops[e] == o:
            e += 1
        if o == "H":
            gaps[0].append((i, e - k))
            j += e - k
        elif o == "V":
            gaps[1].append((j, e - k))
            i += e - k
        else:
            i, j = i + 1, j + 1
        k = e
    return gaps


def alignments_binary(paths: DataFrame, *keys: str) -> DataFrame:
    """(keys, data): each non-empty alignment in the compact form."""

    def run(batches):
        for batch in batches:
            rows = batch.to_pylist()
            data = [encode_alignment(r["score"], (r["start_i"], r["start_j"], r["end_i"], r["end_j"]), *gaps_of(r["start_i"], r["start_j"], r["ops"])) for r in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(data, pa.binary())], [*keys, "data"])

    types = dict(paths.dtypes)
    rows = paths.where("end_i >= 0").select(*keys, "score", "start_i", "start_j", "end_i", "end_j", "ops")
    return rows.mapInArrow(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", data binary")


def read_alignments(packed: DataFrame, *keys: str) -> DataFrame:
    """(keys, score, start_i, start_j, end_i, end_j, gaps0, gaps1) of rows (keys, data)."""
    gaps = "array<struct<pos:bigint,len:bigint>>"

    def run(batches):
        for batch in batches:
            got = [decode_alignment(x) for x in batch.column("data").to_pylist()]
            lists = [[[{"pos": p, "len": n} for p, n in g[k]] for g in got] for k in (2, 3)]
            kind = pa.list_(pa.struct([("pos", pa.int64()), ("len", pa.int64())]))
            numbers = [pa.array([g[0] for g in got], pa.int64()), *(pa.array([g[1][k] for g in got], pa.int64()) for k in range(4))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *numbers, *(pa.array(x, kind) for x in lists)], [*keys, "score", "start_i", "start_j", "end_i", "end_j", "gaps0", "gaps1"])

    types = dict(packed.dtypes)
    return packed.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keys), *(f"{c} long" for c in ("score", "start_i", "start_j", "end_i", "end_j")), f"gaps0 {gaps}", f"gaps1 {gaps}"]))


def cells(spark: SparkSession, url: str, kind: str = "zeroes", scores: Scores = Scores()) -> DataFrame:
    """Border cells (k, h, g) of a URL: ``null://N`` makes N cells, ``init://N`` a border of a kind, others are read as Parquet."""
    scheme, _, rest = url.partition("://")
    if scheme == "null":
        return spark.range(int(rest)).select(F.col("id").alias("k"), F.lit(0).alias("h"), F.lit(0).alias("g"))
    if scheme == "init":
        # the first three cells give the rest: from index 1 on a border falls evenly
        h = border(kind, 2, scores).tolist()
        value = F.when(F.col("id") == 0, h[0]).otherwise(F.lit(h[1]) + (F.col("id") - 1) * (h[2] - h[1]))
        return spark.range(int(rest) + 1).select(F.col("id").alias("k"), value.cast("int").alias("h"), F.lit(-999_999_999).alias("g"))
    if scheme in ("socket",):
        raise ValueError("borders between tasks go through shuffles and files; there is no socket form")
    return spark.read.parquet(url)


def discard(df: DataFrame) -> None:
    """The sink that keeps nothing."""
    df.write.format("noop").mode("overwrite").save()
