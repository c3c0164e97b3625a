"""Line dedup by pairwise alignment: patience diff of documents that share line hashes.

* Lines are split at newlines and compared without white space at their ends, by 64-bit hashes (two
  different lines share one with odds of 2**-64 a pair).
  Documents with the same text form a class whose smallest document stands for it; later copies align
  with it line by line.
* Candidate pairs. A line held by at most RARE classes links each of its holders to every earlier one.
  More frequent lines go by levels (RARE to RARE * STEP holders, and so on). On a level all rarer lines of
  a document count as lines that nothing equals, and a run of them as one; what remains is its outline. A
  pair whose rarest shared line belongs to the level aligns exactly as the two outlines do, so different
  outlines that share a line of the level are aligned once, for all their documents: a document loses what
  the outline of any earlier document covers. Every earlier document that shares a line is thus compared,
  while pairs grow with the lines and the different outlines, not with the square of a line's holders.
  (A pair that also shares rarer lines is aligned by all its lines, and by its frequent ones alone.)
* Each pair is aligned by patience diff: lines that occur once in both are matched along a longest
  increasing subsequence, the gaps between matches recursively, and what is equal at the ends of a gap
  is matched too; what stays unmatched is aligned again, so that blocks that changed places are found. Aligned
  runs of consecutive lines with at least ``min_chars`` characters are deleted from the later document. What one
  earlier document does not cover another may.

Edge cases: null texts stay null and empty texts stay empty; rows without doc_id pass unchanged, as do
blank lines outside a deleted run; lines repeated within one document stay; a text that loses all its
lines becomes empty; rows that repeat a doc_id with the same text are one document; with different
texts the one whose MD5 is larger counts as the later one. White space at the ends of a line is blanks,
tabs, returns, vertical tabs and form feeds. Texts of any length are compared whole; an empty table gives
an empty result. Columns of docs keep their names and values, whatever they are called, but for ``text``
and ``n_lines_removed``, which the result replaces.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

#: Holders up to which a line links all of them.
RARE = 6
#: Each level of more frequent lines reaches up to so many times the holders of the one before.
STEP = 8
MIN_CHARS = 40
#: Rows whose lines a task holds as Python numbers at once.
ROWS = 256
#: Lines that equal nothing on the other side.
_EARLY, _LATE = object(), object()


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Matched index pairs of two lists, increasing in both."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, i2, j, j2 = todo.pop()
        while i < i2 and j < j2 and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i2 and j < j2 and a[i2 - 1] == b[j2 - 1]:
            i2, j2 = i2 - 1, j2 - 1
            out.append((i2, j2))
        if i >= i2 or j >= j2:
            continue
        where: dict = {}
        for k in range(i, i2):
            where[a[k]] = -1 if a[k] in where else k
        seen: dict = {}
        for k in range(j, j2):
            if a_at := where.get(b[k], -1) + 1:
                seen[b[k]] = (-1, -1) if b[k] in seen else (a_at - 1, k)
        once = [p for p in seen.values() if p[0] >= 0]  # in order of b
        if not once:
            continue
        tails: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for n, (x, _) in enumerate(once):
            at = bisect_left(tails, x)
            back.append(ends[at - 1] if at else -1)
            if at == len(tails):
                tails.append(x)
                ends.append(n)
            else:
                tails[at], ends[at] = x, n
        chain, n = [], ends[-1]
        while n >= 0:
            chain.append(once[n])
            n = back[n]
        x, y = i, j
        for p in reversed(chain):
            todo.append((x, p[0], y, p[1]))
            out.append(p)
            x, y = p[0] + 1, p[1] + 1
        todo.append((x, i2, y, j2))
    return sorted(out)


def common_blocks(early: list, late: list, chars: list[int], min_chars: int) -> list[int]:
    """Indexes of the late lines in aligned runs of at least min_chars characters.

    What one alignment leaves unmatched on either side is aligned again until no lines match, so that blocks in
    another order are found as well, whatever lines they stand beside.
    """
    gone: list[int] = []
    early, late = list(early), list(late)
    while True:
        pairs = patience(early, late)
        run: list[int] = []
        last = (-2, -2)
        for p in [*pairs, (-9, -9)]:
            if p != (last[0] + 1, last[1] + 1):
                if run and sum(chars[k] for k in run) >= min_chars:
                    gone += run
                run = []
            run.append(p[1])
            last = p
        # matched lines are used up and equal nothing
        for i, j in pairs:
            early[i], late[j] = _EARLY, _LATE
        rest = {*early} & {*late}
        if not pairs or not rest or sum(chars[k] for k, x in enumerate(late) if x in rest) < min_chars:
            return gone


def _few(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _align(min_chars: int, *keys: str):
    def run(batches):
        for batch in _few(batches):
            rows = zip(*(batch.column(c).to_pylist() for c in ("early_lines", "late_lines", "late_chars")), strict=True)
            found = [common_blocks([_EARLY if x is None else x for x in a], [_LATE if x is None else x for x in b], n, min_chars) for a, b, n in rows]
            some = pa.array([k for k, gone in enumerate(found) if gone], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(some) for c in keys), pa.array([gone for gone in found if gone], pa.list_(pa.int32()))], [*keys, "gone"])

    return run


def outlines(lines: list, chars: list[int], often: dict, rare: int) -> list[tuple]:
    """(level, name, lines, chars, places, links) of a document on each level that has lines of it."""
    out, level, at_most = [], 0, rare
    while any(n > at_most for n in often.values()):
        links = [x for x, n in often.items() if at_most < n <= at_most * STEP]
        if links:
            kept: list[tuple] = []
            for k, (x, c) in enumerate(zip(lines, chars, strict=True)):
                if not c or often.get(x, 0) > at_most:
                    kept.append((x, c, k))
                elif not kept or kept[-1][0] is not None:
                    kept.append((None, 0, k))
            seen = [x[0] for x in kept]
            name = f"{level}-{hashlib.blake2b(repr(seen).encode(), digest_size=16).hexdigest()}"
            out.append((level, name, seen, [x[1] for x in kept], [x[2] for x in kept], links))
        level, at_most = level + 1, at_most * STEP
    return out


_OUTLINES = "doc_id long, _name string, level int, outline string, lines array<long>, chars array<int>, places array<int>, links array<long>"


def _outlines(rare: int):
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    names = [x.split()[0] for x in _OUTLINES.split(", ")]

    def run(batches):
        for batch in _few(batches):
            rows = [(r["doc_id"], r["_name"], *o) for r in batch.to_pylist() for o in outlines(r["lines"], r["chars"], {x["line"]: x["n"] for x in r["often"]}, rare)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return run


def _gone_by_outline(spark: SparkSession, light: DataFrame, often: DataFrame, min_chars: int, rare: int) -> DataFrame:
    """(_name, gone) for blocks of lines with more than rare holders; often: (id, line, n)."""
    of = often.groupBy("id").agg(F.collect_list(F.struct("line", "n")).alias("often"))
    marks = cut(light.join(of, "id").select("doc_id", "_name", "lines", "chars", "often").mapInArrow(_outlines(rare), _OUTLINES).withColumn("id", F.struct("doc_id", "_name")), spark)
    shapes = cut(marks.groupBy("level", "outline").agg(F.min("id").alias("first"), F.max("id").alias("last"), *[F.first(c).alias(c) for c in ("lines", "chars", "links")]), spark)
    links = shapes.select("level", F.explode("links").alias("line"), "outline", "first", "last")
    early = links.select("level", "line", F.col("outline").alias("early"), "first")
    late = links.select("level", "line", F.col("outline").alias("late"), "last")
    pairs = early.join(late, ["level", "line"]).where(F.col("first") < F.col("last")).select("early", "late").distinct()
    a = shapes.select(F.col("outline").alias("early"), F.col("lines").alias("early_lines"), F.struct("first.*").alias("first"))
    b = shapes.select(F.col("outline").alias("late"), F.col("lines").alias("late_lines"), F.col("chars").alias("late_chars"))
    both = pairs.join(a, "early").join(b, "late").select("late", "first", "early_lines", "late_lines", "late_chars")
    found = both.mapInArrow(_align(min_chars, "late", "first"), "late string, first struct<doc_id:bigint,_name:string>, gone array<int>")
    # the earliest document whose outline covers each line of an outline
    since = found.select(F.col("late").alias("outline"), F.explode("gone").alias("k"), "first").groupBy("outline", "k").agg(F.min("first").alias("since"))
    since = since.groupBy("outline").agg(F.collect_list(F.struct("k", "since")).alias("all"))
    got = marks.select("id", "outline", "places").join(since, "outline")
    gone = F.transform(F.filter("all", lambda x: x["since"] < F.col("id")), lambda x: F.get("places", x["k"]))
    return got.select(F.col("id._name").alias("_name"), gone.alias("gone")).where(F.size("gone") > 0)


def line_dedup(spark: SparkSession, docs: DataFrame, min_chars: int = MIN_CHARS, rare: int = RARE) -> DataFrame:
    """All columns of docs, text without deleted lines, and n_lines_removed."""
    text_, id_ = F.col("_row.text"), F.col("_row.doc_id")
    lines = F.split(text_, "\n", -1)
    # stripping blanks alone is several times faster, and enough for most texts
    odd = text_.rlike(r"[\t\r\x0B\f]")
    trimmed = F.when(odd, F.transform(lines, lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")))).otherwise(F.transform(lines, lambda x: F.trim(x)))
    # the row travels as one column, so that no name inside it can clash
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    marked = marked.withColumn("_name", F.when(id_.isNotNull(), F.md5(text_.cast("binary"))))
    light = marked.where("_name is not null").select(id_.cast("long").alias("doc_id"), "_name", trimmed.alias("lines"))
    light = light.select("doc_id", "_name", F.transform("lines", lambda x: F.xxhash64(x)).alias("lines"), F.transform("lines", lambda x: F.char_length(x)).alias("chars"))
    classes = light.groupBy("_name").agg(F.min("doc_id").alias("rep"))
    # classes are numbered by (document, text), so that "earlier" is a total order
    light = light.join(classes.withColumnRenamed("rep", "doc_id"), ["_name", "doc_id"]).dropDuplicates(["_name"])
    light = cut(light.withColumn("id", F.struct("doc_id", "_name")), spark)

    held = light.select("id", F.explode(F.array_distinct(F.transform(F.arrays_zip("lines", "chars"), lambda z: F.when(z["chars"] > 0, z["lines"])))).alias("line")).where("line is not null")
    few = held.groupBy("line").agg(F.count("*").alias("n")).where("n > 1")
    shared = held.join(few, "line")
    often = shared.where(F.col("n") > rare)
    lists = shared.where(F.col("n") <= rare).groupBy("line").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    seldom = lists.select(F.explode(F.flatten(F.transform("ids", lambda x, i: F.transform(F.slice("ids", 1, i), lambda y: F.struct(y.alias("early"), x.alias("late")))))).alias("p")).select("p.early", "p.late")
    pairs = seldom.distinct()

    early = light.select(F.col("id").alias("early"), F.col("lines").alias("early_lines"))
    late = light.select(F.col("id").alias("late"), F.col("lines").alias("late_lines"), F.col("chars").alias("late_chars"))
    both = pairs.join(early, "early").join(late, "late").select(F.col("late._name").alias("_name"), "early_lines", "late_lines", "late_chars")

    gone = both.mapInArrow(_align(min_chars, "_name"), "_name string, gone array<int>").union(_gone_by_outline(spark, light, often, min_chars, rare))
    gone = gone.groupBy("_name").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("_gone"))
    fate = classes.withColumnRenamed("rep", "_rep").join(gone, "_name", "left")
    # only texts with something to delete meet it: later copies, and classes with deleted lines
    got = marked.join(fate, "_name", "left")
    copy = id_ > F.col("_rep")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone"))
    kept = F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")
    whole = F.aggregate(F.transform(trimmed, lambda x: F.char_length(x)), F.lit(0), lambda x, y: x + y) >= min_chars
    text = F.when(copy & whole, F.lit("")).when(F.col("_gone").isNotNull(), kept).otherwise(text_)
    n = F.when(copy & whole, F.size(lines)).otherwise(F.coalesce(F.size(F.col("_gone")), F.lit(0)))
    n = F.when(text_.isNull(), 0).otherwise(F.greatest(n, F.lit(0)))
    columns = [c for c in docs.columns if c.lower() != "n_lines_removed"]
    return got.select(*[text.alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in columns], n.cast("long").alias("n_lines_removed"))
