"""FASTA, read by Spark so that any store works: one row for each record, or chunks of records of any size."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixweave.functions import sequences as S
from helixweave.operators.pairs import clean

from .session import work_dir


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, description, accession, seq, len). A record begins with '>' at the start of a line."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("record"))
    text = raw.withColumn("value", F.regexp_replace("value", "^>", "")).where(F.btrim("value", F.lit(" \r\n")) != "")
    head = F.regexp_extract("value", r"^([^\r\n]*)", 1)
    body = F.regexp_replace("value", r"^[^\r\n]*", "")
    seq = clean(body)
    return text.select("file", "record", head.alias("description"), S.accession(head).alias("accession"), seq.alias("seq"), F.char_length(seq).cast("long").alias("len"))


def fasta_chunks(records: DataFrame, size: int, *keys: str) -> DataFrame:
    """(keys, no, bases): sequences in chunks, as operators on large pairs take them; each is walked once."""
    parts = F.regexp_extract_all("seq", F.lit(f"(?s)(.{{1,{size}}})"), F.lit(1))
    return records.where("len > 0").select(*keys, F.posexplode(parts).alias("no", "bases"))


_DROP = {ord(c): None for c in " \r\n"} | {k: k - 32 for k in range(ord("a"), ord("z") + 1)}


def _runs(batches, volumes: bool):
    """(split, header or None, text) in the order of the lines; the text of lines that follow each other comes in one."""
    last = None
    for batch in batches:
        split, start = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("split", "start"))
        value = batch.column("value")
        head = pc.starts_with(value, ">").to_numpy(zero_copy_only=False).copy()
        new = np.append(True, split[1:] != split[:-1])
        if not volumes:
            # a file's first line is its description, with or without a mark
            first = new & (start == 0)
            first[0] &= last != split[0]
            head |= first
        edges = np.flatnonzero(head | new | np.append(True, head[:-1]))
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(split)], strict=True):
            if head[a]:
                yield int(split[a]), value[a].as_py().removeprefix(">").rstrip("\r"), ""
            else:
                # lines of a batch lie side by side in one buffer
                text = value.slice(a, b - a)
                off = np.frombuffer(text.buffers()[1], np.int64 if pa.types.is_large_string(text.type) else np.int32)[text.offset : text.offset + b - a + 1]
                yield int(split[a]), None, bytes(text.buffers()[2] or b"")[off[0] : off[-1]].decode().translate(_DROP)
        last = split[-1]


def _counted(volumes: bool):
    """(split, seg, description) of every header; and a row for each split (seg null): headers, symbols before the first and after the last one."""
    names = ["split", "seg", "description", "heads", "lead", "tail"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    def run(batches):
        of: dict[int, list[int]] = {}
        out: list[tuple] = []
        for split, header, text in _runs(batches, volumes):
            x = of.setdefault(split, [0, 0, 0])
            if header is not None:
                x[0], x[2] = x[0] + 1, 0
                out.append((split, x[0], header, None, None, None))
                if len(out) == 10_000:
                    yield table(out)
                    out = []
            elif x[0]:
                x[2] += len(text)
            else:
                x[1] += len(text)
        yield table([*out, *((split, None, None, *x) for split, x in of.items())])

    return run


def _pieces(size: int, volumes: bool, carried):
    """(split, seg, no, at, part, bases): the symbols after the seg-th header of a split, cut where chunks of size end.

    carried: symbols of the record that each split goes on with. part: another split may hold the rest of the chunk.
    """
    names = ["split", "seg", "no", "at", "part", "bases"]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.string()]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    def run(batches):
        now, seg, at, held, out, many = None, 0, 0, "", [], 0
        carry = carried.value
        for split, header, text in _runs(batches, volumes):
            if split != now or header is not None:
                if held:
                    out.append((now, seg, at // size, at, split != now or at % size > 0, held))
                now, seg, held = split, seg + 1 if split == now else int(header is not None), ""
                at = 0 if seg else carry.get(split, 0)
            held += text
            used = 0
            while len(held) - used >= (room := size - at % size):
                out.append((now, seg, at // size, at, room < size, held[used : used + room]))
                used, at = used + room, at + room
            held, many = held[used:], many + used
            if many > 4_000_000:
                yield table(out)
                out, many = [], 0
        if held:
            out.append((now, seg, at // size, at, True, held))
        yield table(out)

    return run


def scan_fasta(spark: SparkSession, path: str, size: int, volumes: bool = False) -> tuple[DataFrame, DataFrame]:
    """((file, record, description, accession), (file, record, no, bases)) of FASTA files whose records may have any size.

    Every split of a file finds its own headers and symbols. A first pass counts them, one row for each split; their
    running sums tell which record and place a split begins in, so a second pass cuts symbols where chunks end, and only
    chunks that cross from split to split are put together. No row is longer than ``size`` symbols or a line of
    the file. With ``volumes`` all files of a folder, in order of their names, are one stream, which a record may cross;
    ``file`` is then the folder. Both passes run, and are written, when this is called.
    """
    top = work_dir(spark, "scan")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{top}/{name}")
        return spark.read.schema(df.schema).parquet(f"{top}/{name}")

    where = F.struct("_metadata.file_path", "_metadata.file_block_start").alias("at")
    lines = spark.read.text(path).select(where, "value")
    split = F.xxhash64("at.file_path", "at.file_block_start").alias("split")
    lines = lines.select(split, F.col("at.file_path").alias("file"), F.col("at.file_block_start").alias("start"), "value")
    plain = lines.select("split", "start", "value")
    found = written(plain.mapInArrow(_counted(volumes), "split long, seg long, description string, heads long, lead long, tail long"), "found")
    names = lines.groupBy("split").agg(F.first("file").alias("file"), F.first("start").alias("start"))
    stream = F.regexp_replace("file", "[^/]*$", "") if volumes else F.col("file")
    splits = names.join(found.where("seg is null").select("split", "heads", "lead", "tail"), "split").withColumn("stream", stream)
    order = Window.partitionBy("stream").orderBy("file", "start")
    splits = splits.withColumn("until", F.sum("heads").over(order))
    # since the last header: its split's tail, and all of the splits after it
    since = F.sum(F.when(F.col("heads") > 0, F.col("tail")).otherwise(F.col("lead"))).over(Window.partitionBy("stream", "until").orderBy("file", "start"))
    splits = splits.withColumn("since", since).select("split", "stream", (F.col("until") - F.col("heads")).alias("before"), F.coalesce(F.lag("since").over(order), F.lit(0)).alias("carry"))
    splits = written(splits, "splits")
    placed = lambda df: df.join(splits, "split").withColumns({"file": F.col("stream"), "record": F.col("before") + F.col("seg") - 1})
    heads = placed(found.where("seg is not null")).select("file", "record", "description", S.accession(F.col("description")).alias("accession"))
    # a number for each split that begins within a record
    carried = spark.sparkContext.broadcast({r[0]: r[1] for r in splits.where("carry > 0").select("split", "carry").toLocalIterator()})
    pieces = written(plain.mapInArrow(_pieces(size, volumes, carried), "split long, seg long, no int, at long, part boolean, bases string"), "pieces")
    carried.destroy()
    # symbols before any header belong to no record
    rows = placed(pieces).where("record >= 0")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "bases"))), lambda x: x["bases"]), "")
    crossing = rows.where("part").groupBy("file", "record", "no").agg(whole.alias("bases"))
    return heads, rows.where("not part").select("file", "record", "no", "bases").unionByName(crossing)


def write_fasta(seqs: DataFrame, path: str, width: int = 70) -> None:
    """Rows (description, seq) as FASTA text."""
    lines = F.array_join(F.regexp_extract_all(F.col("seq"), F.lit(f"(.{{1,{width}}})"), F.lit(1)), "\n")
    seqs.select(F.concat(F.lit(">"), "description", F.lit("\n"), lines).alias("value")).write.text(path)


def write_volumes(lines: DataFrame, path: str, *order: str) -> None:
    """Text lines (value) in the order of the columns, as consecutive files of one stream; no task writes them all."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(n, *order).sortWithinPartitions(*order).select("value").write.text(path)
