"""Raw border cells as a data source: ``spark.read.format("cells")``.

A folder holds files ``cells-<index of the first cell>`` of 8-byte cells, two little-endian 32-bit integers (h, g) each.
Readers split them by byte ranges, so a border of any length is read in parallel. Options: ``offset`` and ``count``
(cells of the stream to skip and to take), ``reverse`` (the stream from its last cell on), ``step`` (cells a task).
Writers take rows (k, h, g) whose k are consecutive within a task; files get their names when the job commits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "k long, h int, g int"
CELL = np.dtype([("h", "<i4"), ("g", "<i4")])
_STEP = 1 << 20


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int, int]]:
    """(path, first cell, number of cells) of a folder's files, in order; gaps between them are an error."""
    store, top = _store(path)
    found = [f for f in store.get_file_info(fs.FileSelector(top)) if f.base_name.startswith("cells-")]
    out, at = [], 0
    for f in sorted(found, key=lambda f: int(f.base_name.removeprefix("cells-"))):
        first = int(f.base_name.removeprefix("cells-"))
        if first != at or f.size % CELL.itemsize:
            raise ValueError(f"{f.path} does not go on where the file before ends")
        out.append((f.path, first, f.size // CELL.itemsize))
        at += f.size // CELL.itemsize
    return out


@dataclass
class Range(InputPartition):
    """Cells start .. start + count - 1 of a file; k is the stream's index of the first one read."""

    file: str
    start: int
    count: int
    k: int

    def __post_init__(self):
        super().__init__(self.k)


class CellReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.reverse = options["path"], str(options.get("reverse", "false")).lower() == "true"
        self.offset, self.step = int(options.get("offset", 0)), int(options.get("step", _STEP))
        self.count = int(options["count"]) if "count" in options else None
        if self.offset < 0 or self.step <= 0 or (self.count or 0) < 0:
            raise ValueError("offset and count are not negative, step is positive")

    def partitions(self) -> list[Range]:
        files = _files(self.path)
        total = files[-1][1] + files[-1][2] if files else 0
        end = total if self.count is None else min(total, self.offset + self.count)
        # the stream's cells offset .. end - 1, as cells of the files
        low, high = (total - end, total - self.offset) if self.reverse else (self.offset, end)
        out = []
        for file, first, n in files:
            for a in range(max(low, first), min(high, first + n), self.step):
                b = min(a + self.step, high, first + n)
                out.append(Range(file, a - first, b - a, total - b if self.reverse else a))
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing to read
            return
        store, _ = _store(self.path)
        with store.open_input_file(partition.file) as f:
            cells = np.frombuffer(f.read_at(partition.count * CELL.itemsize, partition.start * CELL.itemsize), CELL)
        cells = cells[::-1] if self.reverse else cells
        k = np.arange(partition.k, partition.k + len(cells))
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(cells["h"].astype(np.int32)), pa.array(cells["g"].astype(np.int32))], ["k", "h", "g"])


@dataclass
class Written(WriterCommitMessage):
    file: str | None
    first: int
    count: int


class CellWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, top = _store(self.path)
        store.create_dir(top)
        name, first, count = f"{top}/_part-{uuid.uuid4().hex}", None, 0
        out = None
        for batch in iterator:
            if not batch.num_rows:
                continue
            k, h, g = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("k", "h", "g"))
            first = int(k[0]) if first is None else first
            if (k != np.arange(first + count, first + count + len(k))).any():
                raise ValueError("the cells of a task must be consecutive")
            out = out or store.open_output_stream(name)
            cells = np.empty(len(k), CELL)
            cells["h"], cells["g"] = h, g
            out.write(cells.tobytes())
            count += len(k)
        if out:
            out.close()
        return Written(name if out else None, first or 0, count)

    def commit(self, messages: list) -> None:
        store, top = _store(self.path)
        parts = sorted((m.first, m.count, m.file) for m in messages if m and m.file)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(top, allow_not_found=True)):
                if f.base_name.startswith("cells-"):
                    store.delete_file(f.path)
        at = sum(n for _, _, n in _files(self.path)) if not self.overwrite and store.get_file_info(top).type == fs.FileType.Directory else 0
        if [p[0] for p in parts] != [at + sum(p[1] for p in parts[:k]) for k in range(len(parts))]:
            self.abort(messages)
            raise ValueError("the cells of all tasks must be consecutive")
        for first, _, file in parts:
            store.move(file, f"{top}/cells-{first:015d}")

    def abort(self, messages: list) -> None:
        store, _ = _store(self.path)
        for m in messages:
            if m and m.file and store.get_file_info(m.file).type == fs.FileType.File:
                store.delete_file(m.file)


class CellFiles(DataSource):
    """The format ``cells``."""

    @classmethod
    def name(cls) -> str:
        return "cells"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> CellReader:
        return CellReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> CellWriter:
        return CellWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(CellFiles)
    return spark


def write_cells(cells: DataFrame, path: str, mode: str = "append") -> None:
    """Rows (k, h, g) with k from 0 (or from where the folder's cells end) as cell files, dealt by ranges of k."""
    spark = register(cells.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cells.select("k", "h", "g").repartitionByRange(n, "k").sortWithinPartitions("k").write.format("cells").mode(mode).save(path)
