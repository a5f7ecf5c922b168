"""One binary file written and read by many tasks: a data source of byte ranges.

A writing task puts its bytes where running totals say they belong, in a staged file
of the final length that takes the file's name when all tasks are through. A task that
runs again puts the same bytes in the same place, so lost executors and doubled
tasks do no harm. A reading task serves its own range of bytes. Paths are folders that the
driver and all executors mount; object stores have no writes at an offset and are refused.
"""

from __future__ import annotations

import mmap
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "textloom_bytes"
SCHEMA = "i long, at long, size long, bytes binary"
#: Bytes of a reading task, of a piece of one long record, and rows of a batch.
SPLIT, PIECE, ROWS = 16 << 20, 65536, 8192
#: A piece also holds the byte before it and so many after it: the rest of a number that it cuts, and the next one.
AHEAD = 20


def mounted(path: str) -> str:
    """A path or file: URL as a path of the file system."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"{path}: a single file needs a mounted folder, not {url.scheme}:")
    return unquote(url.path) if url.scheme else path


@dataclass
class Wrote(WriterCommitMessage):
    length: int


class ByteWriter(DataSourceArrowWriter):
    """Writes rows (start long, bytes binary) into one file of `length` bytes; what no row covers is zero."""

    def __init__(self, options: dict[str, str]):
        self.path, self.length, self.whole = mounted(options["path"]), int(options["length"]), options.get("whole", "true") == "true"
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        self.staged = f"{self.path}.staged-{uuid.uuid4().hex}"
        with open(self.staged, "wb") as f:
            f.truncate(self.length)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        wrote = 0
        fd = os.open(self.staged, os.O_WRONLY)  # made by the driver: one that is not there is not a shared folder
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                start = batch.column("start").to_numpy(zero_copy_only=False)
                order = np.argsort(start, kind="stable")
                start, rows = start[order], batch.column("bytes").take(pa.array(order)).cast(pa.large_binary())
                at = np.frombuffer(rows.buffers()[1], dtype=np.int64)[rows.offset : rows.offset + len(rows) + 1]
                data, size = memoryview(rows.buffers()[2] or b""), np.diff(at)
                runs = [0, *(np.flatnonzero(start[1:] != start[:-1] + size[:-1]) + 1).tolist(), len(start)]
                for a, b in zip(runs, runs[1:]):
                    left, to = data[at[a] : at[b]], int(start[a])
                    while len(left):
                        n = os.pwrite(fd, left, to)
                        left, to, wrote = left[n:], to + n, wrote + n
            os.fsync(fd)
        finally:
            os.close(fd)
        return Wrote(wrote)

    def commit(self, messages: list[Wrote | None]) -> None:
        wrote = sum(m.length for m in messages if m)
        if self.whole and wrote != self.length:
            self.abort(messages)
            raise ValueError(f"{self.path}: {wrote} bytes were written of {self.length}")
        os.replace(self.staged, self.path)

    def abort(self, messages: list[Wrote | None]) -> None:
        if os.path.exists(self.staged):
            os.unlink(self.staged)


@dataclass
class Range(InputPartition):
    low: int
    high: int


class ByteReader(DataSourceReader):
    """Records of `record` bytes each, or as the numbers of `width` bytes in the file `offsets` part them (none of them empty)."""

    def __init__(self, options: dict[str, str]):
        self.path, self.record = mounted(options["path"]), int(options.get("record", 0))
        self.offsets, self.width = mounted(options["offsets"]) if "offsets" in options else "", int(options.get("width", 4))

    def partitions(self) -> list[Range]:
        size, step = os.path.getsize(self.path), max(1, SPLIT // self.record) * self.record if self.record else SPLIT
        return [Range(a, min(size, a + step)) for a in range(0, size, step)] or [Range(0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.low == partition.high:
            return
        with open(self.path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            yield from map(_batch, self._fixed(data, partition) if self.record else self._parted(data, partition))

    def _fixed(self, data: mmap.mmap, part: Range) -> Iterator[list[tuple]]:
        for a in range(part.low, part.high, ROWS * self.record):
            yield [(at // self.record, 0, self.record, data[at : at + self.record]) for at in range(a, min(part.high, a + ROWS * self.record), self.record)]

    def _parted(self, data: mmap.mmap, part: Range) -> Iterator[list[tuple]]:
        ends = np.memmap(self.offsets, dtype=f"<u{self.width}", mode="r")
        rows, held = [], 0
        for i in range(int(np.searchsorted(ends, part.low, "right")) - 1, len(ends) - 1):
            first, end = int(ends[i]), int(ends[i + 1])
            if first >= part.high:
                break
            skip = -(-max(0, part.low - first) // PIECE)
            for start in range(first + skip * PIECE, min(end, part.high), PIECE):
                rows.append((i, start - first, min(PIECE, end - start), data[start - (start > first) : min(end, start + PIECE + AHEAD)]))
                held += len(rows[-1][3])
                if len(rows) >= ROWS or held >= 4 << 20:
                    yield rows
                    rows, held = [], 0
        if rows:
            yield rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["i", "at", "size", "bytes"])


class ByteFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ByteReader:
        return ByteReader(self.options)

    def writer(self, schema, overwrite: bool) -> ByteWriter:
        return ByteWriter(self.options)


def write_bytes(rows: DataFrame, path: str, length: int, whole: bool = True) -> None:
    """Rows (start, bytes) as the one file `path`. With `whole`, bytes that are missing or written twice fail the job.

    The rows must be the same each time they are computed: read from a written table.
    """
    rows.sparkSession.dataSource.register(ByteFile)
    writer = rows.select(F.col("start").cast("long").alias("start"), "bytes").write.format(FORMAT).mode("overwrite")
    writer.option("length", length).option("whole", str(whole).lower()).save(path)


def read_bytes(spark: SparkSession, path: str, record: int | None = None, offsets: str | None = None, width: int = 4) -> DataFrame:
    """(i, at, size, bytes): records by number. A long record comes in pieces that begin at `at`; each but a record's first is led by the byte before it, and followed by AHEAD bytes."""
    spark.dataSource.register(ByteFile)
    load = spark.read.format(FORMAT).option("width", width)
    load = load.option("record", record) if record else load.option("offsets", offsets)
    return load.load(path)


def number_bytes(values: Column, kind: str) -> Column:
    """Numbers as the bytes of a little-endian numpy kind."""

    def run(x: pa.Array) -> pa.Array:
        data, width = x.to_numpy(zero_copy_only=False).astype(kind).tobytes(), np.dtype(kind).itemsize
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * width), pa.py_buffer(data)])

    return F.arrow_udf(run, "binary")(values)


def bytes_number(raw: Column, kind: str) -> Column:
    """The whole numbers of records of one number each."""

    def run(x: pa.Array) -> pa.Array:
        return pa.array(np.frombuffer(b"".join(x.to_pylist()), dtype=kind).astype(np.int64), pa.int64())

    return F.arrow_udf(run, "long")(raw)
