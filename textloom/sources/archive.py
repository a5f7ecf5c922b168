"""Zip archives and arrays of numbers as tables: data sources whose tasks each read their own range of bytes.

The driver plans from names and sizes of files alone. A task reads the members whose
record begins in its range, or the rows of an array that lie there. What cannot be
read is a row with its reason, so one bad archive does not end a job. Paths are folders
that the driver and all executors mount.
"""

from __future__ import annotations

import io
import os
import uuid
import warnings
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from textloom.functions.slices import by_rows
from textloom.operators.ranking import dense_ordinal, scratch
from textloom.sources.binary import mounted, write_bytes

ZIP, ARRAY = "textloom_zip", "textloom_array"
MEMBERS = pa.schema([("archive", pa.string()), ("member", pa.string()), ("size", pa.int64()), ("content", pa.binary()), ("error", pa.string())])
#: Bytes of a reading task, of a batch, of an archive before the next is begun, and of the longest member that a cell can hold.
SPLIT, BATCH, ARCHIVE, CELL = 16 << 20, 4 << 20, 1 << 30, (1 << 31) - (1 << 20)
#: Members of an archive before the next is begun: a task that writes or reads one holds its directory.
LISTED = 1 << 13
#: Fixed value: the first day that archives know, given to every member, so that equal rows give equal bytes.
DAY = (1980, 1, 1, 0, 0, 0)


def _put(z: zipfile.ZipFile, name: str, content: bytes, kind: int) -> None:
    info = zipfile.ZipInfo(name, DAY)
    info.compress_type = kind
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # names may repeat
        z.writestr(info, content)


def zipped(names: Column, contents: Column) -> Column:
    """A zip archive of one row's members: two arrays of one length; null for null."""

    def run(ns: list | None, cs: list | None) -> bytes | None:
        if ns is None or cs is None:
            return None
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w") as z:
            for name, content in zip(ns, cs):
                _put(z, name, content, zipfile.ZIP_DEFLATED)
        return raw.getvalue()

    return by_rows(run, "binary", pa.binary(), names, contents)


@dataclass
class Archives(WriterCommitMessage):
    staged: list[str]


class ZipWriter(DataSourceArrowWriter):
    """Rows (member string, content binary) into archives of the folder `path`, each task into its own."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite, self.run = mounted(options["path"]), overwrite, uuid.uuid4().hex
        self.kind = zipfile.ZIP_STORED if options.get("stored") == "true" else zipfile.ZIP_DEFLATED
        os.makedirs(self.path, exist_ok=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Archives:
        done, z = [], None
        for batch in iterator:
            for name, content in zip(batch.column("member").to_pylist(), batch.column("content")):
                if name is None or not content.is_valid:
                    continue
                if z is None:
                    done.append(f".{self.run}-{uuid.uuid4().hex}")
                    z = zipfile.ZipFile(f"{self.path}/{done[-1]}", "w")
                _put(z, name, content.as_buffer().to_pybytes(), self.kind)
                if z.fp.tell() >= ARCHIVE or len(z.infolist()) >= LISTED:
                    z.close()
                    z = None
        if z is not None:
            z.close()
        return Archives(done)

    def _clear(self) -> None:
        """Remove what tasks left that did not end, or ended twice."""
        for name in os.listdir(self.path):
            if name.startswith(f".{self.run}-"):
                os.unlink(f"{self.path}/{name}")

    def commit(self, messages: list[Archives | None]) -> None:
        old = [n for n in os.listdir(self.path) if n.startswith("part-") and n.endswith(".zip")] if self.overwrite else []
        for i, name in enumerate(n for m in messages if m for n in m.staged):
            os.replace(f"{self.path}/{name}", f"{self.path}/part-{self.run}-{i:05}.zip")
        for name in old:
            os.unlink(f"{self.path}/{name}")
        self._clear()

    def abort(self, messages: list[Archives | None]) -> None:
        self._clear()


@dataclass
class Ranges(InputPartition):
    parts: list[tuple[str, int, int]]


class ZipReader(DataSourceReader):
    """Members of one archive or of all `*.zip` in a folder; a task takes those whose record begins in its ranges."""

    def __init__(self, options: dict[str, str]):
        self.path = mounted(options["path"])

    def partitions(self) -> list[Ranges]:
        files = [self.path]
        if os.path.isdir(self.path):
            files = sorted(f"{at}/{n}" for at, _, names in os.walk(self.path) for n in names if n.lower().endswith(".zip") and not n.startswith("."))
        out, room = [], 0
        for f in files:
            size = os.path.getsize(f)
            for a in range(0, max(size, 1), SPLIT):
                part = (f, a, min(a + SPLIT, max(size, 1)))
                if part[2] - part[1] > room:
                    out.append(Ranges([]))
                    room = SPLIT
                out[-1].parts.append(part)
                room -= part[2] - part[1]
        return out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for row in self._rows(partition):
            rows.append(row)
            held += len(row[3] or b"") + 64
            if held >= BATCH:
                yield _members(rows)
                rows, held = [], 0
        if rows:
            yield _members(rows)

    def _rows(self, partition: Ranges) -> Iterator[tuple]:
        for file, low, high in partition.parts:
            name = os.path.basename(file)
            try:
                z = zipfile.ZipFile(file)
            except Exception as e:  # the reason is part of the record, told once
                if low == 0:
                    yield name, None, None, None, f"{type(e).__name__}: {e}"
                continue
            with z:
                for info in z.infolist():
                    if info.is_dir() or not low <= info.header_offset < high:
                        continue
                    try:
                        if info.file_size > CELL:
                            raise ValueError(f"{info.file_size} bytes are more than a cell holds")
                        yield name, info.filename, info.file_size, z.read(info), None
                    except Exception as e:
                        yield name, info.filename, info.file_size, None, f"{type(e).__name__}: {e}"


def _members(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), MEMBERS)], schema=MEMBERS)


class ZipSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return ZIP

    def schema(self) -> str:
        return "archive string, member string, size long, content binary, error string"

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)

    def writer(self, schema, overwrite: bool) -> ZipWriter:
        return ZipWriter(self.options, overwrite)


def write_members(rows: DataFrame, path: str, stored: bool = False) -> None:
    """Rows (member, content) as archives in the folder `path`, in place of those that an earlier call left there.

    Rows with a null name or content take no part; names may repeat. `stored` leaves members
    as they are, as for archives within archives. No rows give no archive.
    """
    rows.sparkSession.dataSource.register(ZipSource)
    rows.select("member", F.col("content").cast("binary").alias("content")).write.format(ZIP).mode("overwrite").option("stored", str(stored).lower()).save(path)


def read_members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, size, content, error): every member of an archive or of a folder of them.

    A member that cannot be read has null content and an error; a file that is no archive is one
    row without a member.
    """
    spark.dataSource.register(ZipSource)
    return spark.read.format(ZIP).load(path)


@dataclass
class Header:
    at: int
    rows: int
    width: int
    kind: np.dtype
    flat: bool


def header(path: str) -> Header:
    """Where the rows of an array's file begin, how many they are, and how many numbers of what kind each holds."""
    with open(path, "rb") as f:
        version = np.lib.format.read_magic(f)
        read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}.get(version)
        if read is None:
            raise ValueError(f"{path}: version {version} of the format is not known")
        shape, by_column, kind = read(f)
        if kind.hasobject or kind.kind not in "fiub" or not shape:
            raise ValueError(f"{path}: rows of numbers are read, not {kind} of shape {shape}")
        if by_column and len(shape) > 1:
            raise ValueError(f"{path}: stands by columns, so no row is a range of bytes")
        return Header(f.tell(), shape[0], int(np.prod(shape[1:], dtype=np.int64)), kind, len(shape) == 1)


def _cell(kind: np.dtype) -> tuple[str, type]:
    """The column type that holds a kind of number without loss (but the top half of unsigned 64-bit numbers), and its own kind."""
    if kind.kind == "b":
        return "boolean", np.bool_
    if kind.kind == "f":
        return ("float", np.float32) if kind.itemsize <= 4 else ("double", np.float64)
    return ("int", np.int32) if kind.itemsize < 4 or kind == np.int32 else ("long", np.int64)


class ArrayReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = mounted(options["path"])

    def partitions(self) -> list[Ranges]:
        h = header(self.path)
        step = max(1, SPLIT // max(1, h.width * h.kind.itemsize))
        return [Ranges([("", a, min(h.rows, a + step))]) for a in range(0, h.rows, step)] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        h = header(self.path)
        size = h.width * h.kind.itemsize
        step, own = max(1, BATCH // max(1, size)), _cell(h.kind)[1]
        with open(self.path, "rb") as f:
            for _, low, high in partition.parts:
                f.seek(h.at + low * size)
                for a in range(low, high, step):
                    n = min(step, high - a)
                    raw = f.read(n * size)
                    if len(raw) < n * size:
                        raise ValueError(f"{self.path}: ends within row {a + len(raw) // size} of {h.rows}")
                    v = pa.array(np.frombuffer(raw, h.kind).astype(own))
                    if not h.flat:
                        v = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * h.width), v)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + n)), v], names=["i", "v"])


class ArraySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return ARRAY

    def schema(self) -> str:
        h = header(mounted(self.options["path"]))
        kind = _cell(h.kind)[0]
        return f"i long, v {kind}" if h.flat else f"i long, v array<{kind}>"

    def reader(self, schema) -> ArrayReader:
        return ArrayReader(self.options)


def read_array(spark: SparkSession, path: str) -> DataFrame:
    """(i, v): the rows of an npy file by number; v is a number, or an array of what all further dimensions hold."""
    spark.dataSource.register(ArraySource)
    return spark.read.format(ARRAY).load(path)


def _row_bytes(v: Column, kind: str) -> Column:
    def run(x: pa.Array) -> pa.Array:
        return pa.array([np.asarray(r, dtype=kind).tobytes() for r in x.to_pylist()], pa.binary())

    return F.arrow_udf(run, "binary")(v)


def write_array(rows: DataFrame, path: str, dims: int, kind: str = "<f4") -> None:
    """Rows (i, v) as one npy file in order of `i`, which tells rows apart, and the ids in another beside it, `<path>.ids.npy`.

    Rows with a null id, a null vector, one of another length or one that holds a null take no part.
    No rows give an array of none.
    """
    at = mounted(path)
    whole = F.col("i").isNotNull() & (F.size("v") == dims) & ~F.exists("v", lambda x: x.isNull())
    kept = scratch(dense_ordinal(rows.where(whole).select(F.col("i").cast("long").alias("i"), "v"), [F.col("i")], "no"), "array")
    n = kept.count()
    for file, shape, form, value in ((at, (n, dims), kind, F.col("v")), (f"{at}.ids.npy", (n,), "<i8", F.array("i"))):
        raw = io.BytesIO()
        np.lib.format.write_array_header_1_0(raw, {"descr": form, "fortran_order": False, "shape": shape})
        head, size = raw.getvalue(), np.dtype(form).itemsize * (dims if len(shape) > 1 else 1)
        first = rows.sparkSession.createDataFrame([(0, bytearray(head))], "start long, bytes binary")
        body = kept.select((F.col("no") * size + len(head)).alias("start"), _row_bytes(value, form).alias("bytes"))
        write_bytes(first.unionByName(body), file, len(head) + n * size)
