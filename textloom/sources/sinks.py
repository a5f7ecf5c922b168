"""Sinks: binary posting lists and vectors, parallel arrays, JSON shards, CSV with a mark, reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.ranking import dense_ordinal, running_total, scratch

MOST_TF = 65535
#: Chunks of one row of parallel arrays.
ARRAYS = 65536


def encode_varint(n: int) -> bytes:
    """Seven bits a byte, the lowest first, the top bit for more to come."""
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def decode_varints(raw: bytes) -> list[int]:
    out, n, shift = [], 0, 0
    for b in raw:
        n |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            out.append(n)
            n = shift = 0
    return out


def varints(values: Column) -> Column:
    """An array of integers as one varint string."""
    return F.udf(lambda xs: None if xs is None else b"".join(map(encode_varint, xs)), "binary", useArrow=True)(values)


def unpack_varints(raw: Column) -> Column:
    return F.udf(lambda b: None if b is None else decode_varints(bytes(b)), "array<long>", useArrow=True)(raw)


def packed_varints(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of numbers one after the other, and how many each has: `encode_varint` of a whole array."""
    if len(v) and v.min() < 0:
        raise ValueError("a varint is no negative number")
    many = np.ones(len(v), dtype=np.int64)
    for k in range(1, 9):
        many += v >= 1 << (7 * k)
    start = np.cumsum(many) - many
    out = np.empty(int(many.sum()), dtype=np.uint8)
    for k in range(int(many.max(initial=0))):
        some = np.flatnonzero(many > k)
        out[start[some] + k] = (v[some] >> (7 * k)) & 0x7F | np.where(many[some] > k + 1, 0x80, 0)
    return out, many


def unpacked_varints(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of bytes, and where each ends: `decode_varints` of a whole array."""
    last = np.flatnonzero(raw < 0x80)
    if not len(last):
        return np.zeros(0, dtype=np.int64), last
    begin = np.concatenate([[0], last[:-1] + 1])
    here = raw[: last[-1] + 1].astype(np.int64)
    return np.add.reduceat((here & 0x7F) << (7 * (np.arange(len(here)) - np.repeat(begin, last - begin + 1))), begin), last + 1


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _encoded(lists: pa.Array, base: pa.Array, df: pa.Array, block: pa.Array) -> pa.Array:
    n = pc.list_value_length(lists).to_numpy().astype(np.int64)
    posting = pc.list_flatten(lists)
    doc, tf = (pc.cast(posting.field(i), pa.int64()).to_numpy() for i in (0, 1))
    gap, at = np.diff(doc, prepend=0), _starts(n)
    gap[at[:-1]] = doc[at[:-1]] - base.to_numpy()  # a block holds a posting at least
    head = (block.to_numpy() == 0).astype(np.int64)
    to = _starts(2 * n + head)
    place = np.repeat((to[:-1] + head) - 2 * at[:-1], n) + 2 * np.arange(len(doc))
    v = np.empty(to[-1], dtype=np.int64)
    v[to[:-1][head > 0]] = df.to_numpy()[head > 0]
    v[place], v[place + 1] = gap, np.minimum(tf, MOST_TF)
    raw, many = packed_varints(v)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(_starts(many)[to].astype("<i4").tobytes()), pa.py_buffer(raw.tobytes())])


def encode_postings(postings: DataFrame) -> DataFrame:
    """(term, block, df, base, bytes): df before the first block, then each document as its gap and its capped frequency.

    The bytes of a term's blocks in order are its whole list.
    """
    return postings.select("term", "block", "df", "base", F.arrow_udf(_encoded, "binary")("postings", F.col("base").cast("long"), F.col("df").cast("long"), F.col("block").cast("long")).alias("bytes"))


def _decoded(raws: pa.Array, base: pa.Array, block: pa.Array) -> pa.Array:
    size = pc.binary_length(raws).to_numpy().astype(np.int64)
    v, end = unpacked_varints(np.frombuffer(b"".join(raws.to_pylist()), dtype=np.uint8))
    first = np.searchsorted(end, _starts(size), "right")  # the numbers of each row
    head = (block.to_numpy() == 0).astype(np.int64)
    n = (np.diff(first) - head) // 2
    at = _starts(n)
    place = np.repeat(first[:-1] + head - 2 * at[:-1], n) + 2 * np.arange(at[-1])
    doc = np.cumsum(v[place])
    doc += np.repeat(base.to_numpy() - np.concatenate([[0], doc])[at[:-1]], n)
    posting = pa.StructArray.from_arrays([pa.array(doc), pa.array(v[place + 1])], ["doc", "tf"])
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), posting)


def decode_postings(encoded: DataFrame) -> DataFrame:
    """(term, doc, tf) from the bytes of each block and the document before it."""
    lists = F.arrow_udf(_decoded, "array<struct<doc:long,tf:long>>")("bytes", F.col("base").cast("long"), F.col("block").cast("long"))
    return encoded.select("term", F.explode(lists).alias("p")).select("term", "p.doc", "p.tf")


def with_offsets(encoded: DataFrame) -> DataFrame:
    """Encoded postings with each block's byte offset in the file of all terms in order; a term starts where its first block does."""
    size = F.octet_length("bytes").cast("long")
    return running_total(encoded, [F.col("term"), F.col("block")], size, "start").withColumn("end", F.col("start") + size)


def write_index(postings: DataFrame, lengths: DataFrame, path: str) -> None:
    """The index as tables: postings by term with offsets, and document lengths capped to 16 bits."""
    with_offsets(encode_postings(postings)).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    lengths.select("doc", F.least("dl", F.lit(MOST_TF)).alias("dl")).write.mode("overwrite").parquet(f"{path}/lengths")


def parallel_arrays(chunks: DataFrame, works: str = "work", order: str = "i", cols: tuple[str, ...] = ("para_start", "para_end", "len"), block: int = ARRAYS) -> DataFrame:
    """(block, works, w, *cols): parallel arrays in order of `order`, which tells rows apart: the compact client index.

    Works are numbers in order of first use. A row holds at most `block` chunks, and the names
    of works that are first used there; the arrays of the blocks in order, put together, are the whole.
    """
    placed = scratch(dense_ordinal(chunks.select(works, order, *cols), [F.col(order)], "_at"), "placed")
    nth = lambda c: F.floor(F.col(c) / block).alias("block")
    first = placed.groupBy(works).agg(F.min("_at").alias("_first"))
    numbered = scratch(dense_ordinal(first, [F.col("_first")], "w").select(F.col(works).alias("_work"), "_first", F.col("w").cast("int").alias("w")), "numbered")
    rows = placed.join(numbered, F.col(works).eqNullSafe(F.col("_work")))
    lists = rows.groupBy(nth("_at")).agg(F.sort_array(F.collect_list(F.struct("_at", "w", *cols))).alias("x"))
    names = numbered.groupBy(nth("_first")).agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "_work"))), lambda s: s["_work"]).alias("works"))
    column = lambda c: F.transform("x", lambda s: s[c]).alias(c)
    none = F.array().cast(names.schema["works"].dataType)
    return lists.join(names, "block", "left").select("block", F.coalesce("works", none).alias("works"), *[column(c) for c in ("w", *cols)])


def write_shards(rows: DataFrame, path: str, by: str) -> None:
    """JSON shards, a folder for each value."""
    rows.write.mode("overwrite").partitionBy(by).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header and a byte order mark before its first name."""
    first, *rest = rows.columns
    rows.select(F.col(first).alias("﻿" + first), *rest).write.mode("overwrite").csv(path, header=True)


def union_of_keys(records: DataFrame, order: list[Column], fields: str) -> list[str]:
    """The keys of the map column `fields` in order of first use, by `order`, then by place in the map. As many as a table has columns, so few."""
    each = records.select(F.struct(*order).alias("_at"), F.posexplode(F.map_keys(fields)).alias("_i", "key"))
    return [r["key"] for r in each.groupBy("key").agg(F.min(F.struct("_at", "_i")).alias("_at")).orderBy("_at", "key").collect()]


def flat_records(records: DataFrame, order: list[Column], fields: str) -> DataFrame:
    """The other columns, then one for each key of the map column `fields`, null where a record lacks it."""
    rest = [F.col(f"`{c}`") for c in records.columns if c != fields]
    return records.select(*rest, *[F.try_element_at(fields, F.lit(k)).alias(k) for k in union_of_keys(records, order, fields)])


def markdown(rows: DataFrame, title: str, most: int = 1000) -> str:
    """A report of at most `most` rows as a table; a last line says so if there are more."""
    head = f"# {title}\n\n| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    got = rows.limit(most + 1).collect()
    more = [f"\nOnly the first {most} rows are shown."] if len(got) > most else []
    return "\n".join([head, *("| " + " | ".join(map(str, r)) + " |" for r in got[:most]), *more]) + "\n"
