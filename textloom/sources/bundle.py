"""The files that a client loads: a search index and half-precision vectors, each a single file of bytes with offsets beside it."""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import search
from textloom.operators.ranking import dense_ordinal, running_total, scratch
from textloom.operators.vectors import from_f16, to_f16
from textloom.sources.binary import bytes_number, mounted, number_bytes, read_bytes, write_bytes
from textloom.sources.sinks import ARRAYS, MOST_TF, encode_postings, parallel_arrays

# Names of the files of a bundle.
TERMS, OFFSETS, POSTINGS, DOCS, META = "bm25_terms.txt", "bm25_offsets.bin", "bm25_postings.bin", "bm25_docs.bin", "bm25_meta.json"
VECTORS, INDEX, PROJECTION = "chunk_vectors.f16", "chunk_index.json", "chunk_projection.f32"
#: Places of terms in their file and the ids of numbered documents, which a client may do without.
TERM_OFFSETS, IDS = "bm25_term_offsets.bin", "bm25_ids.bin"


def _offsets(starts: DataFrame, count: int, total: int, path: str) -> int:
    """Write starts (i, start) and the total as `count` + 1 numbers, of 4 bytes while the total fits them, else of 8; gives their width."""
    width = 4 if total < 1 << 32 else 8
    end = starts.sparkSession.range(1).select(F.lit(count).cast("long").alias("i"), F.lit(total).cast("long").alias("start"))
    rows = starts.select("i", "start").unionByName(end)
    write_bytes(rows.select((F.col("i") * width).alias("start"), number_bytes(F.col("start"), f"<u{width}").alias("bytes")), path, width * (count + 1))
    return width


def write_index(tf: DataFrame, lengths: DataFrame, path: str) -> dict:
    """Write the index of tf (doc, term, tf) and lengths (doc, dl) into the folder `path`, and give its meta data.

    Documents are numbered in order of their ids, which tell them apart; null ids take no part, and
    neither do postings of documents without a length. Terms stand in order of their code
    points, one a line. A term's bytes are its number of documents, then each document's
    distance from the one before (the first from 0) and its frequency, as varints.
    Frequencies and lengths stop at 65,535. No documents give files without records.
    """
    docs = numbered(lengths)
    named = tf.where("term is not null").join(docs.select(F.col("doc").alias("_doc"), "no"), F.col("doc") == F.col("_doc"))
    return write_numbered(named.select("term", F.col("no").alias("doc"), "tf"), docs, path)


def numbered(lengths: DataFrame) -> DataFrame:
    """(doc, dl, no), stored: documents with their number in order of their ids."""
    return scratch(dense_ordinal(lengths.where("doc is not null"), [F.col("doc")], "no"), "docs")


def write_numbered(tf: DataFrame, docs: DataFrame, path: str) -> dict:
    """`write_index` of postings that hold a document's number of `docs` (see `numbered`) for its id, so that none is shuffled to get it."""
    at = mounted(path)
    size = F.octet_length("bytes").cast("long")
    encoded = scratch(encode_postings(search.postings(tf)).select("term", "block", "bytes"), "encoded")
    blocks = scratch(running_total(encoded, [F.col("term"), F.col("block")], size, "start"), "blocks")
    terms = running_total(blocks.where("block = 0").select("term", "start"), [F.col("term")], F.octet_length("term") + 1, "line")
    terms = scratch(dense_ordinal(terms, [F.col("term")], "i"), "terms")

    n = docs.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dl"), 3).alias("avgdl")).first()
    many, line = terms.agg(F.count(F.lit(1)), F.max(F.col("line") + F.octet_length("term") + 1)).first()
    total = blocks.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    write_bytes(blocks, f"{at}/{POSTINGS}", total)
    width = _offsets(terms, many, total, f"{at}/{OFFSETS}")
    write_bytes(terms.select(F.col("line").alias("start"), F.concat("term", F.when(F.col("i") < many - 1, "\n").otherwise("")).cast("binary").alias("bytes")), f"{at}/{TERMS}", (line or 1) - 1)
    line_width = _offsets(terms.select("i", F.col("line").alias("start")), many, (line or 1) - 1, f"{at}/{TERM_OFFSETS}")
    write_bytes(docs.select((F.col("no") * 2).alias("start"), number_bytes(F.least("dl", F.lit(MOST_TF)), "<u2").alias("bytes")), f"{at}/{DOCS}", 2 * n["n"])
    write_bytes(docs.select((F.col("no") * 8).alias("start"), number_bytes(F.col("doc"), "<i8").alias("bytes")), f"{at}/{IDS}", 8 * n["n"])
    meta = {"n_docs": n["n"], "avgdl": n["avgdl"] or 0.0, "n_terms": many, "k1": search.K1, "b": search.B, "offset_bytes": width, "term_offset_bytes": line_width}
    _put(f"{at}/{META}", meta)
    return meta


def _put(path: str, content: dict) -> None:
    with open(f"{path}.staged", "w", encoding="utf-8") as f:
        json.dump(content, f, ensure_ascii=False)
    os.replace(f"{path}.staged", path)


def _get(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def piece_numbers(raw: bytes, at: int, size: int) -> tuple[np.ndarray, int]:
    """The varints that begin in a piece (see `read_bytes`), with the one after them if there is one, and how many are its own."""
    b = np.frombuffer(raw, dtype=np.uint8)
    last = np.flatnonzero(b < 0x80)  # a varint cut off at the end is left out: it lies beyond what the piece needs
    begin = np.concatenate([[0], last[:-1] + 1]) if len(last) else np.zeros(0, dtype=np.int64)
    own = begin - (at > 0)
    if at > 0:  # what begins with the byte before is not of this piece
        begin, last, own = begin[own >= 0], last[own >= 0], own[own >= 0]
    n = int((own < size).sum())
    begin, last = begin[: n + 1], last[: n + 1]
    if not len(begin):
        return np.zeros(0, dtype=np.int64), 0
    low = int(begin[0])
    here = b[low : last[-1] + 1].astype(np.int64)
    shift = 7 * (np.arange(len(here)) - np.repeat(begin - low, last - begin + 1))
    return np.add.reduceat((here & 0x7F) << shift, begin - low), n


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows) if rows else [], pa.int64()))


def _numbers(raw: Column, at: Column, size: Column) -> Column:
    """struct(v, n, s0, s1): a piece's numbers, how many are its own, and the sums of its own in even and odd places."""
    kind = pa.struct([("v", pa.list_(pa.int64())), ("n", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64())])

    def run(raws: pa.Array, ats: pa.Array, sizes: pa.Array) -> pa.Array:
        found = [piece_numbers(r, a, s) for r, a, s in zip(raws.to_pylist(), ats.to_pylist(), sizes.to_pylist())]
        sums = [pa.array([int(v[at:n:2].sum()) for v, n in found], pa.int64()) for at in (0, 1)]
        return pa.StructArray.from_arrays([_lists([v for v, _ in found]), pa.array([n for _, n in found], pa.int64()), *sums], fields=list(kind))

    return F.arrow_udf(run, "struct<v:array<long>,n:long,s0:long,s1:long>")(raw, at, size)


def _placed(v: Column, n: Column, odd: Column, base: Column) -> Column:
    """Postings (doc, tf) of a piece: its gaps stand in odd places of the record, which begin at place `odd` of the piece."""
    kind = pa.list_(pa.struct([("no", pa.int64()), ("tf", pa.int64())]))

    def run(vs: pa.Array, ns: pa.Array, odds: pa.Array, bases: pa.Array) -> pa.Array:
        no, tf = [], []
        for x, m, first, b in zip(vs, ns.to_pylist(), odds.to_pylist(), bases.to_pylist()):
            x = x.values.to_numpy()
            no.append(b + np.cumsum(x[first:m:2]))
            tf.append(x[first + 1 : m + 1 : 2])
        no, tf = _lists(no), _lists(tf)
        return pa.ListArray.from_arrays(no.offsets, pa.StructArray.from_arrays([no.values, tf.values], fields=list(kind.value_type)))

    return F.arrow_udf(run, "array<struct<no:long,tf:long>>")(v, n, odd, base)


def read_index(spark: SparkSession, path: str, lengths: bool = False) -> DataFrame:
    """(term, doc, tf) from the files of an index, and dl with `lengths`.

    A long list is read in pieces by several tasks; sums of the pieces before say where each goes on.
    """
    at, meta = mounted(path), _get(f"{mounted(path)}/{META}")
    raw = read_bytes(spark, f"{at}/{POSTINGS}", offsets=f"{at}/{OFFSETS}", width=meta["offset_bytes"])
    pieces = raw.select("i", "at", _numbers(F.col("bytes"), F.col("at"), F.col("size")).alias("x")).select("i", "at", "x.*")
    before = Window.partitionBy("i").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("odd", 1 - F.coalesce(F.sum("n").over(before), F.lit(0)) % 2)
    # The first number of a record is in an even place, as is each frequency; so all sums of odd places are of gaps.
    pieces = pieces.withColumn("base", F.coalesce(F.sum(F.when(F.col("odd") == 1, F.col("s1")).otherwise(F.col("s0"))).over(before), F.lit(0)))
    lines = read_bytes(spark, f"{at}/{TERMS}", offsets=f"{at}/{TERM_OFFSETS}", width=meta["term_offset_bytes"])
    own = F.when(F.col("at") == 0, F.expr("substring(bytes, 1, int(size))")).otherwise(F.expr("substring(bytes, 2, int(size))"))
    whole = lines.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("at", own.alias("b")))).alias("x"))  # pieces of one term
    terms = whole.select("i", F.rtrim(F.aggregate("x", F.lit(b""), lambda a, s: F.concat(a, s["b"])).cast("string"), F.lit("\n")).alias("term"))
    # Pieces get their term before their postings are told apart.
    each = pieces.join(terms, "i").select("term", F.explode(_placed(F.col("v"), F.col("n"), F.col("odd"), F.col("base"))).alias("p")).select("term", "p.*")
    docs = read_bytes(spark, f"{at}/{IDS}", record=8).select(F.col("i").alias("no"), bytes_number(F.col("bytes"), "<i8").alias("doc"))
    if lengths:
        docs = docs.join(read_bytes(spark, f"{at}/{DOCS}", record=2).select(F.col("i").alias("no"), bytes_number(F.col("bytes"), "<u2").alias("dl")), "no")
    return each.join(docs, "no").select("term", "doc", "tf", *(["dl"] if lengths else []))


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """(doc, dl) from the files of an index."""
    at = mounted(path)
    ids = read_bytes(spark, f"{at}/{IDS}", record=8).select("i", bytes_number(F.col("bytes"), "<i8").alias("doc"))
    return ids.join(read_bytes(spark, f"{at}/{DOCS}", record=2).select("i", bytes_number(F.col("bytes"), "<u2").alias("dl")), "i").select("doc", "dl")


def write_vectors(rows: DataFrame, path: str, dims: int, cols: tuple[str, ...] = ()) -> None:
    """Rows (i, work, v, *cols) as one file of half-precision numbers in order of `i`, which tells rows apart, with parallel arrays (`id` is i) beside it.

    Rows with a null id, a null vector or one of another length take no part. A projection that an earlier bundle left there is removed.
    """
    at = mounted(path)
    kept = scratch(dense_ordinal(rows.where(F.col("i").isNotNull() & (F.size("v") == dims)).select("i", "work", "v", *cols), [F.col("i")], "no"), "vectors")
    n = kept.count()
    write_bytes(kept.select((F.col("no") * (2 * dims)).alias("start"), to_f16(F.col("v")).alias("bytes")), f"{at}/{VECTORS}", 2 * dims * n)
    parallel_arrays(kept.withColumnRenamed("i", "id"), "work", "no", ("id", *cols)).write.mode("overwrite").json(f"file://{at}/{INDEX}")
    _put(f"{at}/chunk_meta.json", {"dims": dims, "dtype": "float16", "n": n})
    if os.path.exists(f"{at}/{PROJECTION}"):
        os.unlink(f"{at}/{PROJECTION}")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(no, v) from the file of vectors; `no` is the place in the parallel arrays."""
    at = mounted(path)
    raw = read_bytes(spark, f"{at}/{VECTORS}", record=2 * _get(f"{at}/chunk_meta.json")["dims"])
    return raw.select(F.col("i").alias("no"), from_f16(F.col("bytes")).alias("v"))


def read_vector_index(spark: SparkSession, path: str) -> DataFrame:
    """(no, id) from the parallel arrays."""
    return spark.read.json(f"file://{mounted(path)}/{INDEX}").select("block", F.posexplode("id").alias("p", "id")).select((F.col("block") * ARRAYS + F.col("p")).alias("no"), "id")
