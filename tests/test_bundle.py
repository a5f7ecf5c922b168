"""Single-file bundles: bytes as a serial writer gives them, and read back."""

import random
import struct

import numpy as np
import pytest

from textloom.operators import search
from textloom.sources import binary, bundle, sinks


def serial(tf, docs):
    """The files of the index, written by one process."""
    number = {d: i for i, d in enumerate(sorted(docs))}
    lists = {}
    for d, t, n in tf:
        lists.setdefault(t, []).append((number[d], n))
    raw, offsets = b"", [0]
    for t in sorted(lists):
        raw += sinks.encode_varint(len(lists[t]))
        last = 0
        for d, n in sorted(lists[t]):
            raw += sinks.encode_varint(d - last) + sinks.encode_varint(min(n, 65535))
            last = d
        offsets.append(len(raw))
    lengths = [min(docs[d], 65535) for d in sorted(docs)]
    return raw, struct.pack(f"<{len(offsets)}I", *offsets), "\n".join(sorted(lists)).encode(), struct.pack(f"<{len(lengths)}H", *lengths)


@pytest.mark.parametrize("piece, split", [(65536, 16 << 20), (7, 64), (1, 5)])
def test_index_is_that_of_a_serial_writer(spark, tmp_path, monkeypatch, piece, split):
    rnd = random.Random(piece)
    docs = {rnd.randint(-5, 10**12): 0 for _ in range(400)}
    tf = [(d, t, rnd.choice([1, 2, 200, 70_000])) for d in docs for t in rnd.sample(["a", "all", "é", "海空", "𠮷", "z", "lang"], 3)] + [(min(docs), "once", 1)]
    for d, _, n in tf:
        docs[d] += n
    path = f"file://{tmp_path}/ix"
    rows = spark.createDataFrame(tf, "doc long, term string, tf long")
    meta = bundle.write_index(rows, spark.createDataFrame([*docs.items(), (None, 5)], "doc long, dl long"), path)
    got = tuple((tmp_path / "ix" / f).read_bytes() for f in (bundle.POSTINGS, bundle.OFFSETS, bundle.TERMS, bundle.DOCS))
    assert got == serial(tf, docs) and meta["n_terms"] == len({t for _, t, _ in tf}) and meta["n_docs"] == len(docs)
    assert not [f for f in (tmp_path / "ix").iterdir() if "staged" in f.name]
    # Tasks read a module of their own, so pieces of other lengths are tried on the reader itself.
    monkeypatch.setattr(binary, "PIECE", piece), monkeypatch.setattr(binary, "SPLIT", split)
    reader = binary.ByteReader({"path": f"{tmp_path}/ix/{bundle.POSTINGS}", "offsets": f"{tmp_path}/ix/{bundle.OFFSETS}"})
    pieces = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    values = {}
    for r in sorted(pieces, key=lambda r: (r["i"], r["at"])):
        v, n = bundle.piece_numbers(r["bytes"], r["at"], r["size"])
        values.setdefault(r["i"], []).extend(v[:n].tolist())
    ends = np.frombuffer(got[1], "<u4")
    assert values == {i: sinks.decode_varints(got[0][a:b]) for i, (a, b) in enumerate(zip(ends, ends[1:]))}
    assert sorted(map(tuple, bundle.read_index(spark, path).collect())) == sorted((t, d, min(n, 65535)) for d, t, n in tf)
    assert sorted(map(tuple, bundle.read_lengths(spark, path).collect())) == sorted((d, min(n, 65535)) for d, n in docs.items())


def test_a_list_of_many_pieces(spark, tmp_path):
    """One term in 60,000 documents: more than one piece, whose cut falls anywhere."""
    tf = spark.range(60_000).selectExpr("id * 3 as doc", "'hot' as term", "id % 300 + 1 as tf")
    bundle.write_index(tf, search.doc_lengths(tf, tf, "doc"), str(tmp_path))
    assert (tmp_path / bundle.POSTINGS).stat().st_size > binary.PIECE
    assert bundle.read_index(spark, str(tmp_path)).exceptAll(tf.select("term", "doc", "tf")).count() == 0
    assert bundle.read_index(spark, str(tmp_path)).count() == 60_000


def test_empty_index_and_missing_bytes(spark, tmp_path):
    bundle.write_index(spark.createDataFrame([], "doc long, term string, tf long"), spark.createDataFrame([], "doc long, dl long"), str(tmp_path))
    assert bundle.read_index(spark, str(tmp_path)).count() == 0 and (tmp_path / bundle.OFFSETS).read_bytes() == b"\0\0\0\0"
    rows = spark.createDataFrame([(0, b"ab"), (3, b"c")], "start long, bytes binary")
    with pytest.raises(Exception, match="3 bytes were written of 4"):
        binary.write_bytes(rows, f"{tmp_path}/x", 4)
    assert not [f for f in tmp_path.iterdir() if f.name.startswith("x")]
    binary.write_bytes(rows, f"{tmp_path}/x", 4, whole=False)
    assert (tmp_path / "x").read_bytes() == b"ab\0c"
    with pytest.raises(ValueError):
        binary.mounted("s3://bucket/x")


def test_vectors_in_one_file(spark, tmp_path):
    v = np.random.default_rng(2).normal(size=(50, 6))
    rows = [(i * 7, f"w{i % 3}", v[i].tolist(), i) for i in range(50)] + [(None, "w", v[0].tolist(), 0), (1, "w", None, 0), (2, "w", [1.0], 0)]
    (tmp_path / bundle.PROJECTION).write_bytes(b"old")
    bundle.write_vectors(spark.createDataFrame(rows, "i long, work string, v array<double>, p long"), str(tmp_path), 6, ("p",))
    assert (tmp_path / bundle.VECTORS).read_bytes() == v.astype("<f2").tobytes() and not (tmp_path / bundle.PROJECTION).exists()
    back = {r.no: r.v for r in bundle.read_vectors(spark, str(tmp_path)).collect()}
    assert np.array_equal([back[i] for i in range(50)], v.astype("<f2").astype("f4"))
    index = spark.read.json(f"{tmp_path}/{bundle.INDEX}").first()
    assert index.id == [i * 7 for i in range(50)] and index.works == ["w0", "w1", "w2"] and index.p == list(range(50))
    assert sorted(map(tuple, bundle.read_vector_index(spark, str(tmp_path)).collect())) == [(i, i * 7) for i in range(50)]
