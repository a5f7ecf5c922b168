"""Archives and arrays: written by many tasks, read in ranges, failures kept as rows."""

import io
import os
import zipfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.operators import mentions
from textloom.sources import archive, readers, sinks


def test_members_come_back(spark, tmp_path):
    rows = [(f"{k % 50}.bin", bytes([k % 256]) * (k * 37 % 5000)) for k in range(300)] + [(None, b"x"), ("null", None), ("empty", b"")]
    df = spark.createDataFrame(rows, "member string, content binary").repartition(5)
    want = sorted((n, c) for n, c in rows if n is not None and c is not None)
    for _ in range(2):  # the second time in place of the first
        archive.write_members(df, str(tmp_path / "a"))
        got = archive.read_members(spark, str(tmp_path / "a")).collect()
        assert sorted((r.member, bytes(r.content)) for r in got) == want and all(r.error is None and r.size == len(r.content) for r in got)
    assert all(n.startswith("part-") for n in os.listdir(tmp_path / "a"))
    archive.write_members(df.limit(0), str(tmp_path / "a"))
    assert archive.read_members(spark, str(tmp_path / "a")).count() == 0


@pytest.mark.parametrize("split", [1, 100, 1000])
def test_every_member_is_read_by_one_task(tmp_path, split, monkeypatch):
    monkeypatch.setattr(archive, "SPLIT", split)
    for k in range(3):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            for i in range(20):
                z.writestr(f"{k}-{i}", os.urandom(i * 13))
    reader = archive.ZipReader({"path": str(tmp_path)})
    names = [n for p in reader.partitions() for b in reader.read(p) for n in b.column("member").to_pylist()]
    assert sorted(names) == sorted(f"{k}-{i}" for k in range(3) for i in range(20))


def test_bad_archives_are_rows(spark, tmp_path):
    (tmp_path / "none.zip").write_bytes(b"this is no archive")
    (tmp_path / "zero.zip").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"not looked at")
    with zipfile.ZipFile(tmp_path / "cut.zip", "w") as z:
        z.writestr("bad", b"0123456789" * 50)
        z.writestr("good", b"whole")
        z.mkdir("folder")
    raw = bytearray((tmp_path / "cut.zip").read_bytes())
    raw[60] ^= 255  # within the first member
    (tmp_path / "cut.zip").write_bytes(raw)
    got = {(r.archive, r.member): r for r in archive.read_members(spark, str(tmp_path)).collect()}
    assert set(got) == {("none.zip", None), ("zero.zip", None), ("cut.zip", "bad"), ("cut.zip", "good")}
    assert got["cut.zip", "good"].content == b"whole" and got["cut.zip", "good"].error is None
    assert all(got[k].content is None and got[k].error.startswith("BadZipFile") for k in got if k != ("cut.zip", "good"))


def test_one_text_member(spark):
    rows = [("one", ["a.txt", "b.png"], [b"words", b"\x00"]), ("none", ["b.png"], [b""]), ("two", ["a.txt", "b.TXT"], [b"a", b"b"]), ("null", None, None)]
    df = spark.createDataFrame(rows, "k string, n array<string>, c array<binary>").select("k", archive.zipped(F.col("n"), F.col("c")).alias("z"))
    got = {r.k: r.x for r in df.select("k", readers.extract_text(F.col("z")).alias("x")).collect()}
    assert (got["one"].text, got["one"].member) == ("words", "a.txt") and got["none"].error == "0 text members" and got["two"].error == "2 text members"
    assert got["null"].text is None and got["null"].error


@pytest.mark.parametrize("kind", ["<f2", "<f4", ">f8", "i1", "<u2", "<i8", "?"])
def test_arrays_of_each_kind(spark, tmp_path, kind, monkeypatch):
    monkeypatch.setattr(archive, "SPLIT", 64)
    a = (np.arange(3 * 7 * 2) % 100).reshape(7, 3, 2).astype(kind)
    np.save(tmp_path / "a.npy", a)
    got = archive.read_array(spark, str(tmp_path / "a.npy")).orderBy("i").collect()
    assert [r.i for r in got] == list(range(7)) and [r.v for r in got] == a.reshape(7, 6).tolist()
    np.save(tmp_path / "b.npy", a[:, 0, 0])
    assert [r.v for r in archive.read_array(spark, str(tmp_path / "b.npy")).orderBy("i").collect()] == a[:, 0, 0].tolist()


def test_written_arrays_are_read_by_numpy(spark, tmp_path):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(200, 5)).astype("f4")
    rows = [(int(k * 3), v[k].tolist()) for k in rng.permutation(200)] + [(None, [0.0] * 5), (1, None), (2, [1.0]), (4, [0.0, None, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "i long, v array<float>").repartition(4)
    archive.write_array(df, str(tmp_path / "v.npy"), 5)
    assert (np.load(tmp_path / "v.npy") == v).all() and np.load(tmp_path / "v.npy.ids.npy").tolist() == list(range(0, 600, 3))
    archive.write_array(df.limit(0), str(tmp_path / "v.npy"), 5)
    assert np.load(tmp_path / "v.npy").shape == (0, 5) and archive.read_array(spark, str(tmp_path / "v.npy")).count() == 0


def test_arrays_that_have_no_rows_of_bytes(tmp_path):
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((3, 4))))
    np.save(tmp_path / "s.npy", np.array(["a", "b"]))
    np.save(tmp_path / "x.npy", np.float64(3))
    for name in ("f", "s", "x"):
        with pytest.raises(ValueError):
            archive.header(str(tmp_path / f"{name}.npy"))
    raw = io.BytesIO()
    np.save(raw, np.ones((10, 2)))
    (tmp_path / "short.npy").write_bytes(raw.getvalue()[:-8])
    reader = archive.ArrayReader({"path": str(tmp_path / "short.npy")})
    with pytest.raises(ValueError, match="ends within row 9"):
        [list(reader.read(p)) for p in reader.partitions()]


def test_records_of_unlike_keys(spark, tmp_path):
    rows = [(2, '{"b": "1", "a": "2"}'), (1, '{"c": "3"}'), (3, '{"a": "4", "d": null}'), (4, "{}"), (5, None)]
    # maps are read from text, as those made of Python's lose their order
    df = spark.createDataFrame(rows, "i int, j string").select("i", F.from_json("j", "map<string,string>").alias("data"))
    flat = sinks.flat_records(df, [F.col("i")], "data")
    assert flat.columns == ["i", "c", "b", "a", "d"]
    assert sorted(map(tuple, flat.collect()), key=lambda r: r[0]) == [(1, "3", None, None, None), (2, None, "1", "2", None), (3, None, None, "4", None), (4, None, None, None, None), (5, None, None, None, None)]


def test_reports_say_that_they_are_cut(spark):
    rows = spark.range(5)
    assert "Only the first 3 rows" in sinks.markdown(rows, "t", 3) and "Only" not in sinks.markdown(rows, "t", 5)


def test_reports_of_communities(spark):
    members = spark.createDataFrame([(i, i // 4) for i in range(9)], "doc long, community long")
    tf = spark.createDataFrame([(0, "Ann", 1), (1, "Ann", 2), (4, "Bob", 1), (5, "Bob", 1), (6, "Bob", 1), (0, "Bob", 1), (1, "Bob", 1)], "doc long, term string, tf long")
    works = spark.createDataFrame([(0, 5, "a", 1900), (1, None, None, 1900), (2, 9, "a", None), (3, 9, "b", 1890), (4, 1, "b", 1)], "doc long, chars long, genre string, year int")
    got = {r.community: r for r in mentions.reports(members, tf, works, most=3).collect()}
    assert set(got) == {0, 1} and got[0].size == 4
    assert got[0].names == ["Ann", "Bob"] and got[0].works == [2, 3, 0] and [tuple(g) for g in got[0].genres] == [("a", 2), ("b", 1), ("不明", 1)] and [tuple(y) for y in got[0].years] == [(1890, 1), (1900, 2)]
    assert got[1].works == [4, 5, 6] and [tuple(g) for g in got[1].genres] == [("不明", 3), ("b", 1)]
    edge = spark.createDataFrame([(0, 1, 1.0)], "a long, b long, w double")
    assert tuple(mentions.summary(members, edge).first()) == (9, 1, 2, 1)
    assert mentions.reports(members.limit(0), tf, works).count() == 0 and tuple(mentions.summary(members.limit(0), edge.limit(0)).first()) == (0, 0, 0, 0)


def test_directories_are_bounded(tmp_path, monkeypatch):
    """A task begins another archive after so many members, as whoever reads one holds its directory; none is lost."""
    monkeypatch.setattr(archive, "LISTED", 3)
    rows = pa.RecordBatch.from_arrays([pa.array([f"{i}.txt" for i in range(10)]), pa.array([str(i).encode() for i in range(10)])], names=["member", "content"])
    writer = archive.ZipWriter({"path": str(tmp_path)}, True)
    writer.commit([writer.write(iter([rows.slice(0, 5), rows.slice(5)]))])
    reader = archive.ZipReader({"path": str(tmp_path)})
    back = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert sorted((r["member"], r["content"]) for r in back) == sorted(zip(rows["member"].to_pylist(), rows["content"].to_pylist()))
    assert sorted(len(zipfile.ZipFile(f).infolist()) for f in tmp_path.glob("*.zip")) == [1, 3, 3, 3]
