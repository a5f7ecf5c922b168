"""Properties and planted truths of operators that SQL cannot express."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.functions import kana, markup, style, text
from textloom.operators import changepoint, chunking, clusters, mentions, vectors, ward
from textloom.sources import readers, sinks


def test_chunks_lose_nothing_and_stay_in_bounds():
    rnd = random.Random(3)
    for _ in range(500):
        paras = ["".join(rnd.choice("あいう。" if rnd.random() < 0.3 else "あ") for _ in range(rnd.choice([1, 5, 80, 120, 300, 900]))) for _ in range(rnd.randint(0, 8))]
        got = chunking.chunk(paras)
        assert "".join(c[3] for c in got) == "".join(paras)
        assert all(0 < len(c[3]) <= 500 for c in got)
        assert [c[0] for c in got] == list(range(len(got)))


def test_chunk_cases():
    assert [len(c[3]) for c in chunking.chunk(["あ" * 1300], even=False)] == [500, 500, 300]
    first = chunking.chunk(["あ" * 120] * 3 + ["い" * 600], even=False)[0]
    assert first[1:3] == (0, 2)
    sizes = [len(c[3]) for c in chunking.chunk(["あ" * 480, "い" * 20, "う" * 400])]
    assert min(sizes) >= 120 and max(sizes) <= 500


def test_markup_round_trip(spark):
    rnd = random.Random(1)
    alphabet = ["漢", "か", "カ", "a", "｜", "《", "》", "［＃", "］", "※", "\n", "\r\n", "-" * 12, "底本：", " "]
    rows = [("".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))),) for _ in range(300)] + [("",)]
    df = spark.createDataFrame(rows, "src string").select("src", markup.serialize(markup.parse(F.col("src"))).alias("again"))
    assert df.where("src != again").count() == 0


@pytest.mark.parametrize(
    "src, base, read",
    [("顳※［＃「需＋頁」］《こめかみ》", "顳※［＃「需＋頁」］", "こめかみ"), ("とて※［＃外字］《そ》", "※［＃外字］", "そ"), ("三｜米《メートル》", "米", "メートル"), ("噛《かじ》", "噛", "かじ"), ("。《x》", "", "x")],
)
def test_ruby_base(src, base, read):
    ruby = next(n for n in markup.nodes(src) if n[0] == "r")
    assert ruby[2:4] == (base, read)


def test_subtitles():
    assert markup.head_fields("題\n副\n名\n\n") == ("題", ["副"], "名")
    assert markup.head_fields("題\n") == ("題", [], "")
    assert markup.head_fields("") == ("", [], "")


def test_fold_makes_spellings_equal(spark):
    df = spark.createDataFrame([("思ふに、さうしてしまふ", "思うに、そうしてしまう")], "a string, b string")
    assert df.select((kana.fold(F.col("a")) == kana.fold(F.col("b"))).alias("x")).first()[0]


def test_sentence_lengths(spark):
    df = spark.createDataFrame([("　私は行く。彼は「そうだ」と言った。",)], "t string")
    got = style.prepared(df, "t").select(*[v.alias(k) for k, v in style.base_features().items()]).first()
    assert got["n_chars"] == 17 and got["sent_len_mean"] == 8.5 and got["sent_len_var"] == 12.25


def test_style_windows_hold_the_text(spark):
    t = "".join("あ" * 90 + "。\n" for _ in range(120))
    df = spark.createDataFrame([(t,), ("短い",)], "t string").select(style.windows(F.col("t")).alias("w"))
    long_, short = [r[0] for r in df.collect()]
    assert "".join(long_) == t and len(long_) > 1 and short == ["短い"]
    assert all(len(w.replace("\n", "")) >= 2000 for w in long_)


def test_change_points():
    rng = np.random.default_rng(0)
    step = np.r_[np.zeros(30), np.full(40, 4), np.full(30, -3)] + rng.normal(0, 0.4, 100)
    assert changepoint.segment(step, changepoint.penalty(100, 1)) == [30, 70]
    three = rng.normal(0, 0.3, (80, 3))
    three[40:] += 2
    assert changepoint.segment(three, changepoint.penalty(80, 3)) == [40]
    found = sum(len(changepoint.segment((x := rng.normal(0, 1, 60)) / x.std(), changepoint.penalty(60, 1))) for _ in range(30))
    assert found <= 1  # noise alone is hardly ever split


def test_communities_of_cliques():
    edges = [(a, b, 1.0) for lo in (0, 5) for a in range(lo, lo + 5) for b in range(a + 1, lo + 5)] + [(4, 5, 0.05)]
    got = mentions.move_locally(edges, list(range(10)))
    assert len(set(got.values())) == 2 and len({got[i] for i in range(5)}) == 1
    assert mentions.move_locally([], [1, 2]) == {1: 0, 2: 1}


def test_clusterings():
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 0.1, (20, 2)) for c in (0, 5, 10)])
    for labels in (clusters.ward_labels(x, 3), clusters.lloyd(x, 3)):
        assert [len(set(labels[i : i + 20])) for i in (0, 20, 40)] == [1, 1, 1] and len(set(labels)) == 3
    heights = [m[2] for m in clusters.ward_tree(x)]
    assert heights == sorted(heights)


def test_projection_keeps_products(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(200, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "i int, v array<double>")
    mean, basis, ratio = vectors.components(df, "v", 32)
    assert np.allclose(v @ basis @ (v @ basis).T, v @ v.T) and abs(ratio.sum() - 1) < 1e-9
    mean, basis, _ = vectors.components(df, "v", 32, center=True)
    z = (v - mean) @ basis
    assert not np.allclose(z @ z.T, v @ v.T)


def test_codes_keep_direction(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(rng.normal(size=64).tolist(),) for _ in range(50)], "v array<double>")
    s = vectors.row_scale(F.col("v"))
    back = df.withColumn("s", s).withColumn("q", vectors.quantize(F.col("v"), F.col("s"))).withColumn("b", vectors.dequantize(F.col("q"), F.col("s"))).select("v", "b").collect()
    for v, b in back:
        assert np.dot(v, b) / np.linalg.norm(v) > 0.99


def test_half_precision_specials(spark):
    raw = np.array([1.0, -2.5, 6e-8, np.inf, -np.inf, np.nan, 0.0], dtype="<f2")
    df = spark.createDataFrame([(bytearray(raw.tobytes()),)], "b binary").select(vectors.from_f16(F.col("b")).alias("v"))
    assert np.array_equal(np.array(df.first()[0], dtype=np.float32), raw.astype(np.float32), equal_nan=True)


def test_varints():
    for n in (0, 1, 127, 128, 300, 2**14, 2**32 - 1, 2**60):
        assert sinks.decode_varints(sinks.encode_varint(n)) == [n]


def test_archive_errors_are_data(spark):
    import io
    import zipfile

    def packed(names):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for n in names:
                z.writestr(n, "本文".encode("cp932"))
        return bytearray(b.getvalue())

    rows = [(1, packed(["a.txt"])), (2, packed(["a.txt", "b.txt"])), (3, bytearray(b"no zip"))]
    got = spark.createDataFrame(rows, "i int, z binary").select("i", readers.extract_text(F.col("z")).alias("x")).orderBy("i").select("x.*").collect()
    assert got[0].text == "本文" and got[0].error is None
    assert "2 text members" in got[1].error and got[2].error


def test_csv_has_mark(spark, tmp_path):
    sinks.write_csv(spark.range(3), f"file://{tmp_path}/out")
    part = next((tmp_path / "out").glob("part-*.csv"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbfid")


def test_index_is_written(spark, tmp_path):
    from textloom.operators import search

    docs = spark.createDataFrame([(1, "b a a"), (2, "a")], "d long, t string")
    tf = search.term_frequencies(docs, "d", F.split("t", " "))
    sinks.write_index(search.postings(tf), search.doc_lengths(tf, docs, "d"), f"file://{tmp_path}/ix")
    back = sinks.decode_postings(spark.read.parquet(f"file://{tmp_path}/ix/postings"))
    assert sorted(map(tuple, back.collect())) == [("a", 1, 2), ("a", 2, 1), ("b", 1, 1)]


def test_pairs_map(spark):
    got = spark.createDataFrame([("a=1 b=x=y c a=2",), ("",)], "s string").select(text.parse_pairs(F.col("s"))).collect()
    assert got[0][0] == {"a": "2", "b": "x=y"} and got[1][0] == {}


def test_registry_needs_no_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1]).returncode == 0


def test_ward_of_a_whole_table(spark):
    """Planted clusters of unequal size, over rows and over centroids; a weighted row counts as its points."""
    rng = np.random.default_rng(3)
    truth = np.repeat(np.arange(4), (10, 20, 30, 60))
    x = rng.normal(0, 0.2, (120, 5)) + 8 * np.eye(5)[truth]
    rows = [(int(i) * 7, x[i].tolist()) for i in range(120)] + [(999, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    for got in (ward.ward(df, "id", "v", 4), ward.ward(df, "id", "v", 4, few=30), clusters.ward_of_centroids(df, "id", "v", 4, 12)):
        assert {r.id: r.label for r in got.collect()} == {i * 7: int(truth[i]) for i in range(120)}
    assert ward.ward(df.limit(0), "id", "v", 4).count() == clusters.ward_of_centroids(df.limit(0), "id", "v", 4).count() == 0
    y = np.array([[0.0], [1.0], [5.0]])
    spread = np.repeat(y, (1, 3, 2), axis=0)
    assert np.allclose([m[2] for m in clusters.ward_tree(spread)][-2:], [m[2] for m in clusters.ward_tree(y, np.array([1, 3, 2]))])


def test_neighbours_in_balls(spark):
    """Clustered vectors: rows as by brute force, most balls never met; copies and ties too."""
    from textloom.operators import search

    rng = np.random.default_rng(8)
    x = 5 * rng.normal(size=(12, 8))[rng.integers(0, 12, 1500)] + 0.05 * rng.normal(size=(1500, 8))
    x[700:720] = x[700]
    rows = [(i, v.tolist(), f"w{i % 40}") for i, v in enumerate(x)] + [(9999, None, "w1")]
    df = spark.createDataFrame(rows, "id long, v array<double>, work string")
    asked = df.where("id % 30 = 0 or id = 700")
    score = np.round(x @ x.T, 9)
    np.fill_diagonal(score, -np.inf)
    for balls in (1, 60):
        got = {}
        for r in search.nearest(df, asked, "id", "v", 7, balls=balls).collect():
            got.setdefault(r.q, {})[r.rank] = r.doc
        assert len(got) == 51 and all([d[i] for i in range(1, 8)] == np.lexsort((np.arange(1500), -score[q]))[:7].tolist() for q, d in got.items())
        wide = {}
        for r in search.passage_search(df, asked, "id", "v", "work", 6, 1, balls=balls).collect():
            wide.setdefault(r.q, {})[r.rank] = r.doc
        for q, d in wide.items():
            order, seen = np.lexsort((np.arange(1500), -score[q])), set()
            want = [j for j in order.tolist() if j != q and not (j % 40 in seen or seen.add(j % 40))][:6]
            assert [d[i] for i in range(1, 7)] == want
    met = []
    real = search.blocks.meet
    search.blocks.meet = lambda a, b, n=None, pairs=None: (met.append(pairs.count()), real(a, b, n, pairs))[1]
    try:
        search.nearest(df, asked, "id", "v", 7, balls=60)
    finally:
        search.blocks.meet = real
    assert sum(met) < 0.25 * asked.count() * 60, met


def test_ranks_by_counting(spark):
    from textloom.operators import metrics, search

    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(300, 4)), 1)  # ties
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    gold = [(q, d) for q in range(0, 300, 9) for d in (q + 1, q + 2, 777, q)]
    drop = [(q, d) for q in range(0, 300, 9) for d in range(q % 7, 300, 7)]
    frame = lambda rows: spark.createDataFrame(rows, "q long, doc long")
    score = np.round(x @ x.T, 9)
    for gone in (None, drop):
        got = {(r.q, r.doc): r.rank for r in search.ranks(df, df, frame(gold), "id", "v", None if gone is None else frame(gone)).collect()}
        out = set(gone or ())
        want = {}
        for q, d in gold:
            if d < 300 and d != q and (q, d) not in out:
                want[q, d] = 1 + sum(j != q and (q, j) not in out and (-score[q, j], j) < (-score[q, d], d) for j in range(300))
        assert got == want
    best = metrics.gold_ranks(search.ranks(df, df, frame(gold), "id", "v"), frame(gold), 50).collect()
    assert len(best) == 34 and all(r.rank is None or r.rank <= 50 for r in best)


def test_kmeans_is_lloyd_from_the_same_centres(spark):
    """An empty cluster keeps its centre; labels are those of the serial form; equal rows give fewer centres."""
    x = np.random.default_rng(4).normal(size=(400, 3))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None)], "id long, v array<double>").repartition(7)
    c = np.vstack([x[:5], [[50.0, 50.0, 50.0]]])  # no row is nearest to the last
    want = clusters.lloyd(x, 6, centres=c)
    first = {p: i for i, p in enumerate(dict.fromkeys(want.tolist()))}
    got = {r.id: r.label for r in clusters.kmeans(df, "id", "v", 6, centres=c).collect()}
    assert got == {i: first[p] for i, p in enumerate(want.tolist())}
    one, two = clusters.start(df.dropna(), 4), clusters.start(df.dropna().repartition(2), 4)
    assert np.array_equal(one, two) and len(np.unique(one, axis=0)) == 4 and all((x == r).all(axis=1).any() for r in one)
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "id long, v array<double>")
    assert len(clusters.start(same, 3)) == 1 and clusters.kmeans(same, "id", "v", 3).select("label").distinct().count() == 1
    assert clusters.kmeans(same.limit(0), "id", "v", 3).count() == 0


def test_starts_are_drawn_by_squared_distance(spark):
    """Of two far groups of unequal size each gets a centre, and nearly always."""
    rows = [(i, [float(i % 7) / 100]) for i in range(90)] + [(100 + i, [50.0 + i / 100]) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert sum(len({int(c[0] > 25) for c in clusters.start(df, 2, seed)}) == 2 for seed in range(6)) == 6


def chain(x):
    """Heights of Ward's tree by the chain of nearest neighbours: a second way, of quadratic work."""
    at, size, live, heights, path = x.astype(float).copy(), np.ones(len(x)), np.ones(len(x), dtype=bool), [], []
    while live.sum() > 1:
        if not path:
            path.append(int(np.flatnonzero(live)[0]))
        i = path[-1]
        d = np.where(live, 2 * size * size[i] / np.maximum(size + size[i], 1) * ((at - at[i]) ** 2).sum(axis=1), np.inf)
        d[i] = np.inf
        j = int(d.argmin())
        if len(path) > 1 and d[path[-2]] <= d[j]:
            j = path[-2]
            path = path[:-2]
            heights.append(float(np.sqrt(d[j])))
            at[j] = (size[i] * at[i] + size[j] * at[j]) / (size[i] + size[j])
            size[j], live[i] = size[i] + size[j], False
        else:
            path.append(j)
    return np.sort(heights)


@pytest.mark.parametrize(("n", "few"), [(513, 40), (513, 1024), (2500, 400)])
def test_ward_is_exact(spark, n, few):
    """Heights of rounds of mutual nearest neighbours are those of one merge at a time, and so are the clusters."""
    x = np.random.default_rng(n).normal(size=(n, 6)) * [3, 1, 1, 1, 1, 1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "c long, v array<double>")
    tree = ward.merges(df, few).collect()
    assert len(tree) == n - 1 and len({r.b for r in tree}) == n - 1 and all(r.a < r.b for r in tree) and max(r.size for r in tree) == n
    want = np.sort([m[2] for m in clusters.ward_tree(x)]) if n < 1000 else chain(x)
    assert np.allclose(np.sort([r.height for r in tree]), want, rtol=1e-9)
    if n < 1000:
        got = {r.id: r.label for r in ward.ward(df, "c", "v", 7, few).collect()}
        first = {c: i for i, c in enumerate(dict.fromkeys(clusters.ward_labels(x, 7).tolist()))}
        assert [got[i] for i in range(n)] == [first[c] for c in clusters.ward_labels(x, 7).tolist()]


@pytest.mark.parametrize("numbers", [10_000_000, 3_000])
def test_ward_in_few_passes(spark, monkeypatch, numbers):
    """Passes over all pairs are few, with edges that end on the driver or in rounds, and vectors at two scales: the tree is the same."""
    x = np.random.default_rng(7).normal(size=(1500, 12))
    x[700:] = x[0] + 1e-3 * x[700:]
    passes, meet = [], ward.blocks.meet
    monkeypatch.setattr(ward.blocks, "meet", lambda *a, **b: passes.append(1) or meet(*a, **b))
    monkeypatch.setattr(ward, "NUMBERS", numbers, raising=False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "c long, v array<double>")
    tree = ward.merges(df, 400 if numbers < 10_000 else 100).collect()
    assert len(passes) <= 8
    assert len(tree) == len({r.b for r in tree}) == 1499
    assert np.allclose(np.sort([r.height for r in tree]), chain(x), rtol=1e-9)


def test_ward_edges_reach_to_the_bounds(spark):
    """All pairs of a cluster up to its bound are edges, with ties, for clusters of many near ones and of none."""
    rng = np.random.default_rng(9)
    x = np.unique(np.concatenate([rng.integers(0, 4, (200, 3)), rng.integers(0, 40, (60, 3))]).astype(float), axis=0)
    size = rng.integers(1, 5, len(x)).astype(float)
    cost = 2 * size[:, None] * size / (size[:, None] + size) * ((x[:, None] - x) ** 2).sum(axis=-1)
    df = spark.createDataFrame([(i, float(s), v.tolist()) for i, (s, v) in enumerate(zip(size, x))], "c long, size double, v array<double>")
    got = ward.edges(df, len(x), 6.0, 4).collect()
    edges = {(r.x, r.y): r.d for r in got}
    assert len(edges) == len(got) and all(x < y and np.isclose(d, cost[x, y], rtol=1e-12) for (x, y), d in edges.items())
    bound = {c: tuple(b) for r in got for c, b in ((r.x, r.bx), (r.y, r.by))}
    assert 0 < sum(b[0] < 6 for b in bound.values()) and 0 < sum(b[1] > len(x) for b in bound.values())
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            near = cost[i, j] <= 6
            assert not near or (i in bound and j in bound)
            if near and ((cost[i, j], i, j) <= bound[i] or (cost[i, j], i, j) <= bound[j]):
                assert (i, j) in edges


def test_ward_of_copies_and_odd_rows(spark):
    rows = [(i, [1.0, 1.0]) for i in range(40)] + [(100, [5.0, 5.0]), (101, [5.0, 5.0]), (102, [9.0, 1.0]), (None, [9.0, 1.1]), (200, None), (201, [float("nan"), 1.0]), (202, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    for few in (2, 1024):
        got = {r.id: r.label for r in ward.ward(df, "id", "v", 3, few).collect()}
        assert len(got) == 44 and len({got[i] for i in range(40)}) == 1 and got[100] == got[101] and got[102] == got[None] and len(set(got.values())) == 3
    assert ward.ward(df, "id", "v", 100).select("label").distinct().count() == 44


def test_postings_in_blocks(spark):
    """A term of many documents is many rows, whose bytes in order are one list."""
    from textloom.operators import search

    rows = [("hot", d, d % 3 + 1) for d in range(0, 100, 3)] + [("rare", 7, 70000), ("even", 5, 1), ("even", 9, 2), ("even", 12, 1)]
    tf = spark.createDataFrame(rows, "term string, doc long, tf long")
    blocks = search.postings(tf, 3)
    encoded = sinks.encode_postings(blocks).cache()
    got = {(r.term, r.block): (r.df, r.base, [p.doc for p in r.postings]) for r in blocks.collect()}
    assert got["hot", 0] == (34, 0, [0, 3, 6]) and got["hot", 11] == (34, 96, [99]) and ("hot", 12) not in got
    assert got["even", 0] == (3, 0, [5, 9, 12]) and ("even", 1) not in got
    assert sorted(map(tuple, sinks.decode_postings(encoded).collect())) == sorted((t, d, min(n, 65535)) for t, d, n in rows)
    whole = b"".join(bytes(r.bytes) for r in encoded.where("term = 'hot'").orderBy("block").collect())
    assert sinks.decode_varints(whole) == [34] + [x for d in range(0, 100, 3) for x in (3 if d else 0, d % 3 + 1)]
    offsets = sinks.with_offsets(encoded).orderBy("term", "block").collect()
    assert offsets[0].start == 0 and all(a.end == b.start for a, b in zip(offsets, offsets[1:]))


def test_parallel_arrays_in_blocks(spark):
    rows = [(i, None if i % 5 == 4 else f"w{i * i % 7}", i % 4) for i in range(23)]
    got = sinks.parallel_arrays(spark.createDataFrame(rows, "i long, work string, p long"), "work", "i", ("p",), 6).orderBy("block").collect()
    works, w, p = ([x for r in got for x in r[c]] for c in ("works", "w", "p"))
    assert [r.block for r in got] == [0, 1, 2, 3] and max(len(r.w) for r in got) == 6
    assert works == list(dict.fromkeys(r[1] for r in rows))
    assert [works[k] for k in w] == [r[1] for r in rows] and p == [r[2] for r in rows]
    assert sinks.parallel_arrays(spark.createDataFrame([], "i long, work string, p long"), "work", "i", ("p",)).count() == 0


def test_gap_report_is_brute_force(spark):
    from textloom.operators import pairs

    rnd = random.Random(5)
    for size, letters in ((25, "ab"), (25, "abcdefgh"), (1, "ab"), (0, "ab")):
        rows = []
        for i in rnd.sample(range(1000), size):
            word = "".join(rnd.choice(letters) for _ in range(rnd.randint(3, 40)))
            rows.append((i, 1, len(word), sorted({word[k : k + 4] for k in range(len(word) - 3)})))
        both = [(x, y) for x in rows for y in rows if x[0] < y[0] and 0.6 < y[2] / x[2] < 1.7]
        scores = [len(set(x[3]) & set(y[3])) / max(len(set(x[3]) | set(y[3])), 1) for x, y in both]
        hit, miss = [s for s in scores if s >= 0.2], [s for s in scores if s < 0.2]
        got = pairs.gap_report(spark.createDataFrame(rows, "a long, members long, len int, grams array<string>"), 0.2).collect()
        assert [tuple(r) for r in got] == [(min(hit, default=None), max(miss, default=None), len(hit), len(both))]


def test_compared_counts_every_pair(spark, monkeypatch):
    from textloom.operators import pairs

    monkeypatch.setattr(pairs, "BLOCK", 3)
    rnd = random.Random(6)
    for ratio in ((0.6, 1.7), (0.4, 1.2), (0.5, 2.0)):
        rows = [(i, rnd.choice([1, 3, 5, 6, 10, 17, 20, 34, 59, 60, 100, 101, 168])) for i in rnd.sample(range(1000), 120)]
        want = sum(ratio[0] < q / p < ratio[1] for a, p in rows for b, q in rows if a < b)
        assert pairs.compared(spark.createDataFrame(rows, "a long, len int"), ratio).first()[0] == want


def test_edges_are_all_cosines(spark):
    rnd = random.Random(7)
    raw = {d: {f"t{min(rnd.randint(0, 40), rnd.randint(0, 40))}": rnd.random() + 0.01 for _ in range(rnd.randint(1, 9))} for d in range(60)}
    unit = {d: {t: x / sum(y * y for y in v.values()) ** 0.5 for t, x in v.items()} for d, v in raw.items()}
    w = spark.createDataFrame([(d, t, x) for d, v in unit.items() for t, x in v.items()], "doc long, term string, w double")
    cosine = {(a, b): sum(x * unit[b].get(t, 0) for t, x in unit[a].items()) for a in unit for b in unit if a < b}
    for least in (0.08, 0.5, 0.9):
        got = {(r.a, r.b): r.w for r in mentions.edges(w, least).collect()}
        want = {k: x for k, x in cosine.items() if x >= least}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_pairs_meet_in_blocks_and_only_those_left_are_compared_by_grams(spark, monkeypatch):
    from textloom.operators import pairs

    rnd = random.Random(8)
    texts = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.choice([3, 4, 30, 70, 150, 300, 600]))) for _ in range(60)]
    far = [(i, 1, len(w), sorted({w[k : k + 4] for k in range(len(w) - 3)})) for i, w in enumerate(texts)]
    near = [w[: rnd.randint(1, len(w))] + w[rnd.randint(0, len(w)) :] for w in texts for _ in range(2)]
    more = far + [(i, 1, len(w), sorted({w[k : k + 4] for k in range(len(w) - 3)})) for i, w in enumerate(near, 100)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, members long, len int, grams array<string>")
    monkeypatch.setattr(pairs, "ROWS", 9)
    monkeypatch.setattr(pairs, "BYTES", 256)  # several blocks of a level, and several parts of a block
    for t in (0.3, 0.5, 0.8):
        score = {(x[0], y[0]): len(set(x[3]) & set(y[3])) / max(len(set(x[3]) | set(y[3])), 1) for x in more for y in more if x[0] < y[0] and 0.6 < y[2] / x[2] < 1.7}
        want = {k: s for k, s in score.items() if s >= t}
        got = {(r.a, r.b): r.score for r in pairs.find_pairs(frame(more), t).collect()}
        assert len(want) > 20 and got == want

    stored = {}
    real = pairs.scratch
    monkeypatch.setattr(pairs, "scratch", lambda df, name: stored.setdefault(name, real(df, name)))
    assert pairs.find_pairs(frame(far[:20])).count() == 0
    assert stored["numbers"].count() == 0  # a row for each gram before


def test_edges_meet_in_blocks(spark, monkeypatch):
    """Several blocks and parts find every cosine, and pairs under the threshold leave no task."""
    rnd = random.Random(9)
    raw = {d: {f"t{rnd.randint(0, 60)}": rnd.random() + 0.01 for _ in range(rnd.randint(1, 9))} for d in range(90)}
    unit = {d: {t: x / sum(y * y for y in v.values()) ** 0.5 for t, x in v.items()} for d, v in raw.items()}
    w = spark.createDataFrame([(d, t, x) for d, v in unit.items() for t, x in v.items()], "doc long, term string, w double")
    for name, value in (("LEAST", 40), ("BLOCKS", 3), ("ENTRIES", 50), ("CELLS", 30)):
        monkeypatch.setattr(mentions, name, value)
    want = {(a, b): x for a in unit for b in unit if a < b and (x := sum(x * unit[b].get(t, 0) for t, x in unit[a].items())) >= 0.3}
    rows = mentions.edges(w, 0.3)
    got = {(r.a, r.b): r.w for r in rows.collect()}
    assert rows.count() == len(got) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert mentions.edges(w.limit(0)).count() == 0


def test_work_features_of_some_names(spark):
    """They are as among all, and nothing else is worked out."""
    rows = [(1, "Die Stadt ist alt, sagte er. 12 Leute!\n" * 300), (2, "a, b."), (3, ""), (4, None), (5, "私は「の」に行く。\n")]
    docs = spark.createDataFrame(rows, "id long, t string")
    some = ("n_chars", "sent_len_mean", "pos_名詞")
    make = lambda **more: style.work_features(docs, "id", "t", tagger=style.rule_tokens, **more)
    whole, part = {r.id: r.features for r in make().collect()}, {r.id: r.features for r in make(only=some).collect()}
    assert len(whole[1]) == len(style.feature_names(True)) + 1 and whole[1]["pos_名詞"] == 1.0 and whole[1]["n_chunks"] > 1
    assert part == {i: {k: x for k, x in f.items() if k in (*some, "n_chunks")} for i, f in whole.items()}
    plan = make(only=some)._jdf.queryExecution().optimizedPlan().toString()
    assert "func_" not in plan and "_words" not in plan and "_speech" not in plan


def test_fold_passes_over_what_no_stage_touches(spark):
    rows = ["plain, text.\n", "", None, "漢字／字", "人々", "a／＼", "ab／″＼", "x\ufdd0y", "ヾか", "é ü 12", "バナナ／″＼", "思ふ"]
    df = spark.createDataFrame([(r,) for r in rows], "t string").select("t", kana.fold(F.col("t")).alias("f"), kana.fold_stages(F.col("t"))["fold"].alias("g"))
    got = df.collect()
    assert all(r.f == r.g for r in got) and [r.f for r in got][:3] == rows[:3]
    assert "CASE WHEN" in df.select("f")._jdf.queryExecution().optimizedPlan().toString()


def test_terms_are_counted_without_a_shuffle(spark):
    """Documents of one id are one document, even in several rows; where no id repeats, no posting is shuffled to be counted."""
    from textloom.operators import search

    rows = [(1, "b a a"), (2, "a"), (1, "a c"), (None, "a"), (None, "a b"), (3, None), (4, "")]
    tf = lambda r: search.term_frequencies(spark.createDataFrame(r, "d long, t string"), "d", F.filter(F.split("t", " "), lambda x: x != ""))
    found = lambda r: sorted(map(tuple, tf(r).collect()), key=str)
    assert found(rows) == sorted([(1, "a", 3), (1, "b", 1), (1, "c", 1), (2, "a", 1), (None, "a", 2), (None, "b", 1)], key=str)
    assert found(rows[:2]) == [(1, "a", 2), (1, "b", 1), (2, "a", 1)] and found([]) == []
    assert "Exchange" not in tf(rows[:2])._jdf.queryExecution().executedPlan().toString()


def test_postings_are_shuffled_once(spark):
    from textloom.operators import search

    tf = spark.createDataFrame([("a", d, 1) for d in range(9)], "term string, doc long, tf long")
    plan = search.postings(tf, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_varints_of_whole_arrays():
    v = np.array([0, 1, 127, 128, 16383, 16384, 2**31, 2**56 - 1, 2**56, 2**63 - 1], dtype=np.int64)
    raw, many = sinks.packed_varints(v)
    assert raw.tobytes() == b"".join(map(sinks.encode_varint, v.tolist())) and many.tolist() == [len(sinks.encode_varint(x)) for x in v.tolist()]
    back, end = sinks.unpacked_varints(raw)
    assert back.tolist() == v.tolist() and end.tolist() == np.cumsum(many).tolist()
    with pytest.raises(ValueError):
        sinks.packed_varints(np.array([-1]))


def test_several_clusterings_share_their_passes(spark, monkeypatch):
    """Each is that of a run by itself, and ties go to the first centre as differences tell."""
    rnd = np.random.default_rng(5)
    v = np.concatenate([rnd.normal(c, 0.7, (60, 3)) for c in (0, 3, 6)])
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "i long, v array<double>")
    label = lambda df: [r.label for r in df.orderBy("id").collect()]
    alone = [label(clusters.kmeans(points, "i", "v", k)) for k in (2, 5)]
    assert [label(df) for df in clusters.several_kmeans(points, "i", "v", [2, 5])] == alone
    c = np.array([[1.0, 0.0, 0.0], [-1.0, 0.0, 0.0], [1.0, 0.0, 0.0]])
    far = 1e6 + rnd.normal(size=(50, 3))
    for x in (np.array([[0.0, 2.0, 1.0], [5.0, 1.0, 1.0]]), rnd.normal(size=(50, 3)), far):
        assert clusters._nearest(x, c).tolist() == clusters._distances(x, c).argmin(axis=1).tolist()
    assert clusters._nearest(far, far[:9]).tolist() == clusters._distances(far, far[:9]).argmin(axis=1).tolist()


def test_few_neighbours_leave_a_block_once_some_are_known(spark):
    """A query that knows its least score hands on only rows that reach it, rounded as all are."""
    import pyarrow as pa

    from textloom.operators import blocks, search

    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(600, 8))
    score = np.round(v[:4] @ v.T, 2)
    score[np.arange(4), np.arange(4)] = -np.inf
    least = -np.sort(-score, axis=1)[:, 4]
    part = lambda ids, sizes, x: next(blocks._packed(iter([pa.RecordBatch.from_arrays([pa.array([0] * len(ids)), pa.array(ids), pa.array(sizes), pa.array(x.tolist()), pa.array([None] * len(ids), pa.string())], names=["block", "id", "size", "v", "work"])])))
    left, right = part(list(range(4)), least.tolist(), v[:4]), part(list(range(600)), [0.0] * 600, v)
    both = pa.RecordBatch.from_arrays([*left.columns, *right.columns], names=[*left.schema.names, *[f"r_{c}" for c in right.schema.names]])
    got = sorted((r["q"], r["doc"], r["score"]) for b in search._meeting(search._first(300), False, 2)(iter([both])) for r in b.to_pylist())
    assert got == sorted((int(q), int(d), float(score[q, d])) for q, d in zip(*np.nonzero(score >= least[:, None])))


@pytest.mark.parametrize("size", [1 << 20, 60])
def test_passages_are_aligned_in_blocks(spark, monkeypatch, size):
    """Texts are shuffled, not their grams; blocks, repeated ids, wide characters and one-sided pairs change nothing."""
    from textloom.operators import pairs

    monkeypatch.setattr(pairs, "PASSAGES", size)
    monkeypatch.setattr(pairs, "TABLE", 64)
    rng = np.random.default_rng(5)
    letters = ["a", "b", "é", "あ", "\U0001f600"]
    text = lambda: "".join(rng.choice(letters, int(rng.integers(2, 40))))
    old = [(int(rng.integers(0, 3)), i, text()) for i in range(24)] + [(7, 90, "abcdabcd"), (None, 91, "abcd"), (0, None, "abcd"), (0, 3, None)]
    new = [(int(rng.integers(0, 3)), 100 + i, text()) for i in range(24)] + [(0, old[0][1] + 100, text()), (8, 190, "abcdabcd")]
    old += [(p, q, t[:-2] + "zz") for p, q, t in old[:5]]
    new += [(p, 300 + q, t[1:]) for p, q, t in old[:9]] + [(p, 200 + q, t[1:]) for p, q, t in old[:9]]

    def sets(rows):
        out = {}
        for p, i, t in rows:
            if p is not None and i is not None and t is not None and len(t) >= 4:
                out.setdefault((p, i), set()).update(t[k : k + 4] for k in range(len(t) - 3))
        return out

    best = {}
    for (p, q), a in sets(old).items():
        for (r, g), b in sets(new).items():
            if p == r and a & b:
                best[q] = min(best.get(q, (0, 0)), (-len(a & b) / len(a | b), g))
    want = {q: (g, -s) for q, (s, g) in best.items() if -s >= 0.35}
    frame = lambda rows, name: spark.createDataFrame(rows, f"pair long, {name} long, text string")
    got = pairs.align(frame(old, "q"), frame(new, "gold"))
    assert {r.q: (r.gold, r.score) for r in got.collect()} == want and len(want) > 5


def test_rows_are_objects_a_slice_at_a_time(spark, monkeypatch):
    """Slices are of bounded rows and bytes, a large row is one by itself, and none is lost; chunks of a batch are those of its rows."""
    import pyarrow as pa

    from textloom.functions import slices

    monkeypatch.setattr(slices, "BYTES", 4000)
    monkeypatch.setattr(slices, "ROWS", 10)
    texts = [["あ" * (i % 7)] * (i % 5) for i in range(300)] + [None, [], ["い" * 9000], [None]]
    got = list(slices.slices((pa.array(texts, pa.list_(pa.string())), pa.array(range(304)))))
    assert [x for s in got for x in s[0].to_pylist()] == texts and [i for s in got for i in s[1].to_pylist()] == list(range(304))
    assert max(len(s[0]) for s in got) <= 10 and all(len(s[0]) == 1 or s[0].nbytes + s[1].nbytes <= 4000 for s in got)
    assert [len(s[0]) for s in got if (s[0].nbytes > 4000)] == [1] and not list(slices.slices((pa.array([], pa.string()),)))

    paras = [None if i % 50 == 7 else ["う" * (i % 600), None, "え。"] for i in range(700)]
    df = spark.createDataFrame(list(enumerate(paras)), "i int, paras array<string>").coalesce(1).select("i", chunking.chunks(F.col("paras")).alias("c"))
    assert df.schema["c"].dataType.simpleString() == chunking.CHUNK
    want = {i: None if ps is None else chunking.chunk([p or "" for p in ps]) for i, ps in enumerate(paras)}
    assert {r.i: r.c and [tuple(c) for c in r.c] for r in df.collect()} == want
    seen = spark.createDataFrame([(i,) for i in range(2000)], "i int").coalesce(1).select(slices.by_rows(lambda i: i + 1, "int", pa.int32(), F.col("i")).alias("x"))
    assert sorted(r.x for r in seen.collect()) == list(range(1, 2001))


def test_rounded_is_as_the_sql_engine_rounds(spark):
    import duckdb

    from textloom.functions.numbers import rounded

    values = [(m / n,) for n in (160, 640, 800, 3200, 5120, 12800) for m in range(1, 4 * n, 3)] + [(2589 / 640,), (-2589 / 640,), (None,), (0.0,)]
    got = spark.createDataFrame(values, "x double").select("x", rounded("x", 6).alias("six"), rounded(F.col("x"), 4).alias("four")).collect()
    con = duckdb.connect()
    want = [con.execute("SELECT round(?::DOUBLE, 6), round(?::DOUBLE, 4)", [r.x, r.x]).fetchone() for r in got]
    assert [(r.six, r.four) for r in got] == want
    assert next(r.six for r in got if r.x == 2589 / 640) == 4.045312  # F.round gives 4.045313


def test_pairs_of_frames_are_brute_force(spark, monkeypatch):
    """Frames hand on numbers for their grams, wide characters too; a group of alike texts is compared under one number, and meetings are not shuffled."""
    from textloom.operators import pairs

    rnd = random.Random(12)
    first = ["".join(rnd.choice(letters) for _ in range(rnd.choice([5, 40, 90]))) for letters in ("abcdefgh", "aあ𠀀é", "一二三") for _ in range(8)]
    alike = ["".join(rnd.choice("abcdefgh") for _ in range(200))]
    alike += [alike[0][:k] + "z" + alike[0][k + 1 :] for k in range(0, 200, 16)]
    for n in (4, 8):
        texts = first + [w[:-3] + "x" for w in first] + [w + "b" for w in first] + alike
        works = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
        grams = {}
        for i, w in enumerate(texts):
            grams.setdefault(w, (i, len(w), {w[k : k + n] for k in range(len(w) - n + 1)}))
        want = {(x[0], y[0]): len(x[2] & y[2]) / len(x[2] | y[2]) for x in grams.values() for y in grams.values() if x[0] < y[0] and x[2] & y[2] and 0.6 < y[1] / x[1] < 1.7}
        stored, real = {}, pairs.scratch
        with monkeypatch.context() as m:
            m.setattr(pairs, "ROWS", 8)
            m.setattr(pairs, "scratch", lambda df, name: stored.setdefault(name, real(df, name)))  # noqa: B023
            got = {(r.a, r.b): r.score for r in pairs.find_pairs(pairs.classes(works, "id", F.col("t"), n, "\\x{0}-\\x{10FFFF}")).collect()}
        assert got == {k: s for k, s in want.items() if s >= 0.5} and len(got) > 50
        one = stored["numbers"].where(F.col("a") >= 72)
        assert one.count() == len(alike) and one.select("under", "part").distinct().count() == 1


def test_large_tables_meet_in_large_parts_and_single_precision_loses_nothing(spark):
    """Parts are as large as they may be, as each is sent to all that it meets; scores that differ in the last digits alone keep their order."""
    from textloom.operators import search

    rng = np.random.default_rng(8)
    x = rng.normal(size=(9000, 6))
    x[4500:] = x[:4500] * (1 + rng.integers(-3, 4, (4500, 1)) * 2e-9)  # apart by less than single precision tells
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    met, real = [], search.blocks.meet
    search.blocks.meet = lambda a, b, n=None, pairs=None: (met.append((a.count(), b.count())), real(a, b, n, pairs))[1]
    try:
        got = {}
        for r in search.nearest(df, df, "id", "v", 6).collect():
            got.setdefault(r.q, {})[r.rank] = r.doc
    finally:
        search.blocks.meet = real
    assert len(got) == 9000 and max(map(max, met)) <= 32
    for q in range(0, 9000, 97):
        score = np.round(x @ x[q], 9)
        score[q] = -np.inf
        assert [got[q][i] for i in range(1, 7)] == np.lexsort((np.arange(9000), -score))[:6].tolist()


def test_blocks_of_names_meet_where_they_are_stored(spark, monkeypatch):
    """No block is shuffled to meet another, and blocks and parts find every cosine."""
    rnd = random.Random(13)
    raw = {d: {f"t{rnd.randint(0, 30)}": rnd.random() + 0.01 for _ in range(rnd.randint(1, 9))} for d in range(70)}
    unit = {d: {t: x / sum(y * y for y in v.values()) ** 0.5 for t, x in v.items()} for d, v in raw.items()}
    w = spark.createDataFrame([(d, t, x) for d, v in unit.items() for t, x in v.items()], "doc long, term string, w double")
    for name, value in (("LEAST", 40), ("BLOCKS", 3), ("ENTRIES", 50)):
        monkeypatch.setattr(mentions, name, value)
    rows = mentions.edges(w, 0.3)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    want = {(a, b): x for a in unit for b in unit if a < b and (x := sum(x * unit[b].get(t, 0) for t, x in unit[a].items())) >= 0.3}
    got = {(r.a, r.b): r.w for r in rows.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_rounds_store_each_edge_once(spark, monkeypatch):
    edge = spark.createDataFrame([(5 * c + i, 5 * c + j, 1.0) for c in range(3) for i in range(5) for j in range(i)] + [(0, 5, 0.1), (5, 10, 0.1)], "a long, b long, w double")
    nodes = spark.range(16).withColumnRenamed("id", "node")
    stored, real = {}, mentions.scratch
    monkeypatch.setattr(mentions, "scratch", lambda df, name: stored.setdefault((name, len(stored)), real(df, name)))
    for held in (False, True):
        stored.clear()
        got = mentions.communities_in_rounds(edge, nodes, stored=held).collect()
        assert {r.node: r.community for r in got} == {k: k // 5 * 5 for k in range(15)} | {15: 15}
        assert [df.count() for (name, _), df in stored.items() if name == "near"] == ([] if held else [edge.count()])
