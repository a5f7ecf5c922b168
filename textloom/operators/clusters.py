"""Clustering of feature vectors, and how far labels agree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.ranking import scratch

SEED = 20260825
#: Vectors of one packed row.
PACKED = 4096
#: Features that measure size, not style.
NOT_STYLE = ("n_chars", "n_chunks")


def matrix(features: DataFrame, id_col: str, map_col: str, names: list[str]) -> DataFrame:
    """(id, v): the named features as an array, absent ones 0."""
    chosen = [n for n in names if n not in NOT_STYLE]
    return features.select(F.col(id_col).alias("id"), F.array(*[F.coalesce(F.try_element_at(map_col, F.lit(n)), F.lit(0.0)) for n in chosen]).alias("v"))


def standardize(rows: DataFrame, cols: list[str]) -> DataFrame:
    """Columns less their mean, over the population deviation; a constant column becomes 0."""
    stats = rows.agg(*[f(c).alias(f"{k}_{c}") for c in cols for k, f in (("mu", F.avg), ("sd", F.stddev_pop))])
    z = [((F.col(c) - F.col(f"mu_{c}")) / F.when(F.col(f"sd_{c}") == 0, 1.0).otherwise(F.col(f"sd_{c}"))).alias(c) for c in cols]
    return rows.crossJoin(F.broadcast(stats)).select(*[c for c in rows.columns if c not in cols], *z)


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def assign(points: DataFrame, centers: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, label, d2): each point's nearest center (label, c), the smaller label on a tie."""
    rows = points.crossJoin(F.broadcast(centers)).select(F.col(id_col).alias("id"), "label", squared_distance(F.col(vec_col), F.col("c")).alias("d2"))
    best = rows.groupBy("id").agg(F.min(F.struct("d2", "label")).alias("m"))
    return best.select("id", "m.label", "m.d2")


def _distances(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.stack([((v - x) ** 2).sum(axis=1) for x in c], axis=1)


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def start(rows: DataFrame, k: int, seed: int = SEED) -> np.ndarray:
    """k-means++ centres of rows (id, v): each is drawn with chances as the squared distance from those before it.

    A draw is a race: a row's time is exponential at the rate of its weight, from a hash of
    its id and vector, and the least time wins. So each task hands on one row, and what it
    draws doesn't depend on how rows are dealt. Fewer come back if fewer rows differ.
    """
    centres = np.zeros((0, 0))
    while len(centres) < k:
        made = centres

        def race(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v, u = _vectors(batch.column(0)), (batch.column(1).to_numpy() + 0.5) / 2.0**53
                    weight = _distances(v, made).min(axis=1) if len(made) else np.ones(len(v))
                    with np.errstate(divide="ignore"):
                        time = np.where(weight > 0, -np.log(u) / weight, np.inf)
                    i = int(time.argmin())
                    yield pa.RecordBatch.from_arrays([pa.array([time[i]]), pa.array([v[i].tolist()], pa.list_(pa.float64()))], names=["time", "v"])

        draw = F.shiftrightunsigned(F.xxhash64("id", "v", F.lit(seed), F.lit(len(made))), 11)
        first = rows.select("v", draw.alias("u")).mapInArrow(race, "time double, v array<double>").agg(F.min(F.struct("time", "v")).alias("m")).first().m
        if first is None or first.time == float("inf"):
            break
        centres = np.array([*centres, first.v]) if len(centres) else np.array([first.v])
    return centres


def _nearest(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, the first on a tie: by one product, and by differences where that can't tell."""
    if len(c) < 2:
        return np.zeros(len(v), dtype=np.int64)
    norm, far = (c**2).sum(axis=1), (v**2).sum(axis=1)
    with np.errstate(invalid="ignore"):
        d = norm[None] - 2 * v @ c.T
        two = np.partition(d, 1, axis=1)
        close = np.flatnonzero(~(two[:, 1] - two[:, 0] > 1e-12 * (far + norm.max())))
    label = d.argmin(axis=1)
    label[close] = _distances(v[close], c).argmin(axis=1)
    return label


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, PACKED):
            some = batch.slice(at, PACKED)
            yield pa.RecordBatch.from_arrays([pa.array([some.num_rows]), pa.array([_vectors(some.column(0)).tobytes()], pa.binary())], names=["rows", "v"])


def settled(rows: DataFrame, starts: list[np.ndarray], iters: int) -> list[np.ndarray]:
    """The centres that Lloyd's iterations over rows (id, v) come to from each of `starts`, side by side: a pass serves all that still move."""
    packed = scratch(rows.select("v").mapInArrow(_packed, "rows long, v binary"), "packed")
    now, before = [np.array(c) for c in starts], [None] * len(starts)
    live = [i for i, c in enumerate(now) if len(c)]
    for _ in range(iters):
        if not live:
            break
        sets = [(i, now[i], before[i]) for i in live]

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = {}
            for batch in batches:
                for at in range(batch.num_rows):
                    v = np.frombuffer(batch.column(1)[at].as_buffer()).reshape(batch.column(0)[at].as_py(), -1)
                    for i, c, last in sets:
                        label = _nearest(v, c)
                        moved = len(v) if last is None else int((label != _nearest(v, last)).sum())
                        sums = np.stack([np.bincount(label, v[:, j], minlength=len(c)) for j in range(v.shape[1])] + [np.bincount(label, minlength=len(c)).astype(float), np.full(len(c), float(moved))], axis=1)
                        held[i] = held[i] + sums if i in held else sums
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["i", "sums"])

        all_ = {i: np.zeros((len(c), c.shape[1] + 2)) for i, c, _ in sets}
        for r in packed.mapInArrow(step, "i int, sums binary").collect():  # sums of each task, in order
            all_[r.i] += np.frombuffer(r.sums).reshape(all_[r.i].shape)
        live = [i for i in live if all_[i][0, -1]]
        for i in live:
            before[i], size = now[i], all_[i][:, -2:-1]
            now[i] = np.where(size > 0, all_[i][:, :-2] / np.maximum(size, 1), now[i])
    return now


def kmeans(points: DataFrame, id_col: str, vec_col: str, k: int, seed: int = SEED, iters: int = 300, centres: np.ndarray | None = None) -> DataFrame:
    """(id, label): Lloyd's iterations over the table from a k-means++ start (or from `centres`); labels are numbered by the least id in each.

    A pass sums the rows of each cluster in its tasks and hands on a number for each
    cluster and place. A cluster without rows keeps its centre. It ends when no row's
    label changes, or after `iters` passes. Rows without a vector take no part, and
    vectors are worked out once.
    """
    return several_kmeans(points, id_col, vec_col, [k], seed, iters, None if centres is None else [centres])[0]


def several_kmeans(points: DataFrame, id_col: str, vec_col: str, ks: list[int], seed: int = SEED, iters: int = 300, centres: list[np.ndarray] | None = None) -> list[DataFrame]:
    """`kmeans` for each of several k, whose iterations share their passes over the table."""
    rows = scratch(points.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")), "points")
    starts = [start(rows, k, seed) for k in ks] if centres is None else [np.asarray(c, dtype=float) for c in centres]
    return [_labelled(rows, c) for c in settled(rows, starts, iters)]


def _labelled(rows: DataFrame, final: np.ndarray) -> DataFrame:
    schema = f"id {dict(rows.dtypes)['id']}, p int"
    if not len(final):
        return rows.sparkSession.createDataFrame([], schema.replace("p int", "label int"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_nearest(_vectors(batch.column(1)), final).astype(np.int32))], names=["id", "p"])

    got = scratch(rows.mapInArrow(label, schema), "labels")
    order = got.groupBy("p").agg(F.min("id").alias("first"))
    named = order.withColumn("label", F.row_number().over(Window.orderBy("first")) - 1)  # k rows
    return got.join(F.broadcast(named), "p").select("id", "label")


def lloyd(x: np.ndarray, k: int, seed: int = SEED, iters: int = 300, centres: np.ndarray | None = None) -> np.ndarray:
    """Exact mode for a small matrix: k-means++ start, an empty cluster keeps its center, ends when no label changes."""
    rng = np.random.default_rng(seed)
    c = x[[rng.integers(len(x))]] if centres is None else centres
    while centres is None and len(c) < k:
        d = ((x[:, None] - c[None]) ** 2).sum(-1).min(axis=1)
        c = np.vstack([c, x[rng.choice(len(x), p=d / d.sum() if d.sum() > 0 else None)]])
    labels = np.zeros(len(x), dtype=int)
    for _ in range(iters):
        new = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(axis=1)
        if np.array_equal(new, labels):
            break
        labels = new
        size = np.bincount(labels, minlength=k)
        sums = np.stack([np.bincount(labels, x[:, j], minlength=k) for j in range(x.shape[1])], axis=1)
        c = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], c)
    return labels


def ward_tree(x: np.ndarray, weight: np.ndarray | None = None) -> list[tuple[int, int, float, int]]:
    """Merges (a, b, height, size) of Ward's method, by centroids: the cost of a merge is
    2 |A||B| / (|A| + |B|) times the squared distance of the centroids, and its root the height.
    A row stands for `weight` points, by default one.
    """
    n = len(x)
    at, size, name = x.astype(float).copy(), np.ones(n) if weight is None else weight.astype(float).copy(), np.arange(n)
    cost = 2 * np.outer(size, size) / np.maximum(size[:, None] + size[None], 1) * ((at[:, None] - at[None]) ** 2).sum(-1)
    np.fill_diagonal(cost, np.inf)
    merges = []
    for step in range(n - 1):
        i, j = np.unravel_index(np.argmin(cost), cost.shape)
        both = size[i] + size[j]
        merges.append((int(name[i]), int(name[j]), float(np.sqrt(cost[i, j])), int(both)))
        at[i] = (size[i] * at[i] + size[j] * at[j]) / both
        size[i], name[i], size[j] = both, n + step, 0
        d = ((at - at[i]) ** 2).sum(axis=1)
        cost[i] = cost[:, i] = np.where(size > 0, 2 * size * size[i] / np.maximum(size + size[i], 1) * d, np.inf)
        cost[i, i] = np.inf
        cost[j] = cost[:, j] = np.inf
    return merges


def ward_labels(x: np.ndarray, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """The tree cut into k clusters, numbered in the order in which their nodes were made."""
    n = len(x)
    root = np.arange(n)
    for step, (a, b, _, _) in enumerate(ward_tree(x, weight)[: max(0, n - k)]):
        root[(root == a) | (root == b)] = n + step
    return np.unique(root, return_inverse=True)[1]


def ward_of_centroids(points: DataFrame, id_col: str, vec_col: str, k: int, cells: int = 256, seed: int = SEED) -> DataFrame:
    """(id, label): an approximation of Ward's clusters for tables whose square is too much for `ward.ward`.

    `kmeans` first sums the table up in at most `cells` centroids with their sizes; one tree over
    these, of bounded size, is cut into k clusters, and every row takes its centroid's. Labels are
    numbered by the least id in each. Rows without a vector take no part.
    """
    rows = points.where(F.col(vec_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    if not rows.limit(1).count():
        return rows.sparkSession.createDataFrame([], f"id {dict(rows.dtypes)['id']}, label int")
    cell = kmeans(rows, "id", "v", cells, seed, 20).withColumnRenamed("label", "cell")
    at = cell.join(rows, "id").select("cell", F.posexplode("v")).groupBy("cell", "pos").agg(F.avg("col").alias("x"), F.count(F.lit(1)).alias("n"))
    least = cell.groupBy("cell").agg(F.min("id").alias("first"))
    sums = at.groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("c"), F.first("n").alias("n")).join(least, "cell")
    got = sums.orderBy("first").collect()  # `cells` rows at most
    labels = ward_labels(np.array([[c.x for c in r.c] for r in got]), min(k, len(got)), np.array([r.n for r in got])).tolist()
    order = {c: i for i, c in enumerate(dict.fromkeys(labels))}
    named = rows.sparkSession.createDataFrame([(r.cell, order[c]) for r, c in zip(got, labels)], "cell int, label int")
    return cell.join(F.broadcast(named), "cell").select("id", "label")


def grouped_labels(points: DataFrame, group: str, id_col: str, vec_col: str, k: int, method: str = "ward") -> DataFrame:
    """(group, id, label): an exact clustering of every group by itself, one task per group.

    The methods need quadratic memory in a group's rows: for small groups only,
    such as one collection's works; `kmeans` is the one for large tables.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id", ignore_index=True)
        x = np.stack(g["v"].to_numpy()).astype(float)
        labels = (ward_labels if method == "ward" else lloyd)(x, min(k, len(x)))
        return g[["grp", "id"]].assign(label=labels.astype("int32"))

    rows = points.select(F.col(group).alias("grp"), F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    kind = dict(rows.dtypes)
    return rows.groupBy("grp").applyInPandas(run, f"grp {kind['grp']}, id {kind['id']}, label int")


def adjusted_rand(labels: DataFrame, a: str, b: str) -> DataFrame:
    """(ari): agreement of two labelings, from the counts of their pairs of labels; 0 if it is undefined."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2
    cells = labels.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    sij = cells.agg(F.sum(two("n")).alias("sij"), F.sum("n").alias("total"))
    si = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("si"))
    sj = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(F.sum(two("n")).alias("sj"))
    all_ = sij.crossJoin(si).crossJoin(sj)
    expected, most = F.col("si") * F.col("sj") / two("total"), (F.col("si") + F.col("sj")) / 2
    return all_.select(F.when((most == expected) | (F.col("total") < 2), 0.0).otherwise((F.col("sij") - expected) / (most - expected)).alias("ari"))


def mismatches(neighbours: DataFrame, works: DataFrame, id_col: str, genre: str, at_least: int = 4) -> DataFrame:
    """(q, neighbour_genre, mismatch): the commonest genre of each work's neighbours, the one met first on a tie.

    `neighbours` is (q, doc, rank). A work is a mismatch if at least `at_least`
    of them share a genre that is not its own.
    """
    g = works.select(F.col(id_col).alias("doc"), F.col(genre).alias("g"))
    counts = neighbours.join(g, "doc").where("g is not null").groupBy("q", "g").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    best = counts.groupBy("q").agg(F.max(F.struct("n", -F.col("first"), "g")).alias("m")).select("q", F.col("m.n").alias("n"), F.col("m.g").alias("neighbour_genre"))
    own = works.select(F.col(id_col).alias("q"), F.col(genre).alias("own"))
    hit = F.col("own").isNotNull() & (F.col("neighbour_genre") != F.col("own")) & (F.col("n") >= at_least)
    return own.join(best, "q", "left").select("q", "neighbour_genre", F.coalesce(hit, F.lit(False)).alias("mismatch"))
