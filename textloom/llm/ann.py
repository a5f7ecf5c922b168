"""Nearest neighbours by largest inner product: stable projections in a kd-tree.

Vectors are lifted to unit length (x / M, sqrt(1 - |x/M|^2)), M the greatest
norm, so that the largest inner product with a query is the least distance.
DIMS Gaussian (2-stable) projections of the lifted vectors are indexed by a
kd-tree, whose upper part is cut from a bounded sample into cells and whose
lower part each cell builds for itself. If two vectors lie r apart, their squared
projected distance over r^2 is chi-square with DIMS degrees of freedom. So once
a query's k-th neighbour so far lies d away, a point farther than
d * sqrt(chi2(CONFIDENCE)) in the projection is no nearer but with chance
1 - CONFIDENCE: there the search stops.

A query searches its own cell first, which gives a first d, and then all other
cells that its stopping radius reaches, each with its own test. The cells'
boxes and sizes are all that is broadcast, MOST_CELLS rows at most; a cell larger
than BLOCK rows is split. An index row moves once for each QUERIES queries that
reach its cell, and only what may be among a query's k nearest comes back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import store

K = 20
DIMS = 8
#: Quantile of the chi-square law at which a query stops.
CONFIDENCE = 0.97
#: Rows of a cell aimed at; rows and queries of a task; rows of a leaf.
CELL, BLOCK, QUERIES, LEAF = 4096, 8192, 8192, 256
MOST_CELLS = 1 << 16
#: Rows whose projections the upper tree is cut from: about so many in all, or so many for each cell.
SAMPLE, PER_CELL = 20_000, 8
SEED = 20240607
EVERY = 20
NONE = np.iinfo(np.int64).max


def chi2_quantile(p: float, dims: int) -> float:
    """The quantile for an even number of degrees of freedom, by bisection of the closed form."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        term = total = float(np.exp(-x / 2))
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - total < p else (low, x)
    return (low + high) / 2


def clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>, norm) of the vectors that take part."""
    v = F.col(vec_col).cast("array<double>")
    most = F.array_max(F.transform("v", F.abs))  # scaled by it, squares of very small or large components are numbers too
    norm = most * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / most) * (x / most)))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return rows.where(F.exists("v", lambda x: x != 0)).withColumn("norm", norm)


def grow(x: np.ndarray, most: int) -> list:
    """A kd-tree over the rows of x: (axis, value, left, right), or the positions of a leaf's rows."""

    def node(at: np.ndarray):
        if len(at) <= most:
            return at
        axis = int(np.argmax(x[at].max(axis=0) - x[at].min(axis=0)))
        value = float(np.median(x[at, axis]))
        left = x[at, axis] < value
        if not left.any() or left.all():
            return at  # equal in all axes, or nearly
        return axis, value, node(at[left]), node(at[~left])

    return node(np.arange(len(x)))


class Cells:
    """The upper tree as boxes, numbered from 0, which together cover all of the space."""

    def __init__(self, sample: np.ndarray, cells: int):
        dims = sample.shape[1]
        self.low, self.high = [], []
        self.tree = self._number(grow(sample, max(2, -(-len(sample) // cells))), np.full(dims, -np.inf), np.full(dims, np.inf))
        self.low, self.high = np.array(self.low), np.array(self.high)

    def _number(self, node, low: np.ndarray, high: np.ndarray):
        if not isinstance(node, tuple):
            self.low.append(low)
            self.high.append(high)
            return len(self.low) - 1
        axis, value, left, right = node
        mid_high, mid_low = high.copy(), low.copy()
        mid_high[axis] = mid_low[axis] = value
        return axis, value, self._number(left, low, mid_high), self._number(right, mid_low, high)

    def of(self, p: np.ndarray) -> np.ndarray:
        out = np.zeros(len(p), dtype=np.int32)

        def walk(node, at: np.ndarray) -> None:
            if isinstance(node, tuple):
                left = p[at, node[0]] < node[1]
                walk(node[2], at[left])
                walk(node[3], at[~left])
            else:
                out[at] = node

        walk(self.tree, np.arange(len(p)))
        return out

    def bound(self, p: np.ndarray) -> np.ndarray:
        """Squared projected distance of each point from each cell."""
        out = np.empty((len(p), len(self.low)))
        for low in range(0, len(self.low), 4096):
            s = slice(low, low + 4096)
            gap = np.maximum(0, np.maximum(self.low[None, s] - p[:, None], p[:, None] - self.high[None, s]))
            out[:, s] = (gap**2).sum(axis=2)
        return out


class Projection:
    def __init__(self, width: int, most: float, dims: int = DIMS, seed: int = SEED):
        self.most = most
        self.matrix = np.random.default_rng(seed).standard_normal((width + 1, dims))

    def rows(self, v: np.ndarray) -> np.ndarray:
        x = v / self.most
        return np.c_[x, np.sqrt(np.maximum(0, 1 - (x**2).sum(axis=1)))] @ self.matrix

    def queries(self, v: np.ndarray) -> np.ndarray:
        return np.c_[v / np.linalg.norm(v, axis=1)[:, None], np.zeros(len(v))] @ self.matrix


def _matrix(col: pa.Array) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 1))


def search(ids: np.ndarray, v: np.ndarray, p: np.ndarray, qid: np.ndarray, q: np.ndarray, qp: np.ndarray, worst: np.ndarray, most: float, k: int, stop: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The up to k best of these rows for each query: (query position, vec_id, inner product).

    The queries go through the leaves of the block's kd-tree, each in the order of
    its own projected distances, and leave when the chi-square test holds. `worst`
    is each query's k-th inner product so far.
    """
    leaves: list[np.ndarray] = []

    def gather(node) -> None:
        if isinstance(node, tuple):
            gather(node[2])
            gather(node[3])
        else:
            leaves.extend(node[i : i + LEAF] for i in range(0, len(node), LEAF))

    gather(grow(p, LEAF))
    low, high = np.array([p[a].min(axis=0) for a in leaves]), np.array([p[a].max(axis=0) for a in leaves])
    gap = np.maximum(0, np.maximum(low[None] - qp[:, None], qp[:, None] - high[None]))
    bound = (gap**2).sum(axis=2)
    order = np.argsort(bound, axis=1, kind="stable")
    n = np.linalg.norm(q, axis=1)
    asked, worst = worst, worst.copy()
    best_s = np.full((len(q), k), -np.inf)
    best_i = np.full((len(q), k), NONE)
    alive = np.arange(len(q))
    for turn in range(len(leaves)):
        leaf = order[alive, turn]
        far = 2 - 2 * np.minimum(worst[alive] / (most * n[alive]), 1.0)  # squared distance of the k-th
        go = ~(bound[alive, leaf] > far * stop)
        alive, leaf = alive[go], leaf[go]
        if not len(alive):
            break
        for which in np.unique(leaf):
            mine, at = alive[leaf == which], leaves[which]
            rough = q[mine] @ v[at].T
            i, j = np.nonzero((rough >= (worst[mine] - 1e-9 * most * n[mine])[:, None]) & (qid[mine][:, None] != ids[at][None, :]))
            i, j = mine[i], at[j]
            s = np.einsum("ij,ij->i", q[i], v[j])
            rows = np.unique(i)  # whose best may change
            of, s, found = np.r_[np.repeat(rows, k), i], np.r_[best_s[rows].ravel(), s], np.r_[best_i[rows].ravel(), ids[j]]
            by = np.lexsort((found, -s, of))
            of, s, found = of[by], s[by], found[by]
            place = np.arange(len(of)) - np.searchsorted(of, of)
            top = place < k
            best_s[of[top], place[top]], best_i[of[top], place[top]] = s[top], found[top]
            worst[rows] = np.maximum(worst[rows], best_s[rows, -1])
    at, rank = np.nonzero((best_i < NONE) & (best_s >= asked[:, None]))
    return at, best_i[at, rank], best_s[at, rank]


def _visit(rows: DataFrame, asked: DataFrame, most: float, k: int, stop: float) -> DataFrame:
    """(query_id, vec_id, score): every asked query against the blocks of its cell, in bounded groups."""
    sizes = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))
    blocks = rows.groupBy("cell").agg((F.max("block") + 1).alias("blocks"))
    sizes, blocks = F.broadcast(sizes), F.broadcast(blocks)  # a row for each cell, MOST_CELLS at most
    copies = rows.join(sizes, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    asked = asked.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("query_id", F.lit(1)), F.col("parts")).cast("int")).drop("parts")
    asked = asked.join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        left, right = left.sort_by("vec_id"), right.sort_by("query_id")
        qid = right["query_id"].to_numpy()
        at, found, score = search(left["vec_id"].to_numpy(), _matrix(left["v"]), _matrix(left["p"]), qid, _matrix(right["v"]), _matrix(right["p"]), right["worst"].to_numpy(), most, k, stop)
        return pa.table([pa.array(qid[at]), pa.array(found), pa.array(score)], names=names)

    key = ["cell", "block", "part"]
    return copies.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(meet, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, every: int = EVERY, confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query, a row whose id is divisible by `every`.

    Vectors that are null, zero, or hold null or non-finite components take no
    part, nor do rows without an id, nor vectors of another width than most are of
    (the greater width, if two are as common). Ties go to
    the smaller id. A query that meets fewer than k others returns those. Rows
    that repeat an id and vector count once for each vector. Other columns are
    not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = store(clean(vectors, id_col, vec_col).dropDuplicates(["vec_id", "v"]), "vectors")
    widths = rows.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most"))
    widest = widths.orderBy(F.desc("n"), F.desc("width")).first()
    if not widest:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, n, most = widest
    rows = rows.where(F.size("v") == width)
    project = Projection(width, most)
    wanted = min(MOST_CELLS, -(-n // CELL))
    chance = max(SAMPLE, PER_CELL * wanted) / n  # by a hash of the id; what the driver gets is bounded by MOST_CELLS

    def projections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(project.rows(_matrix(batch.column(0)))), pa.list_(pa.float64()))], names=["p"])

    drawn = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1 << 40)) < int(min(1.0, chance) * (1 << 40)))
    sample = _matrix(drawn.select("v").mapInArrow(projections, "p array<double>").toArrow()["p"])
    sample = sample[np.lexsort(sample.T)] if len(sample) else np.zeros((1, DIMS))
    cells = Cells(sample, max(1, min(wanted, len(sample) // PER_CELL)))
    shared = spark.sparkContext.broadcast((project, cells))
    stop = chi2_quantile(confidence, DIMS)

    def placed(as_query: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            project, cells = shared.value
            for batch in batches:
                v = _matrix(batch.column(1))
                if not len(v):
                    continue
                p = project.queries(v) if as_query else project.rows(v)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(p), pa.list_(pa.float64())), pa.array(cells.of(p))], names=["vec_id", "v", "p", "cell"])

        return run

    schema = "vec_id long, v array<double>, p array<double>, cell int"
    index = rows.select("vec_id", "v").mapInArrow(placed(False), schema)
    index = store(index, "indexed")
    sizes = index.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    index = index.join(F.broadcast(sizes), "cell").withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("blocks")).cast("int")).drop("blocks")
    queries = store(rows.where(F.col("vec_id") % every == 0).select("vec_id", "v").mapInArrow(placed(True), schema).withColumnRenamed("vec_id", "query_id"), "queries")

    first = store(_visit(index, queries.withColumn("worst", F.lit(float("-inf"))), most, k, stop), "first")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = first.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    worst = ranked.groupBy("query_id").agg(F.when(F.max("rank") == k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("worst"))
    asked = queries.join(worst, "query_id", "left").withColumn("worst", F.coalesce("worst", F.lit(float("-inf"))))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, cells = shared.value
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                v, p = _matrix(part.column(1)), _matrix(part.column(2))
                far = 2 - 2 * np.minimum(part.column(4).to_numpy(zero_copy_only=False) / (most * np.linalg.norm(v, axis=1)), 1.0)
                at, cell = np.nonzero((cells.bound(p) <= far[:, None] * stop) & (np.arange(len(cells.low))[None] != part.column(3).to_numpy()[:, None]))
                own = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), pa.array(cell.astype(np.int32)), own.column(4)], names=["query_id", "v", "p", "cell", "worst"])

    spread = asked.select("query_id", "v", "p", "cell", "worst").mapInArrow(reach, "query_id long, v array<double>, p array<double>, cell int, worst double")
    rest = _visit(index, store(spread, "asked"), most, k, stop)
    found = first.unionByName(rest).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
