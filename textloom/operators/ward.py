"""Ward's clustering of a whole table, exact at any size: mutual nearest neighbours are merged in rounds.

Ward's method is reducible: a merge never brings a third cluster nearer. So all
pairs of clusters that are each other's nearest can merge at once, and the tree
is that of merging one pair at a time. A cluster is its centroid and its size;
its name is the least number of its rows.

Clusters compare in passes over all pairs, each once, in blocks. A pass gives
edges: each cluster's `LEAST` cheapest pairs up to a cost that a sample of clusters
sets, and with them its bound: all its pairs up to the bound are edges. A merged
cluster keeps the edges of its two halves, at new costs, and a bound that follows
from theirs, so many rounds go over edges alone before a next pass. About half
of the clusters merge from one pass to the next.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import blocks
from textloom.operators.ranking import scratch

#: Clusters in a block, and blocks at least; clusters from which the driver ends the tree, to the same result.
BLOCK, SIDES, FEW = 16384, 13, 2048
#: Edges that a cluster has of its own, the neighbour whose cost sets how far a pass reaches, and the clusters that are asked for it.
LEAST, REACH, ASKED = 64, 8, 128
#: Numbers in the vectors of edges that end on the driver; rounds that merge a smaller share of the clusters give way to a pass.
NUMBERS, SHARE = 10_000_000, 0.003
MERGES = "a long, b long, height double, size long"
EDGE = "x long, y long, d double"
LAST = 2**63 - 1


def _costs(v: np.ndarray, sizes: np.ndarray, w: np.ndarray, others: np.ndarray) -> np.ndarray:
    return 2 * sizes * others / (sizes + others) * ((v - w) ** 2).sum(axis=-1)


def _reached(asked: list, j: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The j least costs of each asked cluster with those of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = [np.empty(0)] * len(asked)
        for batch in batches:
            for low in range(0, batch.num_rows, 8192):
                some = batch.slice(low, 8192)
                ids, sizes = some.column(0).to_numpy(), some.column(1).to_numpy()
                v = some.column(2).flatten().to_numpy().reshape(len(ids), -1)
                for i, q in enumerate(asked):
                    d = _costs(np.asarray(q.v), q.size, v, sizes)[ids != q.c]
                    least[i] = np.sort(np.concatenate([least[i], np.partition(d, j)[:j] if len(d) > j else d]))[:j]
        at = np.repeat(np.arange(len(asked)), [len(d) for d in least])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.concatenate(least))], names=["q", "d"])

    return run


def reach(active: DataFrame, j: int = REACH) -> float:
    """The median cost of a cluster and its j-th nearest, over a sample of clusters: it sets how far a pass looks, not what is merged."""
    asked = active.orderBy(F.xxhash64("c"), "c").limit(ASKED).collect()
    near = active.select("c", "size", "v").mapInArrow(_reached(asked, j), "q long, d double")
    last = near.groupBy("q").agg(F.slice(F.array_sort(F.collect_list("d")), 1, j).alias("d")).select(F.array_max("d")).collect()
    return float(np.median([r[0] for r in last]))


def _pruned(x: np.ndarray, y: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (x < y) that are among the k least of either cluster. Pairs go by cost, then by their names."""
    keep = np.zeros(len(d), dtype=bool)
    for of in (x, y):
        by = np.lexsort((y, x, d, of))
        first = np.flatnonzero(np.concatenate([[True], of[by][1:] != of[by][:-1]])) if len(by) else by
        keep[by] |= np.arange(len(by)) - np.repeat(first, np.diff([*first, len(by)])) < k
    return x[keep], y[keep], d[keep]


def _near(one: blocks.Rows, other: blocks.Rows, same: bool, h: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of two parts that cost at most h; of clusters with more than k of them at least the k least.

    2st / (s + t) |v - w|^2 <= h is 2vw - p - q >= 0 with p = |v|^2 - h / 2s and q = |w|^2 - h / 2t: one product finds what
    may be near, in single precision where its error is small beside h, and costs are taken from differences in double.
    """
    norm, o_norm = (one.v**2).sum(axis=1), (other.v**2).sum(axis=1)
    p, q = norm - h / (2 * one.sizes), o_norm - h / (2 * other.sizes)
    scale = 2 * np.sqrt(norm.max() * o_norm.max()) + np.abs(p).max() + np.abs(q).max()
    tight = h / 2 * (1 / one.sizes.max() + 1 / other.sizes.max())
    terms = one.v.shape[1] + 4
    kind = np.float32 if 1e-30 < scale < 1e30 and 1.2e-7 * terms * scale < 0.05 * tight else np.float64
    slack = (1.2e-7 if kind is np.float32 else 4.5e-16) * terms * scale
    left = np.column_stack([2 * one.v, np.full(len(p), -1.0), -p]).astype(kind)
    right = np.ascontiguousarray(np.column_stack([other.v, q, np.ones(len(q))]).astype(kind).T)
    step = max(1, 2**20 // len(q))
    kept, held = [], 0
    for low in range(0, len(p), step):
        hit = np.flatnonzero(left[low : low + step] @ right >= -slack)
        for a in range(0, len(hit), 2**16):
            i, j = np.divmod(hit[a : a + 2**16], len(q))
            i += low
            if same:
                up = one.ids[i] < other.ids[j]
                i, j = i[up], j[up]
            d = _costs(one.v[i], one.sizes[i], other.v[j], other.sizes[j])
            ok = d <= h
            x, y = one.ids[i[ok]], other.ids[j[ok]]
            kept.append((np.minimum(x, y), np.maximum(x, y), d[ok]))
            held += len(x)
            if held > 2**20:
                kept = [_pruned(*map(np.concatenate, zip(*kept)), k)]
                held = len(kept[0][0])
    return _pruned(*map(np.concatenate, zip(*kept)), k) if kept else (np.empty(0, "<i8"), np.empty(0, "<i8"), np.empty(0))


def _met(h: float, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                same = batch.column("block")[at].as_py() == batch.column("r_block")[at].as_py()
                found = _near(blocks.Rows(batch, at), blocks.Rows(batch, at, "r_"), same, h, k)
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in found], names=["x", "y", "d"])

    return run


def _key(d: str = "d", x: str = "x", y: str = "y") -> Column:
    """Pairs go by cost, then by their names: an order that both sides of a pair agree on."""
    return F.struct(F.col(d).alias("d"), F.col(x).alias("x"), F.col(y).alias("y"))


def edges(active: DataFrame, n: int, h: float, k: int = LEAST) -> DataFrame:
    """(x, y, d, bx, by): each cluster's k least pairs of cost up to h, with the bounds of both; `active` is (c, size, v), of n clusters.

    All pairs of a cluster up to its bound, in the order of pairs, are edges.
    """
    many = max(-(-n // BLOCK), min(SIDES, -(-n // 256))) | 1  # odd, so that half a turn meets each pair of blocks once
    rows = active.select(F.col("c").alias("id"), F.col("size").cast("double").alias("size"), "v")
    packed = blocks.pack(rows, blocks.by_hash(many), many, "clusters", 1)
    turn = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many // 2).cast("long")))
    pairs = active.sparkSession.range(many).select(F.col("id").alias("block"), turn.alias("k")).select("block", F.pmod(F.col("block") + F.col("k"), F.lit(many)).alias("r_block"))
    found = blocks.meet(packed, packed, pairs=pairs).mapInArrow(_met(h, k), EDGE)
    sides = found.select(F.explode(F.array("x", "y")).alias("c"), _key().alias("key"))
    ranked = sides.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy("key"))).where(F.col("r") <= k)
    ranked = scratch(ranked, "ranked")
    full = F.struct(F.lit(h).alias("d"), F.lit(LAST).alias("x"), F.lit(LAST).alias("y"))
    bounds = ranked.groupBy("c").agg(F.when(F.count(F.lit(1)) < k, full).otherwise(F.max("key")).alias("b"))
    bound = lambda c: bounds.select(F.col("c").alias(c), F.col("b").alias(f"b{c}"))
    return ranked.select("key.*").distinct().join(bound("x"), "x").join(bound("y"), "y").select("x", "y", "d", "bx", "by")


def _grown(na, nb, ba, bb, d):
    """The least that a merged cluster costs with one that neither half has an edge to: it grows with the other's size, which is 1 at least."""
    return ((na + 1) * ba + (nb + 1) * bb - d) / (na + nb + 1) * (1 - 1e-12)


def _merged(edge: DataFrame, active: DataFrame) -> DataFrame:
    """(a, b, d, size, v, bound): the pairs of edges that are each other's nearest, within the bounds of both."""
    side = F.explode(F.array(F.struct(F.col("x").alias("c"), F.col("bx").alias("b")), F.struct(F.col("y").alias("c"), F.col("by").alias("b")))).alias("s")
    best = edge.select(_key().alias("key"), F.col("bx.d").alias("ba"), F.col("by.d").alias("bb"), side)
    best = best.groupBy("s.c").agg(F.min(F.struct("key", (F.col("key") <= F.col("s.b")).alias("ok"), "ba", "bb")).alias("m")).where("m.ok")
    pairs = best.groupBy("m.key").agg(F.count(F.lit(1)).alias("n"), F.first("m.ba").alias("ba"), F.first("m.bb").alias("bb")).where("n = 2")
    pairs = pairs.select(F.col("key.x").alias("a"), F.col("key.y").alias("b"), F.col("key.d").alias("d"), "ba", "bb")
    left = active.select(F.col("c").alias("a"), F.col("size").alias("m"), F.col("v").alias("v"))
    right = active.select(F.col("c").alias("b"), F.col("size").alias("k"), F.col("v").alias("w"))
    both = F.zip_with("v", "w", lambda p, q: (p * F.col("m") + q * F.col("k")) / (F.col("m") + F.col("k")))
    bound = _grown(F.col("m"), F.col("k"), F.col("ba"), F.col("bb"), F.col("d"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "d", (F.col("m") + F.col("k")).alias("size"), both.alias("v"), bound.alias("bound"))


def _moved(edge: DataFrame, made: DataFrame, active: DataFrame) -> DataFrame:
    """The edges after merges: those of merged clusters go to the new ones, at new costs; `active` has these."""
    bound = F.struct(F.col("bound").alias("d"), F.lit(-1).cast("long").alias("x"), F.lit(-1).cast("long").alias("y"))
    to = made.select(F.explode(F.array("a", "b")).alias("c"), "a", bound.alias("b"))
    for c in ("x", "y"):
        edge = edge.join(to.select(F.col("c").alias(c), F.col("a").alias(f"{c}_to"), F.col("b").alias(f"{c}_b")), c, "left")
    new = edge.select(F.coalesce("x_to", "x").alias("x"), F.coalesce("y_to", "y").alias("y"), "d", F.coalesce("x_b", "bx").alias("bx"), F.coalesce("y_b", "by").alias("by"), F.coalesce("x_to", "y_to").isNotNull().alias("new"))
    still = new.where("not new").select("x", "y", "d", "bx", "by")
    turned = F.col("x") > F.col("y")
    new = new.where("new and x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.when(turned, F.col("by")).otherwise(F.col("bx")).alias("bx"), F.when(turned, F.col("bx")).otherwise(F.col("by")).alias("by"))
    new = new.dropDuplicates(["x", "y"])
    new = new.join(active.select(F.col("c").alias("x"), F.col("size").alias("m"), "v"), "x").join(active.select(F.col("c").alias("y"), F.col("size").alias("k"), F.col("v").alias("w")), "y")
    square = F.aggregate(F.zip_with("v", "w", lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, x: s + x)
    new = new.select("x", "y", (2 * F.col("m") * F.col("k") / (F.col("m") + F.col("k")) * square).alias("d"), "bx", "by")
    return still.unionByName(new).where((_key() <= F.col("bx")) | (_key() <= F.col("by")))


def _after(active: DataFrame, made: DataFrame) -> DataFrame:
    """The clusters after merges."""
    gone = made.select(F.explode(F.array("a", "b")).alias("c"))
    return active.join(gone, "c", "left_anti").unionByName(made.where("v is not null").select(F.col("a").alias("c"), "size", "v"))


def _spent(edge: pa.Table, rows: pa.Table) -> list[tuple[int, int, float, float, list[float] | None]]:
    """(a, b, d, size, v): the merges that a few edges hold, one by one; the last merge of a cluster has its vector, others none.

    The least edge of all is that of both its clusters. If it is over the bound of one, neither can merge before the next pass, nor can
    a cluster whose least edge goes to one of them.
    """
    ids = rows["c"].to_numpy()
    at = {c: i for i, c in enumerate(ids.tolist())}
    v = rows["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1).copy()
    size = rows["size"].to_numpy().astype(float).copy()
    x, y, d = (edge[c].to_pylist() for c in ("x", "y", "d"))
    bound, near = {}, {}
    for c, b in ((x, "bx"), (y, "by")):
        for name, *of in zip(c, *(edge[f"{b}_{part}"].to_pylist() for part in "dxy")):
            bound[name] = tuple(of)
    for one, other, cost in zip(x, y, d):
        near.setdefault(one, {})[other] = near.setdefault(other, {})[one] = cost
    heap = list(zip(d, x, y))
    heapq.heapify(heap)
    stuck: set[int] = set()
    out, last = [], {}
    while heap:
        key = cost, a, b = heapq.heappop(heap)
        if near.get(a, {}).get(b) != cost:
            continue
        if a in stuck or b in stuck or key > bound[a] or key > bound[b]:
            stuck |= {a, b}
            continue
        i, j = at[a], at[b]
        bound[a] = (_grown(size[i], size[j], bound[a][0], bound[b][0], cost), -1, -1)
        both = size[i] + size[j]
        v[i], size[i] = (size[i] * v[i] + size[j] * v[j]) / both, both
        around = sorted((near[a].keys() | near[b].keys()) - {a, b})
        to = [at[c] for c in around]
        for c in near.pop(b):
            near[c].pop(b)
        near[a] = {}
        for c, new in zip(around, _costs(v[i], size[i], v[to], size[to]).tolist()):
            near[a][c] = near[c][a] = new
            heapq.heappush(heap, (new, min(a, c), max(a, c)))
        last.pop(b, None)
        last[a] = len(out)
        out.append((a, b, cost, float(both), None))
    for a, k in last.items():
        out[k] = (*out[k][:4], v[at[a]].tolist())
    return out


def _ended(rows: list) -> list[tuple[int, int, float, int]]:
    """The merges of a few clusters one by one: at each step the least pair in the order."""
    if len(rows) < 2:
        return []
    rows = sorted(rows, key=lambda r: r.c)
    v, size, name = np.array([r.v for r in rows], dtype=float), np.array([r.size for r in rows], dtype=float), [r.c for r in rows]
    cost = np.array([2 * size * n / (size + n) * ((v - x) ** 2).sum(axis=1) for x, n in zip(v, size)])
    np.fill_diagonal(cost, np.inf)
    near = cost.argmin(axis=1)  # rows are in order of name, so the first least of all rows is that of the order
    least = cost[np.arange(len(rows)), near]
    out = []
    for _ in range(len(rows) - 1):
        i = int(least.argmin())
        i, j = sorted((i, int(near[i])))
        both = size[i] + size[j]
        out.append((name[i], name[j], float(np.sqrt(cost[i, j])), int(both)))
        v[i], size[i], size[j] = (size[i] * v[i] + size[j] * v[j]) / both, both, 0
        d = 2 * size * size[i] / np.maximum(size + size[i], 1) * ((v - v[i]) ** 2).sum(axis=1)
        cost[i] = cost[:, i] = np.where(size > 0, d, np.inf)
        cost[i, i] = np.inf
        cost[j] = cost[:, j] = np.inf
        stale = np.flatnonzero((near == i) | (near == j))  # a merge brings no third cluster nearer
        stale = np.union1d(stale[size[stale] > 0], [i])
        near[stale] = cost[stale].argmin(axis=1)
        least[stale] = cost[stale, near[stale]]
        least[j] = np.inf
    return out


def merges(numbered: DataFrame, few: int = FEW) -> DataFrame:
    """(a, b, height, size): every merge of the tree over rows (c, v), c a number of its own for each.

    b is merged into a, a < b, both named by their least row. Equal vectors are
    merged first, at height 0, each into the least, with the size of them all. A
    tree of n rows has n - 1 merges.
    """
    spark = numbered.sparkSession
    active = scratch(numbered.groupBy("v").agg(F.min("c").alias("c"), F.count(F.lit(1)).cast("double").alias("size")).select("c", "size", "v"), "active")
    copies = numbered.join(active.select(F.col("c").alias("a"), "size", "v"), "v").where("c > a")
    done = [copies.select("a", F.col("c").alias("b"), F.lit(0.0).alias("height"), F.col("size").cast("long").alias("size"))]
    n = active.count()
    while n > few:
        before = n
        edge = scratch(edges(active, n, reach(active)), "edges")
        some = NUMBERS // max(1, len(active.first().v))
        while n > few:
            if edge.count() <= some:
                flat = edge.select("x", "y", "d", *[F.col(f"{b}.{c}").alias(f"{b}_{c}") for b in ("bx", "by") for c in "dxy"]).toArrow()
                ends = edge.select(F.explode(F.array("x", "y")).alias("c")).distinct()
                last = _spent(flat, active.join(ends, "c", "left_semi").toArrow())
                made = scratch(spark.createDataFrame(last, "a long, b long, d double, size double, v array<double>"), "made")
            else:
                last, made = None, scratch(_merged(edge, active), "made")
            m = made.count()
            done.append(made.select("a", "b", F.sqrt("d").alias("height"), F.col("size").cast("long").alias("size")))
            active = scratch(_after(active, made), "active")
            n -= m
            if last is not None or m < SHARE * n:
                break
            edge = scratch(_moved(edge, made, active), "edges")
        if n == before:
            raise ArithmeticError("costs of merging are not finite")
    done.append(spark.createDataFrame(_ended(active.collect()), MERGES))  # `few` rows at most
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def cut(numbered: DataFrame, tree: DataFrame, k: int) -> DataFrame:
    """(c, root): the tree cut into k clusters, each named by its least row. Of merges of one height the larger goes first."""
    top = tree.orderBy(F.desc("height"), F.desc("size"), F.desc("a"), F.desc("b")).limit(max(0, k - 1)).select("b")  # k - 1 rows
    up = scratch(numbered.select("c").join(tree.join(top, "b", "left_anti").select(F.col("b").alias("c"), "a"), "c", "left").select("c", F.coalesce("a", "c").alias("root")), "up")
    while True:
        over = up.select(F.col("c").alias("root"), F.col("root").alias("next"))
        up = scratch(up.join(over, "root").select("c", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "up")
        if not up.where("moved").limit(1).count():
            return up.select("c", "root")
        up = up.select("c", "root")


def ward(points: DataFrame, id_col: str, vec_col: str, k: int, few: int = FEW) -> DataFrame:
    """(id, label): the k clusters of Ward's tree over all rows, exact at any size, labels numbered by the least id in each.

    Rows without a vector, or with null or non-finite components, take no part; rows that repeat an id or vector count each;
    a table of no more rows than k has a cluster for each. An empty table gives no rows.
    Work grows as the square of distinct vectors, in blocks that any number of machines share: a product of all pairs some one
    and a half times over. Where that is too much, `clusters.ward_of_centroids` sums a table up first.
    """
    rows = points.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where("v is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    rows = scratch(rows.withColumn("c", F.monotonically_increasing_id()), "rows")
    got = cut(rows, scratch(merges(rows.select("c", "v"), few), "merges"), k)
    named = rows.select("id", "c").join(got, "c")
    least = named.groupBy("root").agg(F.min("id").alias("least")).withColumn("label", F.row_number().over(Window.orderBy(F.asc_nulls_first("least"), "root")) - 1)  # k rows
    return named.join(least, "root").select("id", "label")
