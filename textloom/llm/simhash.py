"""SimHash near-duplicates by pivot distance tables.

Each text gets a 64-bit fingerprint. Fingerprints at most RADIUS bits apart
differ in at most RADIUS of their blocks of bits, so an equi-join on the bits of
each set of the other blocks meets every pair: pivot distances alone (16 distances
of a few bits' width around 32) would meet most pairs of a large table, so the blocks
bring pairs together, and the pivot table judges them. It holds the distances to
PIVOTS reference fingerprints: where a bucket is large, its rows stand in the order
of their distance to the first and are compared only within RADIUS of it; a pair
is discarded if any of its coordinates differ by more than RADIUS (triangle
inequality); and the survivors are verified bit by bit.

Work is done on distinct fingerprints, so a group of copies is a single row,
and buckets give spanning edges, never all of their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import ROW, TMP, low_words, mix64, partitions, store, told_apart
from textloom.llm.components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
PIVOTS = 16
#: Runs of words whose sets say which texts are near copies, and the least similarity, as a fraction.
WORDS = 5
SIMILARITY = (4, 5)
#: Keys of a text and what each is made of: a pair of similarity 0.8 shares none with chance 0.0008.
BANDS, ROWS = 18, 5
#: Hashes of a block of sets, tasks over which a key's blocks are dealt at most, and the ratio of a step of length: over 5 / 4.
HASHES, DEALT, STEP = 32768, 64, 1.26
#: Rows compared with rows at a time.
BLOCK = 1024
#: The most fingerprints for which so many blocks keep a bucket's chance share at a few dozen.
BLOCKS = ((6, 5e7), (7, 5e9), (8, float("inf")))


def fingerprint(text: str | None) -> int:
    """The SimHash of a text's lower-cased shingles; 0 for a text without words."""
    w = low_words(text)
    if not w:
        return 0
    grams = map(b" ".join, zip(*(w[i:] for i in range(SHINGLE)))) if len(w) >= SHINGLE else [b" ".join(w)]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, SEED) for g in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), 65536):
        ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(text: Column) -> Column:
    """The fingerprint of each text as a signed integer."""

    def run(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), dtype=np.uint64)
        for low in range(0, len(texts), 512):
            out[low : low + 512] = [fingerprint(t) for t in texts.slice(low, 512).to_pylist()]
        return pa.array(out.view(np.int64))

    return F.arrow_udf(run, "long").asNondeterministic()(text)  # so that a plan works it out once, not for each mention


PIVOT = mix64(np.arange(1, PIVOTS + 1, dtype=np.uint64))


def block_bits(fp: np.ndarray, blocks: int) -> list[np.ndarray]:
    """For each block, its bits of every fingerprint."""
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    return [fp >> np.uint64(low) & np.uint64((1 << (high - low)) - 1) for low, high in zip(edges, edges[1:])]


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Distances to the pivots, a column for each."""
    return np.bitwise_count(fp[:, None] ^ PIVOT[None, :]).astype(np.int8)


def linked(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) are links: pivots discard first, then the bits decide."""
    left = np.arange(len(i))
    for p in range(table.shape[1]):
        near = np.abs(table[i[left], p] - table[j[left], p]) <= RADIUS
        left = left[near]
        if not len(left):
            break
    good = left[np.bitwise_count(fp[i[left]] ^ fp[j[left]]) <= RADIUS]
    out = np.zeros(len(i), dtype=bool)
    out[good] = True
    return out


class Forest:
    """Union-find over positions, the least position as the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        for a, b in zip(i.tolist(), j.tolist()):
            a, b = self.find(a), self.find(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        while not np.array_equal(up := self.up[self.up], self.up):
            self.up = up
        return self.up


def bucket_edges(keys: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges of the links within buckets of equal keys, over all buckets given."""
    values, at = np.unique(fp, return_inverse=True)
    table = pivot_table(values)
    order = np.lexsort((table[at, 0], keys))  # in a bucket by the first pivot
    keys, at = keys[order], at[order]
    forest = Forest(len(values))
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=int)
    sizes = np.diff(np.r_[starts, len(keys)])
    small = np.repeat(sizes <= 64, sizes)
    pos = np.flatnonzero(small)
    k = 1
    while len(pos := pos[(pos + k < len(keys))]) and len(pos := pos[keys[pos] == keys[pos + k]]):
        i, j = at[pos], at[pos + k]
        ok = linked(values, table, i, j)
        forest.join(i[ok], j[ok])
        k += 1
    for start, size in zip(starts[sizes > 64], sizes[sizes > 64]):
        here = at[start : start + size]
        for step in (1, 2, 3, 5, 8):
            ok = linked(values, table, here[:-step], here[step:])
            forest.join(here[:-step][ok], here[step:][ok])
        first = table[here, 0]
        for low in range(0, size, BLOCK):
            a = here[low : low + BLOCK]
            for high in range(low, size, BLOCK):
                b = here[high : high + BLOCK]
                if first[high] - first[min(low + BLOCK, size) - 1] > RADIUS:
                    break
                up = forest.roots()
                if (up[a] == up[a[0]]).all() and (up[b] == up[a[0]]).all():
                    continue  # all of them are connected: no pair can add anything
                x, y = np.nonzero((up[a][:, None] != up[b][None, :]) & (np.abs(table[a, 0][:, None] - table[b, 0][None, :]) <= RADIUS))
                ok = linked(values, table, a[x], b[y])
                forest.join(a[x[ok]], b[y[ok]])
    up = forest.roots()
    child = np.flatnonzero(up != np.arange(len(up)))
    return values[child], values[up[child]]


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between fingerprints that connect all of those at most RADIUS bits apart.

    `distinct` (fp long) holds each fingerprint once.
    """
    n = distinct.count()
    blocks = next(b for b, most in BLOCKS if n <= most)
    agree = list(combinations(range(blocks), blocks - RADIUS))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            parts = [mix64(c + np.uint64(b << 32)) for b, c in enumerate(block_bits(fp, blocks))]
            for which, chosen in enumerate(agree):
                key = np.full(len(fp), which, dtype=np.uint64)
                for b in chosen:
                    key = mix64(key * np.uint64(31) + parts[b])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], names=["key", "fp"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts := list(batches):
            t = pa.Table.from_batches(parts)
            a, b = bucket_edges(t.column(0).to_numpy(), t.column(1).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    spread = max(partitions(distinct.sparkSession), n * len(agree) // 2_000_000)
    return distinct.select("fp").mapInArrow(keyed, "key long, fp long").repartition(spread, "key").mapInArrow(met, "a long, b long")


def _rooted(least: DataFrame) -> DataFrame:
    """`least` (fp, least; stored) with the root of each fingerprint's component and the least of all of it as `first`."""
    roots = components(links(least.select("fp")))
    joined = store(least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root")), "joined")
    firsts = store(joined.groupBy("root").agg(F.min("least").alias("first")), "firsts")  # stored, so that a hot root can be split in the join
    return joined.join(firsts, "root").select("fp", "first")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    Null and empty texts have fingerprint zero and link like any other; long ones
    are read whole. A component's id is the least id of its rows; null ids are
    passed over, and a component of null ids alone has a null id. Repeated rows
    come back as often. Other columns are not read. An empty table gives no rows.
    """
    prints = store(docs.select(F.col(id_col).cast("long").alias("doc_id"), fingerprints(F.col(text_col)).alias("fp")), "prints")
    least = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    named = store(_rooted(least).select(F.col("fp").alias(f"{TMP}fp"), F.col("first").alias("component_id")), "named")
    return prints.join(named, F.col("fp") == F.col(f"{TMP}fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_hashes(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's lower-cased runs of WORDS words, or of all its words if fewer; none for a text without words."""
    w = low_words(text)
    if not w:
        return np.zeros(0, dtype=np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(WORDS)))) if len(w) >= WORDS else [b" ".join(w)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), dtype=np.uint64))


_TURN = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) << np.uint64(20)) | np.uint64(1)


def band_keys(h: np.ndarray) -> np.ndarray:
    """BANDS keys of a set of hashes, each made of the least of ROWS scramblings; sets of similarity s share one with chance s ** ROWS."""
    if not len(h):
        return np.zeros(0, dtype=np.int64)
    least = np.full(len(_TURN), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), 2048):
        turned = h[at : at + 2048, None] * _TURN[None, :]
        least = np.minimum(least, (turned ^ (turned >> np.uint64(31))).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mix64(key * np.uint64(31) + least[r::ROWS])
    return key.view(np.int64)


def _signatures(text: Column) -> Column:
    """(fp, digest, keys) of each text: its fingerprint, what tells different word sequences apart, and its band keys."""
    kind = pa.struct([("fp", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64()))])

    def run(texts: pa.Array) -> pa.Array:
        parts = []
        for low in range(0, len(texts), 512):
            some = texts.slice(low, 512).to_pylist()
            fp = np.array([fingerprint(t) for t in some], dtype=np.uint64).view(np.int64)
            digest = [xxhash.xxh3_128_digest(b" ".join(low_words(t))) for t in some]
            keys = pa.array([band_keys(shingle_hashes(t)) for t in some], pa.list_(pa.int64()))
            parts.append(pa.StructArray.from_arrays([pa.array(fp), pa.array(digest, pa.binary()), keys], fields=list(kind)))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return F.arrow_udf(run, "fp long, digest binary, keys array<long>").asNondeterministic()(text)


def _hash_sets(text: Column) -> Column:
    """The shingle hashes of each text, as an array."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([shingle_hashes(t.as_py()).view(np.int64) for t in texts], pa.list_(pa.int64()))

    return F.arrow_udf(run, "array<long>").asNondeterministic()(text)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (a, b) of roots, for the pairs (row_a, row_b, a, b) of texts whose shingles are alike by SIMILARITY or more."""
    x, y = sets.select(F.col(ROW).alias("row_a"), F.col("set").alias("set_a")), sets.select(F.col(ROW).alias("row_b"), F.col("set").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    either = F.size("set_a") + F.size("set_b") - both
    # In whole numbers, so that a similarity of exactly 4 / 5 is in.
    return pairs.join(x, "row_a").join(y, "row_b").where(SIMILARITY[1] * both >= SIMILARITY[0] * either).select("a", "b").distinct()


def _merged(named: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """`named`, whose `root` becomes the least root that `edges` connect it with."""
    to = components(edges).select(F.col("node").alias("root"), "component")
    return store(named.join(to, "root", "left").select(*[F.coalesce("component", "root").alias(c) if c == "root" else c for c in named.columns]), name)


def _blocks(headed: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, deal, cell, out, part, texts): the texts of `headed` (key, top, root, row) with their sets, in blocks of some HASHES hashes.

    `cell` is a step of length: texts alike by SIMILARITY are at most one step apart, as a step is a
    ratio of more than 5 / 4. `out` tells texts outside the key's largest root, `deal` how many tasks a key's
    blocks are dealt over. A block exceeds its size by a single long text, and by chance.
    """
    size = F.size("set").cast("long")
    member = headed.join(sets.withColumnRenamed(ROW, "row"), "row").select("key", "row", "root", "set", F.floor(F.log(size) / np.log(STEP)).alias("cell"), (F.col("root") != F.col("top")).alias("out"))
    member = store(member, "members")
    weight = store(member.groupBy("key", "cell", "out").agg(F.sum(size).alias("w")), "weights")
    all_of = weight.groupBy("key").agg(F.sum("w").alias("all"))
    parts = store(weight.join(all_of, "key").select("key", "cell", "out", F.ceil(F.col("w") / HASHES).alias("parts"), F.least(F.lit(DEALT), F.ceil(F.col("all") / (8 * HASHES))).alias("deal")), "parts")
    part = F.pmod(F.xxhash64("row"), F.col("parts")).alias("part")
    placed = member.join(parts, ["key", "cell", "out"]).select("key", "deal", "cell", "out", part, "root", "set")
    return store(placed.groupBy("key", "deal", "cell", "out", "part").agg(F.collect_list(F.struct("root", "set")).alias("texts")), "blocks")


def _alike_sets(x: pa.StructArray, y: pa.StructArray) -> set[tuple[int, int]]:
    """The pairs of different roots of `x` and `y` (root, set) of which two texts are alike."""
    y_root, y_set = y.field("root").to_numpy(), y.field("set")
    y_size = pc.list_value_length(y_set).to_numpy()
    order = np.argsort(flat := y_set.flatten().to_numpy(), kind="stable")
    known, owner = flat[order], np.repeat(np.arange(len(y_root)), y_size)[order]
    found: set[tuple[int, int]] = set()
    for root, own in zip(x.field("root").to_pylist(), x.field("set")):
        left = [r for r in np.unique(y_root).tolist() if r != root and (root, r) not in found]
        if not left:
            continue
        h = own.values.to_numpy()
        low, high = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
        many = high - low
        at = np.arange(many.sum()) + np.repeat(low - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
        both = np.bincount(owner[at], minlength=len(y_root))
        # In whole numbers, so that a similarity of exactly 4 / 5 is in.
        alike = SIMILARITY[1] * both >= SIMILARITY[0] * (len(h) + y_size - both)
        found |= {(root, r) for r in np.unique(y_root[alike]).tolist() if r != root}
    return found


def _met_in_blocks(blocks: DataFrame) -> DataFrame:
    """Edges (a, b) of roots with texts alike: each block of a key's texts outside its largest root meets the key's blocks of like length.

    Sets are sent once for each pair of blocks, and no pair of texts is a row.
    """
    x = blocks.where("out").withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deal") - 1))).alias("x")
    y = blocks.withColumn("to", F.pmod(F.xxhash64("cell", "out", "part"), F.col("deal"))).alias("y")
    near = F.abs(F.col("x.cell") - F.col("y.cell")) <= 1
    once = ~F.col("y.out") | (F.struct("x.cell", "x.part") <= F.struct("y.cell", "y.part"))
    met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.to") == F.col("y.to")) & near & once).select(F.col("x.texts").alias("x"), F.col("y.texts").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edges = sorted(set().union(*(_alike_sets(a.values, b.values) for a, b in zip(*batch.columns))))
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return store(met.mapInArrow(run, "a long, b long").distinct(), "met")


def _alike(rows: DataFrame, text: Column, posts: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all roots with texts alike that share a band key; `posts` (stored) holds (key, root, row) of distinct texts.

    A key whose texts all have one root is left alone. For each other key, a text of each
    root is first compared with one of a single root, so that a large group in many parts
    comes together; then every text outside the key's largest root is compared with
    all texts of other roots and like length, in blocks, so no pair within the largest is made, and none that is not
    connected is passed over.
    """
    mixed = posts.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    posts = store(posts.join(store(mixed.select("key"), "mixed"), "key"), "posts")
    needed = store(posts.select(F.col("row").alias(f"{TMP}asked")).distinct(), "needed")
    kept = rows.join(needed.hint("merge"), F.col(ROW) == F.col(f"{TMP}asked"), "left_semi")
    sets = store(kept.select(ROW, _hash_sets(text).alias("set")), "sets")

    one = store(posts.groupBy("key", "root").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n")), "one")
    centre = store(one.groupBy("key").agg(F.max_by(F.struct("root", "row"), F.struct("n", "root")).alias("c")), "centre")
    star = one.join(centre, "key").where("root != c.root").select(F.col("row").alias("row_a"), F.col("c.row").alias("row_b"), F.col("root").alias("a"), F.col("c.root").alias("b"))
    first = store(_verified(star.distinct(), sets), "first")

    posts = _merged(posts, first, "posts")
    counts = store(posts.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")), "counts")
    top = counts.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    headed = store(posts.join(store(top.select("key", "top"), "top"), "key"), "headed")
    return first.unionByName(_met_in_blocks(_blocks(headed, sets)))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """`docs` with one row of each component: that of the least id, a null id coming last, any one of those that repeat it.

    Texts are linked if their fingerprints are at most RADIUS bits apart or if the
    sets of their runs of WORDS words are alike by SIMILARITY or more. 64 bits do not tell
    the latter from less, so band keys bring those pairs together that fingerprints
    have not connected, and the sets decide. Texts of fewer words are one run.

    Rows are told apart by `row` (see `told_apart`), so a text stays even if its id
    repeats, and rows with null ids are compared like any others. Null, empty and
    long texts and empty tables are as in `near_duplicates`; columns may have any names.
    """
    rows = told_apart(docs, row, "documents")
    own = F.struct(F.col(id_col).isNull().alias("void"), F.col(id_col).cast("long").alias("id"), F.col(ROW).alias("row"))
    prints = store(rows.select(_signatures(F.col(text_col)).alias("s"), own.alias("own")).select("s.*", "own"), "prints")
    texts = store(prints.groupBy("digest", "fp").agg(F.min_by("keys", "own").alias("keys"), F.min("own").alias("own")), "texts")
    roots = components(links(texts.select("fp").distinct()))
    named = texts.join(roots, texts["fp"] == roots["node"], "left").select("own", "keys", F.coalesce("component", "fp").alias("root"))
    named = store(named, "named")
    posts = store(named.select(F.explode("keys").alias("key"), "root", F.col("own.row").alias("row")), "posts")
    named = _merged(named.select("own", "root"), _alike(rows, F.col(text_col), posts), "merged")
    stays = store(named.groupBy("root").agg(F.min("own").alias("first")).select(F.col("first.row").alias(f"{TMP}stays")), "stays")
    # As many rows as texts that stay: never to be broadcast, at any size.
    return rows.join(stays.hint("merge"), F.col(ROW) == F.col(f"{TMP}stays"), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
