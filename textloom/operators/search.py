"""Search: a BM25 index over long tables, vector neighbours, and diversified results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators import blocks
from textloom.operators.ranking import scratch

# BM25 parameters, results of one work, results shown.
K1, B = 1.2, 0.75
PER_WORK, TOP = 2, 12
#: Postings of one row, and rows that a task counts before it hands them on.
POSTINGS, COUNTED = 4096, 1 << 18


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, terms) as (doc, term, tf), each counted within itself."""
    for batch in batches:
        coded = pc.list_flatten(batch.column(1)).dictionary_encode()
        n = max(1, len(coded.dictionary))
        pairs, tf = np.unique(pc.list_parent_indices(batch.column(1)).to_numpy() * n + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        for low in range(0, len(pairs), COUNTED):
            some = pairs[low : low + COUNTED]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some // n)), coded.dictionary.take(pa.array(some % n)), pa.array(tf[low : low + COUNTED])], names=["doc", "term", "tf"])


def term_frequencies(docs: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """(doc, term, tf).

    A document is counted where it is read, so no term is shuffled; only where ids repeat are the counts of their rows added up.
    """
    rows = docs.select(F.col(id_col).alias("doc"), terms.alias("terms"))
    counted = rows.mapInArrow(_counted, f"doc {dict(rows.dtypes)['doc']}, term string, tf long")
    if docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return counted
    return counted.groupBy("doc", "term").agg(F.sum("tf").alias("tf"))


def doc_lengths(tf: DataFrame, docs: DataFrame, id_col: str) -> DataFrame:
    """(doc, dl): every document's number of index terms, 0 without any."""
    dl = tf.groupBy("doc").agg(F.sum("tf").alias("dl"))
    return docs.select(F.col(id_col).alias("doc")).join(dl, "doc", "left").select("doc", F.coalesce("dl", F.lit(0)).alias("dl"))


def statistics(lengths: DataFrame) -> DataFrame:
    """(n, avgdl): avgdl is rounded to three decimals and used so."""
    return lengths.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("dl"), 3).alias("avgdl"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def postings(tf: DataFrame, block: int = POSTINGS) -> DataFrame:
    """(term, block, df, base, postings): postings are (doc, tf) in order of doc, in blocks of at most `block` from 0 on.

    df is that of the whole term, and base the document before the block, 0 for the first.
    A term of any length so is many rows; blocks in order are the whole list. Postings are
    shuffled once, by term, and stay there: a list is numbered as it streams by in order of doc.
    """
    by = Window.partitionBy("term").orderBy("doc")
    at = F.row_number().over(by).cast("long") - 1
    rows = tf.where("term is not null").select("term", "doc", "tf", at.alias("at"), F.lag("doc").over(by).alias("last"), F.count(F.lit(1)).over(Window.partitionBy("term")).alias("df"))
    lists = rows.groupBy("term", F.floor(F.col("at") / block).alias("block")).agg(F.first("df").alias("df"), F.max(F.when(F.col("at") % block == 0, F.col("last"))).alias("base"), F.sort_array(F.collect_list(F.struct("doc", "tf"))).alias("postings"))
    return lists.select("term", "block", "df", F.coalesce("base", F.lit(0)).alias("base"), "postings")


def gaps(tf: DataFrame) -> DataFrame:
    """(term, doc, gap): each posting's distance from the one before, the first from 0."""
    by = Window.partitionBy("term").orderBy("doc")
    return tf.select("term", "doc", (F.col("doc") - F.lag("doc", 1, 0).over(by)).alias("gap"))


def score(tf: DataFrame, lengths: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(q, doc, score) of all documents with a term of the query; a term that the query repeats counts again.

    `queries` is (q, term). Its distinct terms prune the postings before anything is joined to them, and
    what is left is written once. Postings are shuffled by document, where they stay until they are added up.
    """
    asked = queries.groupBy("q", "term").agg(F.count(F.lit(1)).alias("times"))
    lengths = scratch(lengths, "lengths")
    hits = scratch(tf.join(asked.select("term").distinct(), "term", "left_semi"), "hits")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = scratch(asked.join(df, "term"), "weights")
    stats = statistics(lengths)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = F.when(F.col("dl") == 0, 1).otherwise(F.col("dl"))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * length / F.col("avgdl")))
    rows = hits.join(lengths.hint("shuffle_hash"), "doc").join(weights, "term").crossJoin(F.broadcast(stats))
    return rows.groupBy("q", "doc").agg(F.sum(part * F.col("times")).alias("score"))


def top(rows: DataFrame, k: int, by: str = "q") -> DataFrame:
    """The k best of each query, score down, then doc up, with their rank."""
    order = Window.partitionBy(by).orderBy(F.desc("score"), "doc")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def diversify(rows: DataFrame, works: DataFrame, k: int = TOP, per_work: int = PER_WORK, skipped: DataFrame | None = None) -> DataFrame:
    """Results in score order with at most `per_work` of a work, then the first k. `works` is (doc, work)."""
    named = rows.join(works, "doc")
    if skipped is not None:
        named = named.join(skipped, "work", "left_anti")
    return _diverse(named, k, per_work)


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Vectors up to which all are one block, queries of one block, queries whose pairs are handed on at a time, rows that are
#: looked at first for a diversified list, and balls of a large table.
BLOCK, QUERY_BLOCK, HANDED, FIRST, BALLS = 8192, 4096, 64, 256, 32

Pick = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
Best = Callable[[DataFrame], DataFrame]
#: Blocks over which the queries of a small table are dealt.
QUERY_BLOCKS = 8


class Balls:
    """Centres with the greatest distance of a row from each, and how many rows they hold: what a ball can hold at most is known from these."""

    def __init__(self, centres: np.ndarray):
        self.centres, self.radius = centres, np.zeros(len(centres))

    def of(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centre of each row, and its distance."""
        far = np.maximum((v**2).sum(axis=1)[:, None] + (self.centres**2).sum(axis=1)[None] - 2 * v @ self.centres.T, 0)
        at = far.argmin(axis=1)
        return at, np.sqrt(((v - self.centres[at]) ** 2).sum(axis=1))

    def most(self, v: np.ndarray) -> np.ndarray:
        """The greatest inner product that each row can have with a row of each ball."""
        return v @ self.centres.T + np.sqrt((v**2).sum(axis=1))[:, None] * self.radius[None]


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _placed(rows: DataFrame, balls: Balls) -> DataFrame:
    """Rows (id, work, v) with their ball and distance from its centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, far = balls.of(_matrix(batch.column(2)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int64)), pa.array(far)], names=["id", "work", "v", "ball", "far"])

    return rows.mapInArrow(run, "id long, work string, v array<double>, ball long, far double")


def _meeting(pick: Pick, other_works: bool, digits: int | None):
    """The matrix product of two parts, of which only what is picked leaves the task; where few reach what a query has already, those do.

    Who reaches it is told by a product in single precision, whose error has a bound; those get their scores in double precision.
    """
    slack = 0.0 if digits is None else 10.0**-digits

    def reaching(asked: blocks.Rows, rows: blocks.Rows) -> Iterator[tuple[slice, np.ndarray | None, np.ndarray | None]]:
        """Stretches of queries with the pairs that may reach what each has; without them where many do, or a query has nothing."""
        with np.errstate(over="ignore", invalid="ignore"):
            v, w = asked.v.astype(np.float32), rows.v.astype(np.float32)
            norm = np.sqrt((asked.v**2).sum(axis=1)) * np.sqrt((rows.v**2).sum(axis=1).max(initial=0))
            floor = (asked.sizes - slack - 2 * (v.shape[1] + 4) * 2.0**-24 * norm - 1e-30).astype(np.float32)
            floor = np.nextafter(floor, np.float32("-inf"))
        sure = np.isfinite(floor).all() and norm.max(initial=0) < 1e30 and np.isfinite(w).all()
        for low in range(0, len(asked.ids), HANDED):
            some = slice(low, low + HANDED)
            reach = v[some] @ w.T >= floor[some][:, None] if sure else None
            if sure and np.count_nonzero(reach) * 64 <= reach.size:
                at = np.flatnonzero(reach)
                yield some, at // reach.shape[1], at % reach.shape[1]
            else:
                yield some, None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                asked, rows = blocks.Rows(batch, at), blocks.Rows(batch, at, "r_")
                names, of = np.unique(rows.works, return_inverse=True)
                own = np.array(asked.works)
                for some, i, j in reaching(asked, rows):
                    if i is not None:  # what is out of reach is not looked at again
                        exact = np.einsum("ij,ij->i", asked.v[some][i], rows.v[j])
                        exact = exact if digits is None else np.round(exact, digits)
                        ok = (asked.ids[some][i] != rows.ids[j]) & (exact >= asked.sizes[some][i])
                        if other_works:
                            ok &= own[some][i] != names[of[j]]
                        i, j, exact = i[ok], j[ok], exact[ok]
                        yield pa.RecordBatch.from_arrays([pa.array(asked.ids[some][i]), pa.array(rows.ids[j]), pa.array(names[of[j]].tolist(), pa.string()), pa.array(exact)], names=["q", "doc", "work", "score"])
                        continue
                    score = asked.v[some] @ rows.v.T
                    score = score if digits is None else np.round(score, digits)
                    score[asked.ids[some][:, None] == rows.ids[None, :]] = -np.inf
                    score[score < asked.sizes[some][:, None]] = -np.inf
                    if other_works:
                        score[own[some][:, None] == names[of][None, :]] = -np.inf
                    i, j = pick(score, rows.ids, of)
                    yield pa.RecordBatch.from_arrays([pa.array(asked.ids[some][i]), pa.array(rows.ids[j]), pa.array(names[of[j]].tolist(), pa.string()), pa.array(score[i, j])], names=["q", "doc", "work", "score"])

    return run


FOUND = "q long, doc long, work string, score double"


def in_blocks(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, pick: Pick, best: Best, k: int, work: str | None = None, other_works: bool = False, digits: int | None = 9, balls: int | None = None) -> DataFrame:
    """(q, doc, work, score): rows among which `best` finds the right k of each query, from matrix products of blocks (exact).

    `pick` gets the scores (queries by rows, minus infinity for what may not be
    found), the rows' ids, and their works as numbers; it gives the places it
    takes. A query's own row is not found, nor with `other_works` one of its work.
    Scores are rounded, so that ties are ties.

    A table of more than a block is dealt into balls around some of its rows. Queries meet
    the ball that they lie in first, which tells a score that their kth best has at least.
    After that they meet those balls alone that can hold such a score, by the triangle
    inequality; on vectors without clusters that is all of them. Balls are few, so that queries are
    copied few times, and large, so that what the first one tells leaves little to hand on.
    """
    named = F.col(work).cast("string") if work else F.lit(None).cast("string")
    rows = lambda df: df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), named.alias("work"), F.col(vec_col).cast("array<double>").alias("v"))
    n = vectors.count()
    if balls is None:
        balls = 1 if n <= BLOCK else min(BALLS, -(-int(n**0.5) // 4))
    meeting = _meeting(pick, other_works, digits)
    never = F.lit(float("-inf")).alias("size")
    if balls == 1:
        right = blocks.pack(rows(vectors).withColumn("size", F.lit(0.0)), F.lit(0), 1, "rows")
        left = blocks.pack(rows(queries).select("*", never), blocks.by_hash(QUERY_BLOCKS), QUERY_BLOCKS, "queries")
        return blocks.meet(left, right, 1).mapInArrow(meeting, FOUND)

    drawn = rows(vectors).orderBy(F.xxhash64("id"), "id").limit(balls).select("v").collect()  # BALLS rows at most
    made = Balls(np.unique(np.array([r.v for r in drawn], dtype=float), axis=0))
    held = scratch(_placed(rows(vectors), made), "placed")
    for r in held.groupBy("ball").agg(F.max("far").alias("far")).collect():  # a row for each ball
        made.radius[r.ball] = r.far * (1 + 1e-9) + 1e-12
    # a part is sent to each that it meets, so parts are as large as they may be
    right = blocks.pack(held.withColumn("size", F.lit(0.0)), F.col("ball"), balls, "rows", 1 if n <= len(made.centres) * blocks.PART else blocks.DEALT)
    spread = max(1, -(-queries.count() // (QUERY_BLOCK * len(made.centres))))
    asked = _placed(rows(queries), made).withColumn("block", F.col("ball") * spread + F.pmod(F.xxhash64("id"), F.lit(spread)))
    asked = scratch(asked, "asked")
    left = blocks.pack(asked.select("*", never), F.col("block"), balls * spread, "queries", 1)
    own = asked.select("block", F.col("ball").alias("r_block")).distinct()
    first = scratch(blocks.meet(left, right, pairs=own).mapInArrow(meeting, FOUND), "first")

    least = best(first).where(F.col("rank") == k).select(F.col("q").alias("id"), F.col("score").alias("size"))
    known = scratch(asked.join(least, "id", "left").select("id", "work", "v", "ball", "block", F.coalesce("size", F.lit(float("-inf"))).alias("size")), "known")
    slack = 0.0 if digits is None else 10.0**-digits

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                can = made.most(_matrix(batch.column(0))) + slack >= batch.column(3).to_numpy()[:, None]
                can[np.arange(len(can)), batch.column(1).to_numpy()] = False
                i, ball = np.nonzero(can)
                pairs = np.unique(np.stack([batch.column(2).to_numpy()[i], ball], axis=1), axis=0) if len(i) else np.zeros((0, 2), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["block", "r_block"])

    more = scratch(known.select("v", "ball", "block", "size").mapInArrow(reach, "block long, r_block long").distinct(), "reach")
    again = blocks.pack(known, F.col("block"), balls * spread, "again", 1)
    return first.unionByName(blocks.meet(again, right, pairs=more).mapInArrow(meeting, FOUND))


def _every(score: np.ndarray, ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.nonzero(score > -np.inf)


def _first(k: int) -> Pick:
    """The k best of a block, and all that tie with the last of them."""

    def pick(score: np.ndarray, ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if score.shape[1] <= k:
            return _every(score, ids, of)
        least = -np.partition(-score, k - 1, axis=1)[:, k - 1]
        return np.nonzero((score >= least[:, None]) & (score > -np.inf))

    return pick


def _first_diverse(k: int, per_work: int) -> Pick:
    """The first k of a block's rows in order, at most `per_work` of a work; a whole ranking's first k are among those of its blocks."""

    def listed(score: np.ndarray, at: np.ndarray, ids: np.ndarray, of: np.ndarray) -> np.ndarray:
        at = at[np.lexsort((ids[at], -score[at]))]
        by = np.argsort(of[at], kind="stable")
        group = of[at][by]
        nth = np.empty(len(at), dtype=np.int64)
        nth[by] = np.arange(len(at)) - np.searchsorted(group, group)
        return at[nth < per_work][:k]

    def pick(score: np.ndarray, ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i, j = _first(FIRST)(score, ids, of)
        edges = np.searchsorted(i, np.arange(len(score) + 1))
        found = []
        for one, (a, b) in enumerate(zip(edges, edges[1:])):
            best = listed(score[one], j[a:b], ids, of)
            if len(best) < k and b - a < len(ids):
                best = listed(score[one], np.flatnonzero(score[one] > -np.inf), ids, of)
            found.append(best)
        return np.repeat(np.arange(len(score)), list(map(len, found))), np.concatenate(found) if found else np.zeros(0, dtype=np.int64)

    return pick


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int, exclude_work: str | None = None, digits: int | None = 9, balls: int | None = None) -> DataFrame:
    """(q, doc, score, rank): the k best other rows of each query, the smaller id on a tie; with `exclude_work` of other works only."""
    best = lambda found: top(found.select("q", "doc", "score"), k)
    return best(in_blocks(vectors, queries, id_col, vec_col, _first(k), best, k, exclude_work, bool(exclude_work), digits, balls))


def passage_search(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, work: str, k: int = TOP, per_work: int = PER_WORK, balls: int | None = None) -> DataFrame:
    """(q, doc, work, score, rank): passages like each query's, at most `per_work` of a work."""
    best = lambda found: _diverse(found, k, per_work)
    return best(in_blocks(vectors, queries, id_col, vec_col, _first_diverse(k, per_work), best, k, work, balls=balls))


def ranks(vectors: DataFrame, queries: DataFrame, gold: DataFrame, id_col: str, vec_col: str, drop: DataFrame | None = None, digits: int = 9) -> DataFrame:
    """(q, doc, rank): the place of each gold row among all rows in order of score, then id, by counting those before it.

    `gold` and `drop` are (q, doc); rows of `drop` are not counted and have no place, nor has
    a query's own row. Gold rows that the table lacks are left out. A block of queries counts
    in each block of rows, so only a number for each gold row and block leaves a task.
    """
    own = lambda df, name, v: df.select(F.col(id_col).cast("long").alias(name), F.col(vec_col).cast("array<double>").alias(v)).where(F.col(v).isNotNull())

    def scored(pairs: DataFrame) -> DataFrame:
        both = pairs.select(F.col("q").cast("long").alias("q"), F.col("doc").cast("long").alias("doc")).where("q <> doc").distinct()
        return both.join(own(queries, "q", "v"), "q").join(own(vectors, "doc", "w"), "doc").select("q", "doc", "v", F.round(dot(F.col("v"), F.col("w")), digits).alias("score"))

    asked = scored(gold if drop is None else gold.select("q", "doc").join(drop, ["q", "doc"], "left_anti"))
    asked = scratch(asked.withColumn("id", F.monotonically_increasing_id()), "gold")
    many = max(1, -(-vectors.count() // BLOCK))
    right = blocks.pack(own(vectors, "id", "v").withColumn("size", F.lit(0.0)), blocks.by_hash(many), many, "rows")
    some = max(QUERY_BLOCKS, -(-asked.count() // QUERY_BLOCK))
    left = blocks.pack(asked.select("id", F.col("score").alias("size"), "v", F.concat_ws(" ", "q", "doc").alias("work")), blocks.by_hash(some), some, "asked")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                gold_, rows = blocks.Rows(batch, at), blocks.Rows(batch, at, "r_")
                names = np.array([list(map(int, w.split())) for w in gold_.works], dtype=np.int64)
                for low in range(0, len(gold_.ids), HANDED):
                    some = slice(low, low + HANDED)
                    score, least = np.round(gold_.v[some] @ rows.v.T, digits), gold_.sizes[some][:, None]
                    before = (score > least) | ((score == least) & (rows.ids[None] < names[some, 1][:, None]))
                    before &= (rows.ids[None] != names[some, 0][:, None]) & (rows.ids[None] != names[some, 1][:, None])
                    yield pa.RecordBatch.from_arrays([pa.array(gold_.ids[some]), pa.array(before.sum(axis=1).astype(np.int64))], names=["id", "n"])

    counts = blocks.meet(left, right, many).mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    placed = asked.select("id", "q", "doc", "score").join(counts, "id")
    if drop is not None:  # of the rows before, those that are not to count
        g, d = placed.alias("g"), scored(drop).select("q", F.col("doc").alias("x"), F.col("score").alias("s")).alias("d")
        ahead = (F.col("d.s") > F.col("g.score")) | ((F.col("d.s") == F.col("g.score")) & (F.col("d.x") < F.col("g.doc")))
        less = g.join(d, (F.col("g.q") == F.col("d.q")) & ahead).groupBy("g.id").agg(F.count(F.lit(1)).alias("less"))
        placed = placed.join(less, "id", "left").withColumn("n", F.col("n") - F.coalesce("less", F.lit(0)))
    return placed.select("q", "doc", (F.col("n") + 1).alias("rank"))


def _diverse(found: DataFrame, k: int, per_work: int) -> DataFrame:
    own = Window.partitionBy("q", "work").orderBy(F.desc("score"), "doc")
    return top(found.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= per_work), k)


def longest_match(query: Column, vocabulary: Column) -> Column:
    """The query cut into vocabulary terms, the longest first at each place; a character that starts none is passed over.

    `vocabulary` is an array column with the terms that can matter.
    """

    @F.udf("array<string>", useArrow=True)
    def cut(text, terms):
        if text is None:
            return None
        known, out, i = set(terms or ()), [], 0
        most = max(map(len, known), default=0)
        while i < len(text):
            n = next((n for n in range(min(most, len(text) - i), 0, -1) if text[i : i + n] in known), 0)
            if n:
                out.append(text[i : i + n])
            i += n or 1
        return out

    return cut(query, vocabulary)
