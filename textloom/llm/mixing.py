"""Mixing sources to target weights by the cube method.

A source's target over its size gives each of its documents the same expected
number of copies: the whole part is taken outright, and the fraction is an
inclusion probability. The cube method turns these into 0 or 1: it moves the
probabilities of a few documents at a time along the null-space of the
constraints, which keeps the sums of documents and of tokens as they are, until
one more of them is whole. Blocks of a source do so side by side; the few
documents that each leaves undecided form the blocks of the next level. Where a
source is a single block it lands: its largest documents are decided first, all
others giving way, then the rest, and the smallest last. When both constraints
leave no direction, that of documents is given up, then that of tokens. Every
move is drawn so that no probability's mean changes, down to the last document.
"""

from __future__ import annotations

from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import ROW, TMP, global_rank, numbered, store, told_apart

#: Documents of one flight; a source has as many blocks as it needs.
BLOCK = 4096
#: Weights by a source's place in code-point order, repeating.
WEIGHTS = (1, 2, 3)
#: A target is at most this many times its source's size.
MOST = 3
SEED = 20240607
#: In a landing: documents of so many times the mean size are decided first, and so many of the smallest last.
LARGE, LANDING = 8, 48
EPS = 1e-9


def _count(text: Column) -> Column:
    """The number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> list[Column]:
    """doc_id, source and size of the rows of `docs`: size is the number of words, 0 for null."""
    return [docs[id_col].cast("long").alias("doc_id"), docs[source_col].cast("string").alias("source"), _count(docs[text_col]).alias("size")]


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: float = MOST) -> DataFrame:
    """(source, source_size, n, target): `share` of all sizes dealt out by weight, none above its ceiling.

    A round divides what sources at their ceiling leave among the others by
    weight, and ends when no further source reaches its own. The level never
    falls, so a source once at its ceiling stays there.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    ranked = global_rank(by, [F.col("source").asc_nulls_last()], f"{TMP}rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col(f"{TMP}rank") % len(weights) + 1).cast("int"))
    ranked = store(ranked.select("source", "source_size", "n", weight.alias("w"), (F.col("source_size") * float(most)).alias("cap")), "sources")
    goal, level = share * (ranked.agg(F.sum("source_size")).first()[0] or 0), 0.0
    while True:
        open_ = F.col("cap") > F.col("w") * level
        row = ranked.agg(F.sum(F.when(open_, F.col("w"))), F.sum(F.when(~open_, F.col("cap")))).first()
        if not row[0]:
            break
        higher = (goal - (row[1] or 0.0)) / row[0]
        if higher <= level * (1 + 1e-12):
            break
        level = higher
    return ranked.select("source", "source_size", "n", F.least("cap", F.col("w") * F.lit(level)).alias("target"))


def flight(p: list[float], size: list[int], rnd: Random) -> None:
    """Make all but two at most of the probabilities `p` whole, in place, keeping their sum and that of p * size.

    Three undecided documents at a time leave one direction that both sums allow;
    the step to either end of it is drawn so that no probability's mean moves.
    """
    free: list[int] = []
    for i, x in enumerate(p):
        if EPS < x < 1 - EPS:
            free.append(i)
        if len(free) < 3:
            continue
        a, b, c = free
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])
        if not any(u):
            u = (1, -1, 0)
        _step(p, free, u, rnd)
        free = [k for k in free if EPS < p[k] < 1 - EPS]


def _step(p: list[float], at: list[int], u: tuple, rnd: Random) -> None:
    up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(at, u) if x)
    down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(at, u) if x)
    go = up if rnd.random() < down / (up + down) else -down
    for k, x in zip(at, u):
        v = p[k] + go * x
        p[k] = 0.0 if v < EPS else 1.0 if v > 1 - EPS else v


def _direction(p: np.ndarray, size: np.ndarray) -> np.ndarray | None:
    """A direction for these documents with 1 for the first, that keeps both sums if it can, else that of tokens; none if nothing can."""
    if len(p) < 2:
        return None
    s = size / max(1.0, float(size.max()))
    w = p[1:] * (1 - p[1:])
    a = np.array([[w.sum(), (w * s[1:]).sum()], [(w * s[1:]).sum(), (w * s[1:] ** 2).sum()]])
    b = np.array([1.0, s[0]])
    x = np.linalg.lstsq(a, b, rcond=1e-10)[0]
    if np.abs(a @ x - b).max() > 1e-7:
        x = np.array([0.0, s[0] / a[1, 1]]) if a[1, 1] > 1e-12 else None
    return None if x is None else np.r_[1.0, -(x[0] + x[1] * s[1:]) * w]


def settle(p: np.ndarray, size: np.ndarray, rnd: Random, enough=lambda size: False) -> None:
    """Decide documents in place, the largest first and all the others giving way, until `enough` says so of the largest left."""
    free = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    free = free[np.argsort(-size[free], kind="stable")]
    while len(free) and not enough(size[free[0]]):
        u = _direction(p[free], size[free])
        if u is None:
            p[free[0]] = float(rnd.random() < p[free[0]])  # the last one: no constraint is left
        else:
            moved = np.abs(u) > 1e-12
            at, u = free[moved], u[moved]
            room = np.where(u > 0, 1 - p[at], p[at]) / np.abs(u), np.where(u > 0, p[at], 1 - p[at]) / np.abs(u)
            up, down = float(room[0].min()), float(room[1].min())
            p[at] += u * (up if rnd.random() < down / (up + down) else -down)
            p[at[p[at] < EPS]] = 0.0
            p[at[p[at] > 1 - EPS]] = 1.0
        free = free[(p[free] > EPS) & (p[free] < 1 - EPS)]


def land(p: np.ndarray, size: np.ndarray, rnd: Random) -> None:
    """Decide all documents of a source in place; their mean probabilities stay as they are."""
    large = LARGE * float(size.mean()) if len(size) else 0.0
    settle(p, size, rnd, lambda largest: largest <= large)
    free = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    held = free[np.argsort(size[free], kind="stable")[:LANDING]]
    rest = np.setdiff1d(free, held)
    q = p[rest].tolist()
    flight(q, size[rest].tolist(), rnd)
    p[rest] = q
    settle(p, size, rnd)


def _draw(rows: DataFrame, weights: tuple[int, ...], share: float, most: float, block: int, seed: int) -> DataFrame:
    """`rows` (ROW, doc_id, source, size; stored) with source_size, target and copies.

    Blocks are stretches of a source in the order of ids, so any number of null or
    repeated ids is spread over blocks; the row number parts ties, and as tied
    rows are alike, the rows that are drawn do not depend on it.
    """
    goal = targets(rows, weights, share, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = store(goal.withColumn("ratio", F.least(ratio, F.lit(float(most)))), "targets").withColumnRenamed("source", f"{TMP}source")
    order = [F.col("source").asc_nulls_last(), F.col("doc_id").asc_nulls_first(), "size", ROW]
    ranked = global_rank(rows, order, "place", within=["source"])
    rows = (
        ranked.join(goal, F.col("source").eqNullSafe(F.col(f"{TMP}source")))
        .withColumn("whole", F.floor(F.col("ratio") + EPS).cast("int"))
        .withColumn("p", F.greatest(F.col("ratio") - F.col("whole"), F.lit(0.0)))
        .withColumn("block", F.floor(F.col("place") / block))
        .withColumn("blocks", F.ceil(F.col("n") / block))
        .select(ROW, "doc_id", "source", "size", "source_size", "target", "whole", "p", "place", "block", "blocks")
    )
    schema = rows.schema
    deepest = goal.agg(F.max("n")).first()[0] or 0

    def fly(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        p, size = t["p"].to_numpy().copy(), t["size"].to_numpy().astype(np.float64)
        blocks = t["blocks"][0].as_py()
        rnd = Random(f"{seed} {t['source'][0].as_py()} {key[1].as_py()} {blocks}")
        order = list(range(len(p)))
        rnd.shuffle(order)
        q, s = p[order], size[order]
        if blocks == 1:
            land(q, s, rnd)
        else:
            flown = q.tolist()
            flight(flown, s.tolist(), rnd)
            q = np.array(flown)
        p[order] = q
        return t.set_column(t.schema.get_field_index("p"), "p", pa.array(p))

    done, depth = [], -(-deepest // block)
    while True:
        rows = store(rows.groupBy("source", "block").applyInArrow(fly, schema), "flown")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(rows.where(~open_))
        if depth <= 1:
            break
        depth = -(-depth // (block // 2))
        rows = rows.where(open_).withColumn("block", F.floor(F.col("block") / (block // 2))).withColumn("blocks", F.ceil(F.col("blocks") / (block // 2)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.withColumn("copies", F.col("whole") + F.col("p").cast("int")).select(ROW, "doc_id", "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: float = MOST, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """For every row: doc_id, source, size, source_size, target, copies, taken.

    `copies` is how often the mix takes the row and taken = copies * size. Null
    texts have size 0. Null is a source of its own and comes last. A source of
    size 0 has target 0 and none of its rows is taken. Repeated rows, also with
    null ids, are drawn each on its own. Reruns draw alike. Other columns are
    not read. Texts of any length are counted whole. An empty table gives no rows.
    """
    rows = numbered(docs.select(*sized(docs, id_col, text_col, source_col)), "sizes")
    return _draw(rows, weights, share, most, block, seed).drop(ROW).withColumn("taken", F.col("copies") * F.col("size"))


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, most: float = MOST, block: int = BLOCK, seed: int = SEED, row: Column | None = None) -> DataFrame:
    """The rows of `docs` as often as the mix takes them, each row by itself, whatever its id; columns may have any names.

    Nulls, empty tables and repeated rows are as in `mix`. The draws come back to
    the rows by `row` (see `told_apart`).
    """
    rows = told_apart(docs, row, "documents")
    drawn = _draw(store(rows.select(ROW, *sized(rows, id_col, text_col, source_col)), "sizes"), weights, share, most, block, seed)
    own, copies = f"{TMP}own", f"{TMP}copies"
    drawn = drawn.where("copies > 0").select(F.col(ROW).alias(own), F.col("copies").alias(copies))
    kept = rows.join(drawn.hint("merge"), F.col(ROW) == F.col(own))  # a row for each text taken: never to be broadcast
    again = kept.withColumn(f"{TMP}again", F.explode(F.sequence(F.lit(1), F.col(copies))))
    return again.select(*[F.col(f"`{c}`") for c in docs.columns])
