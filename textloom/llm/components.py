"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's neighbours on the least of them: the larger ones only, or the smaller and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    turned = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if large:
        seen = both.unionByName(turned)
        least = store(seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        out = seen.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        down = both.unionByName(turned).where("v < u")
        least = store(down.groupBy("u").agg(F.min("v").alias("m")), "least")
        own = least.select(F.col("u").alias("a"), F.col("m").alias("b"))
        out = own.unionByName(down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b): the least node that it reaches.

    No edges give no rows. Each round is written to the shared folder, so the
    plan stays short; the edges never outnumber the input's. A node with very
    many neighbours is a hot join key. It has a single row on the other side, which
    is stored before the join: adaptive execution splits a join of two plain
    exchanges, and not one with an aggregate in it.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct()
    edges = store(edges, "edges")
    mark = None
    while True:
        edges = store(_star(store(_star(edges, True), "large"), False), "edges")
        row = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    roots = edges.groupBy("b").agg(F.lit(0)).select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
