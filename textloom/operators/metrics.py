"""Retrieval metrics over nullable ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.ranking import running_total

#: A hit beyond this rank does not count. (The first rank past 100 still does: fixed value.)
LAST_RANK = 101


def gold_ranks(placed: DataFrame, queries: DataFrame, last: int = LAST_RANK) -> DataFrame:
    """(q, rank): the best rank of a gold row of each of `queries` (q), null if none comes up to `last`.

    `placed` is (q, doc, rank) of the gold rows alone, as `search.ranks` counts them.
    """
    hit = placed.where(F.col("rank") <= last).groupBy("q").agg(F.min("rank").alias("rank"))
    return queries.select("q").distinct().join(hit, "q", "left")


def summary(ranks: DataFrame) -> DataFrame:
    """(n, recall1, recall5, recall10, mrr, median_rank): shares are of all queries, the median of the found ones."""
    n = F.count(F.lit(1))
    within = lambda k: F.round(F.count_if(F.col("rank") <= k) / n, 4)
    mrr = F.round(F.sum(F.coalesce(1 / F.col("rank"), F.lit(0.0))) / n, 4)
    return ranks.agg(n.alias("n"), within(1).alias("recall1"), within(5).alias("recall5"), within(10).alias("recall10"), mrr.alias("mrr"), F.floor(F.median("rank")).cast("int").alias("median_rank"))


def with_twins(gold: DataFrame, twins: DataFrame) -> DataFrame:
    """Gold rows and the rows that correspond to them, in either direction. `twins` is (a, b)."""
    both = twins.select(F.col("a").alias("doc"), F.col("b").alias("twin")).union(twins.select(F.col("b"), F.col("a")))
    more = gold.join(both, "doc").select("q", F.col("twin").alias("doc"))
    return gold.select("q", "doc").union(more).distinct()


def index_quantile(values: Column, q: float) -> Column:
    """The element at floor(n * q) of the sorted values, from 0: no interpolation."""
    ordered = F.sort_array(F.collect_list(values))
    return F.element_at(ordered, F.floor(F.size(ordered) * q).cast("int") + 1)


def ranked_quantiles(rows: DataFrame, value: str, qs: dict[str, float]) -> DataFrame:
    """The same of a whole table, by rank instead of a collected list: one row."""
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("c"))  # equal values are one row before anything is sorted
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    at = running_total(counts, [F.col(value)], F.col("c"), "i").crossJoin(F.broadcast(n))
    hit = lambda q: (F.col("i") <= F.floor(F.col("n") * q)) & (F.floor(F.col("n") * q) < F.col("i") + F.col("c"))
    return at.agg(*[F.max(F.when(hit(q), F.col(value))).alias(name) for name, q in qs.items()])
