"""Topics: class-based TF-IDF, representatives, counts by work, year and genre."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.ranking import scratch
from textloom.operators.search import dot

# Terms of a topic, and the least total of a term.
TOP_TERMS, MIN_TOTAL = 10, 5


def class_counts(docs: DataFrame, id_col: str, terms: Column, labels: DataFrame) -> DataFrame:
    """(label, term, f) of `labels` (doc, label): documents get their label before they are cut into terms, so what is shuffled is texts, not postings."""
    named = docs.join(labels.select(F.col("doc").alias("_doc"), F.col("label").alias("_label")), F.col(id_col) == F.col("_doc"))
    return named.select(F.col("_label").alias("label"), F.explode(terms).alias("term")).groupBy("label", "term").agg(F.count(F.lit(1)).alias("f"))


def class_tfidf(f: DataFrame, k: int, topn: int = TOP_TERMS, min_total: int = MIN_TOTAL) -> DataFrame:
    """(label, term, score, rank): (f / n_class) * ln(1 + A / total), where A is all tokens over k.

    `f` is (label, term, f), as `class_counts` gives it, and is written once. Terms of fewer than
    `min_total` tokens are left out after the totals are taken; ties go to the
    smaller term.
    """
    f = scratch(f, "counts")
    n = f.groupBy("label").agg(F.sum("f").alias("n"))
    total = f.groupBy("term").agg(F.sum("f").alias("total"))
    a = n.agg((F.sum("n") / max(k, 1)).alias("a"))
    rows = f.join(total.where(F.col("total") >= min_total), "term").join(n, "label").crossJoin(F.broadcast(a))
    scored = rows.withColumn("score", F.col("f") / F.col("n") * F.log(1 + F.col("a") / F.col("total")))
    order = Window.partitionBy("label").orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= topn).select("label", "term", "score", "rank")


def count_vectors(labels: DataFrame, key: Column, k: int) -> DataFrame:
    """(key, t0 .. t<k-1>): how many passages of each topic; null keys are left out."""
    named = labels.withColumn("key", key).where("key is not null")
    return named.groupBy("key").agg(*[F.count_if(F.col("label") == j).alias(f"t{j}") for j in range(k)])


def sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))


def centroids(vectors: DataFrame, vec_col: str) -> DataFrame:
    """(label, c): componentwise means."""
    parts = vectors.select("label", F.posexplode(vec_col).alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return parts.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))


def representatives(vectors: DataFrame, vec_col: str, top: int = 3) -> DataFrame:
    """(label, doc, rank, score): the passages with the largest product with their topic's mean."""
    rows = vectors.join(centroids(vectors, vec_col), "label").select("label", "doc", dot(F.col(vec_col), F.col("c")).alias("score"))
    order = Window.partitionBy("label").orderBy(F.desc(F.round("score", 9)), "doc")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def concentration(labels: DataFrame, works: int = 8) -> DataFrame:
    """(label, size, span, top_work, top_share, works): how much of a topic is one work's; `labels` has `work`."""
    per = labels.groupBy("label", "work").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("label").orderBy(F.desc("n"), "work")
    ranked = per.withColumn("r", F.row_number().over(order))
    named = F.transform(F.sort_array(F.collect_list(F.when(F.col("r") <= works, F.struct("r", "work")))), lambda s: s["work"])
    return ranked.groupBy("label").agg(
        F.sum("n").alias("size"), F.count(F.lit(1)).alias("span"), F.max(F.when(F.col("r") == 1, F.col("work"))).alias("top_work"),
        F.round(F.max("n") / F.sum("n"), 3).alias("top_share"), named.alias("works"),
    )


def shares(counts: DataFrame, group: str, of: str, value: str) -> DataFrame:
    """Each value over its group's total."""
    return counts.withColumn("share", F.col(value) / F.sum(value).over(Window.partitionBy(group))).select(group, of, "share")
