"""What a reader or an encoder is given: paragraphs as segments, and passages with their context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.kana import to_modern
from textloom.functions.markup import base_text
from textloom.functions.text import with_context


def segments(docs: DataFrame, id_col: str, body: Column) -> DataFrame:
    """(id, para, seq, kind, text, ruby): the nodes of a body by paragraph; blank paragraphs are left out.

    A node's paragraph is the number of line ends in the text nodes before it.
    """
    nodes = docs.select(F.col(id_col).alias("id"), F.posexplode(body).alias("pos", "n"))
    parts = F.when(F.col("n.kind") == "t", F.split("n.raw", "\n")).otherwise(F.array(F.lit("")))
    counted = nodes.withColumn("parts", parts).withColumn("ends", F.size("parts") - 1)
    before = F.coalesce(F.sum("ends").over(Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = counted.withColumn("start", before).select("id", "pos", "n", "start", F.posexplode("parts").alias("i", "part"))
    text = F.when(F.col("n.kind") == "t", F.replace("part", F.lit("\r"), F.lit(""))).when(F.col("n.kind") == "r", base_text(F.col("n"))).otherwise(F.col("n.raw"))
    rows = each.select("id", "pos", "i", (F.col("start") + F.col("i")).alias("p"), F.col("n.kind").alias("kind"), text.alias("text"), F.col("n.ruby").alias("ruby"))
    rows = rows.where("kind != 't' or text != ''")
    shown = F.bool_or((F.col("kind") != "t") | ~F.col("text").rlike(r"^(?U)\s*$")).over(Window.partitionBy("id", "p"))
    rows = rows.withColumn("shown", shown).where("shown")
    para = F.dense_rank().over(Window.partitionBy("id").orderBy("p")) - 1
    seq = F.row_number().over(Window.partitionBy("id", "p").orderBy("pos", "i")) - 1
    return rows.select("id", para.alias("para"), seq.alias("seq"), "kind", "text", "ruby")


def passages(chunks: DataFrame, works: DataFrame, on: str, text: str, title: str, genre: str, year: str, modern: bool = False, context: bool = True, subset: DataFrame | None = None) -> DataFrame:
    """Chunks as an encoder takes them: raw or in modern spelling, with or without their work's heading, all works or a subset."""
    rows = chunks.join(works.select(on, title, genre, year), on)
    if subset is not None:
        rows = rows.join(subset.select(on), on, "left_semi")
    body = to_modern(F.col(text)) if modern else F.col(text)
    return rows.withColumn("passage", with_context(body, F.col(title), F.col(genre), F.col(year)) if context else body)
