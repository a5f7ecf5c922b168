"""Queries of the sources that are files: archives, a crawl from a cache of them, and arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.ranking import scratch, shared_path
from textloom.plans.registry import query, table
from textloom.sources import archive, readers


@query("src_zip_members", "SELECT page_id || '.html' AS member, CAST(strlen(html) AS BIGINT) AS size, sha256(html) AS sha256, FALSE AS failed FROM pages WHERE page_id IS NOT NULL AND html IS NOT NULL")
def src_zip_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages out into archives, one for each task, and back from ranges of their bytes."""
    path = shared_path(spark, "pages-zip")
    archive.write_members(table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("member"), F.col("html").alias("content")), path)
    back = archive.read_members(spark, path)
    return back.select("member", "size", F.sha2("content", 256).alias("sha256"), F.col("error").isNotNull().alias("failed"))


_BASE, _OWN, _NEW, _OLD = "https://example.org", "000000", "新字新仮名", "旧字旧仮名"
_PLAIN = r"[^\t\n\r -~]"


def _ascii(c: Column) -> Column:
    """Without characters that the first encoding tried would read otherwise."""
    return F.regexp_replace(c, _PLAIN, "?")


def _cache(docs: DataFrame) -> DataFrame:
    """(i, li, html, zip, content): each document's entry in a list, its card and its archive, some of which are missing or bad."""
    i = F.col("doc_id")
    person, id_ = F.lpad((i % 7).cast("string"), 6, "0"), i.cast("string")
    li = F.concat(F.lit('<li><a href="../cards/'), person, F.lit("/card"), id_, F.lit('.html">Work '), id_, F.lit(f"</a>（{_NEW}、作品ID："), id_, F.lit("）</li>"))
    zip_ = F.concat(id_, F.when(i % 2 == 0, "_ruby_").otherwise("_txt_"), id_, F.lit(".zip"))
    kana = F.when(i % 5 == 0, _OLD).otherwise(_NEW)
    row = lambda k, v: F.concat(F.lit(f'<tr><td class="header">{k}：</td><td>'), v, F.lit("</td></tr>"))
    link = F.when(i % 11 == 3, "").otherwise(F.concat(F.lit('<a href="./files/'), zip_, F.lit('">archive</a>')))
    card = F.concat(F.lit("作品データ"), row("分類", F.concat(F.lit("NDC "), (i % 1000).cast("string"))), row("文字遣い種別", kana), F.lit("作家データ"), row("分類", F.lit("著者")), link)
    body = _ascii(F.col("text")).cast("binary")
    two = i % 19 == 0
    inner = archive.zipped(F.when(two, F.array(F.lit("a.txt"), F.lit("b.TXT"))).otherwise(F.array(F.lit("a.txt"))), F.when(two, F.array(body, body)).otherwise(F.array(body)))
    content = F.when(i % 17 == 0, None).when(i % 23 == 0, F.lit("no archive").cast("binary")).when(F.col("text").isNotNull(), inner)
    return docs.select(i.alias("i"), li.alias("li"), F.when(i % 13 != 5, card).alias("html"), zip_.alias("zip"), content.alias("content"))


_WHY = "CASE WHEN doc_id % 13 = 5 THEN 'no card page' WHEN doc_id % 11 = 3 THEN 'no archive named' WHEN doc_id % 17 = 0 OR text IS NULL AND doc_id % 23 <> 0 THEN 'archive not cached' WHEN doc_id % 23 = 0 THEN 'BadZipFile: File is not a zip file' WHEN doc_id % 19 = 0 THEN '2 text members' END"


@query("src_crawl_cache", f"SELECT *, sha256(body) AS sha256, CAST(length(body) AS BIGINT) AS chars FROM (SELECT CAST(doc_id AS VARCHAR) AS card_id, 'Work ' || doc_id AS title, doc_id % 7 = 0 AS own_work, CASE WHEN doc_id % 13 <> 5 THEN 'NDC ' || doc_id % 1000 END AS ndc, CASE WHEN doc_id % 13 <> 5 AND doc_id % 11 <> 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'ruby' ELSE 'noruby' END END AS text_kind, CASE WHEN doc_id % 13 <> 5 AND doc_id % 5 = 0 THEN '{_OLD}' END AS kana_type_mismatch, {_WHY} IS NOT NULL AS external_host, {_WHY} AS evidence, CASE WHEN {_WHY} IS NULL THEN 'cp932' END AS source_encoding, CASE WHEN {_WHY} IS NULL THEN regexp_replace(text, '{_PLAIN}', '?', 'g') END AS body FROM documents)")
def src_crawl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of all documents from a cache: list pages, cards, and archives within archives.

    The cache is made from the documents first, with cards, links and archives missing and bad
    by their ids; each failure is a row with its reason.
    """
    cache = scratch(_cache(table(spark, sf_dir, "documents")), "cache")
    pages = cache.groupBy(F.floor(F.col("i") / 64)).agg(F.concat(F.lit('<a name="works">'), F.array_join(F.sort_array(F.collect_list("li")), ""), F.lit('<a name="end">')).alias("html"))
    path = shared_path(spark, "fetched")
    archive.write_members(cache.select(F.col("zip").alias("member"), "content"), path, stored=True)
    works = readers.list_entries(pages, "html", "works", "end", _OWN, _BASE)
    cards = cache.where("html is not null").select(F.col("i").cast("string").alias("card_id"), "html")
    fetched = archive.read_members(spark, path).select(F.col("member").alias("name"), "content")
    got = readers.crawl_records(works, cards, fetched, _BASE)
    return got.select("card_id", "title", "own_work", "ndc", "text_kind", "kana_type_mismatch", "external_host", "evidence", "source_encoding", F.col("text").alias("body"), "sha256", "chars")


@query("src_number_array", "SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, vec_id, CAST(len(embedding) AS INT) AS dims, CAST(embedding[1] AS DOUBLE) AS first, TRUE AS same FROM embeddings")
def src_number_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors out into one array file with their ids beside it, and back from ranges of its rows: no number changes."""
    e, path = table(spark, sf_dir, "embeddings"), f"{shared_path(spark, 'array')}/vectors.npy"
    archive.write_array(e.select(F.col("vec_id").alias("i"), F.col("embedding").alias("v")), path, 64)
    ids = archive.read_array(spark, f"{path}.ids.npy").select("i", F.col("v").alias("vec_id"))
    back = archive.read_array(spark, path).join(ids, "i").join(e, "vec_id")
    return back.select("i", "vec_id", F.size("v").alias("dims"), F.element_at("v", 1).cast("double").alias("first"), (F.col("v") == F.col("embedding")).alias("same"))
