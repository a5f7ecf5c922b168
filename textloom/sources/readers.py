"""Readers: whole texts, encodings, archives, catalogue pages, and a cache of fetched files."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.slices import by_rows
from textloom.functions.text import section, squeeze, strip_tags

# Encodings in the order in which they are tried.
HTML_ENCODINGS = ("utf-8", "cp932", "euc_jp")
TEXT_ENCODINGS = ("cp932", "shift_jis_2004", "utf-8", "euc_jp")
KANA_TYPES = ("新字新仮名", "新字旧仮名", "旧字旧仮名", "旧字新仮名")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text): one row per file, line ends as they are."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("name"), F.col("value").alias("text"))


def cached_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(name, content): the files of a fetch cache; what is not in it is not fetched."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def _first_decoding(raw: bytes, encodings: tuple[str, ...]) -> tuple[str | None, str | None]:
    for name in encodings:
        try:
            return raw.decode(name), name
        except UnicodeDecodeError:
            continue
    return None, None


def decode(content: Column, encodings: tuple[str, ...] = TEXT_ENCODINGS) -> Column:
    """struct(text, encoding): by the first encoding that holds; nulls if none does."""
    result = pa.struct([("text", pa.string()), ("encoding", pa.string())])
    return by_rows(lambda b: (None, None) if b is None else _first_decoding(bytes(b), encodings), "struct<text:string,encoding:string>", result, content)


def extract_text(archive: Column) -> Column:
    """struct(text, member, encoding, error) of the one .txt member of a zip archive; an error is data."""

    def run(raw):
        try:
            with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
                names = [n for n in z.namelist() if n.lower().endswith(".txt")]
                if len(names) != 1:
                    return None, None, None, f"{len(names)} text members"
                text, encoding = _first_decoding(z.read(names[0]), TEXT_ENCODINGS)
                return text, names[0], encoding, None if encoding else "unknown encoding"
        except Exception as e:  # the reason is part of the record
            return None, None, None, f"{type(e).__name__}: {e}"

    result = pa.struct([(c, pa.string()) for c in ("text", "member", "encoding", "error")])
    return by_rows(run, "struct<text:string,member:string,encoding:string,error:string>", result, archive)


def list_entries(pages: DataFrame, html_col: str, start: str, end: str | None, own_person: str, base: str) -> DataFrame:
    """Works of list pages: one row per list item between two anchors.

    The title is the anchor's text and what follows it up to the trailing
    parenthesis, which names spelling and work id; an arrow after that names
    another person and their role. Items of another form have an `error`.
    """
    item = F.explode(F.regexp_extract_all(section(F.col(html_col), start, end), F.lit(r"(?s)<li>(.*?)</li>"), F.lit(1)))
    rows = pages.select(item.alias("li"))
    link = r'(?s)<a href="(?:\.\./cards/|/cards/)?(\d{6})/card(\d+)\.html"[^>]*>(.*?)</a>(.*)'
    rest = strip_tags(F.regexp_extract("li", link, 4))
    tail = f"（({'|'.join(KANA_TYPES)})、作品ID：(\\d+)）"
    anchor, after = squeeze(strip_tags(F.regexp_extract("li", link, 3))), squeeze(F.regexp_extract(rest, f"(?s)^(.*?){tail}", 1))
    other = "→([^(（]+)[(（]([^)）]+)[)）]"
    beyond = F.regexp_extract(rest, f"(?s){tail}(.*)$", 3)
    person, card = F.regexp_extract("li", link, 1), F.regexp_extract("li", link, 2)
    error = F.when(~F.col("li").rlike(link), "no entry").when(~rest.rlike(tail), "no spelling type")
    return rows.select(
        card.alias("card_id"), F.regexp_extract(rest, tail, 2).alias("work_id"), F.trim(F.concat_ws(" ", anchor, F.nullif(after, F.lit("")))).alias("title"),
        F.regexp_extract(rest, tail, 1).alias("kana_type"), F.concat(F.lit(f"{base}/cards/"), person, F.lit("/card"), card, F.lit(".html")).alias("card_url"),
        person.alias("person_id"), (person == own_person).alias("own_work"),
        F.when(beyond.rlike(other), F.struct(squeeze(F.regexp_extract(beyond, other, 1)).alias("name"), F.regexp_extract(beyond, other, 2).alias("role"))).alias("other_author"),
        error.alias("error"),
    )


def card_fields(html: Column, work_table: str = "作品データ", person_table: str = "作家データ") -> Column:
    """The rows of a card's work table as a map, the first of each key; other tables are not read."""
    a = F.locate(work_table, html)
    b = F.when(a > 0, F.locate(person_table, F.substr(html, a + 1))).otherwise(0)
    own = F.when((a > 0) & (b > 0), F.substr(html, a, b)).otherwise(html)
    pattern = r'(?s)<td class="header">([^<]*?)：?</td>\s*<td>(.*?)</td>'
    keys = F.transform(F.regexp_extract_all(own, F.lit(pattern), F.lit(1)), lambda k: squeeze(strip_tags(k)))
    vals = F.transform(F.regexp_extract_all(own, F.lit(pattern), F.lit(2)), lambda v: squeeze(strip_tags(v)))
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(keys), F.lit(1))), lambda i: (i <= F.size(keys)) & (F.get(keys, i - 1) != "") & (F.array_position(keys, F.get(keys, i - 1)) == i))
    return F.map_from_entries(F.transform(at, lambda i: F.struct(F.get(keys, i - 1), F.get(vals, i - 1))))


def card_archive(html: Column, base: str, person: Column) -> Column:
    """struct(ruby_zip_url, text_zip_url, text_kind): the archive with readings if there is one, else the plain one."""
    find = lambda kind: F.nullif(F.regexp_extract(html, rf'href="\./files/(\d+_{kind}_\d+\.zip)"', 1), F.lit(""))
    url = lambda name: F.concat(F.lit(f"{base}/cards/"), person, F.lit("/files/"), name)
    ruby, text = find("ruby"), find("txt")
    kind = F.when(ruby.isNotNull(), "ruby").when(text.isNotNull(), "noruby")
    return F.struct(url(ruby).alias("ruby_zip_url"), url(F.coalesce(ruby, text)).alias("text_zip_url"), kind.alias("text_kind"))


def crawl_records(works: DataFrame, cards: DataFrame, archives: DataFrame, base: str) -> DataFrame:
    """Catalogue records from a fetch cache: every work, with its text or with why there is none.

    `works` is what `list_entries` gives, `cards` (card_id, html), `archives`
    (name, content). A work without card, archive or readable text is kept, with
    external_host true and the reason as evidence.
    """
    w = works.where("error is null").join(cards, "card_id", "left")
    w = w.withColumn("z", card_archive(F.col("html"), base, F.col("person_id"))).withColumn("fields", card_fields(F.col("html")))
    w = w.withColumn("zip", F.element_at(F.split("z.text_zip_url", "/"), -1))
    got = w.join(archives.select(F.col("name").alias("zip"), extract_text(F.col("content")).alias("x")), "zip", "left")
    why = F.when(F.col("html").isNull(), "no card page").when(F.col("z.text_zip_url").isNull(), "no archive named").when(F.col("x").isNull(), "archive not cached").otherwise(F.col("x.error"))
    card_kana = F.try_element_at("fields", F.lit("文字遣い種別"))
    return got.select(
        "card_id", "work_id", "title", "kana_type", "own_work", "other_author", "z.text_kind", F.try_element_at("fields", F.lit("分類")).alias("ndc"),
        F.try_element_at("fields", F.lit("初出")).alias("shoshutsu"), F.when(card_kana != F.col("kana_type"), card_kana).alias("kana_type_mismatch"),
        why.isNotNull().alias("external_host"), why.alias("evidence"), F.col("x.member").alias("member"), F.col("x.encoding").alias("source_encoding"),
        F.length("x.text").cast("long").alias("chars"), F.sha2(F.col("x.text"), 256).alias("sha256"), F.col("x.text").alias("text"),
    )


def number_lines(files: DataFrame, name_col: str = "name", text_col: str = "text") -> DataFrame:
    """(name, line, raw): physical lines from 1."""
    return files.select(F.col(name_col).alias("name"), F.posexplode(F.split(F.col(text_col), "\r?\n")).alias("line", "raw")).withColumn("line", F.col("line") + 1)
