"""Years, series and genres of works from catalogue strings, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# The year before each era's first, digits, and genres by class code.
ERAS = {"明治": 1867, "大正": 1911, "昭和": 1925}
KANJI_DIGITS = "〇一二三四五六七八九"
WIDE_DIGITS = "０１２３４５６７８９"
GENRE_BY_CODE = {
    "913": "小説", "914": "随筆・評論", "915": "紀行・日記", "912": "戯曲", "910": "随筆・評論", "901": "随筆・評論",
    "816": "随筆・評論", "795": "随筆・評論", "796": "随筆・評論", "779": "随筆・評論", "775": "随筆・評論",
}
ERA_PATTERN = f"({'|'.join(ERAS)})([0-9{WIDE_DIGITS}{KANJI_DIGITS}十百]+)"


def to_int(s: Column) -> Column:
    """A number in digits, or in kanji up to 99 with a ten or as a single digit; positional kanji is null."""
    s = F.translate(s, WIDE_DIGITS, "0123456789")
    digit = lambda c: F.when(c.rlike(f"^[{KANJI_DIGITS}]$"), F.instr(F.lit(KANJI_DIGITS), c) - 1)
    at = F.locate("十", s)
    tens, ones = F.substr(s, F.lit(1), at - 1), F.substr(s, at + 1, F.length(s))
    with_ten = F.when(tens == "", 1).otherwise(F.coalesce(digit(tens), F.lit(1))) * 10 + F.coalesce(digit(ones), F.lit(0))
    return F.when(s.rlike("^[0-9]+$"), s.cast("int")).when(at > 0, with_ten).when(F.length(s) == 1, digit(s)).cast("int")


def era_year(era: Column, number: Column) -> Column:
    base = F.create_map(*map(F.lit, chain(*ERAS.items())))
    return (F.element_at(base, era) + to_int(number)).cast("int")


def years_of(s: Column) -> Column:
    """struct(ad, era): the first year from 1800 to 1999, and the first era year, each null if absent."""
    ad = F.nullif(F.regexp_extract(s, "(1[89][0-9]{2})", 1), F.lit("")).cast("int")
    era = F.when(s.rlike(ERA_PATTERN), era_year(F.regexp_extract(s, ERA_PATTERN, 1), F.regexp_extract(s, ERA_PATTERN, 2)))
    return F.struct(ad.alias("ad"), era.alias("era"))


def resolve_year(card: Column, footer: Column) -> Column:
    """struct(year, source, conflict): from two strings, the one whose calendars agree if they differ, else by era, else the card's."""
    c, f = years_of(card), years_of(footer)
    yc, yf = F.coalesce(c["ad"], c["era"]), F.coalesce(f["ad"], f["era"])
    pick = lambda year, source: F.struct(year.cast("int").alias("year"), F.lit(source).cast("string").alias("source"))
    differs = F.coalesce(yc != yf, F.lit(False))
    agrees = lambda y: F.coalesce(y["ad"] == y["era"], F.lit(False))
    chosen = (
        F.when(differs & agrees(c), pick(c["ad"], "card"))
        .when(differs & agrees(f), pick(f["ad"], "footer"))
        .when(differs & c["era"].isNotNull(), pick(c["era"], "card"))
        .when(differs & f["era"].isNotNull(), pick(f["era"], "footer"))
        .when(yc.isNotNull(), pick(yc, "card"))
        .when(yf.isNotNull(), pick(yf, "footer"))
        .otherwise(pick(F.lit(None), None))
    )
    # Without any era the card's year stands and the difference is not marked.
    marked = differs & (c["era"].isNotNull() | f["era"].isNotNull())
    return F.struct(chosen["year"].alias("year"), chosen["source"].alias("source"), marked.alias("conflict"))


def series_of(title: Column) -> Column:
    """struct(name, no) of a title `name NN ...`; null parts for others."""
    pattern = r"^(?U)([^\n]+?)\s(\d{2})\s"
    return F.struct(F.nullif(F.regexp_extract(title, pattern, 1), F.lit("")).alias("name"), F.nullif(F.regexp_extract(title, pattern, 2), F.lit("")).cast("int").alias("no"))


def genre_of(codes: Column, title: Column, by_series: dict[str, str] | None = None, by_code: dict[str, str] = GENRE_BY_CODE) -> Column:
    """struct(genre, source): of the series if it is known, else of the first known three-digit code, else needs_review."""
    table = lambda d: F.create_map(*map(F.lit, chain(*d.items()))) if d else F.create_map().cast("map<string,string>")
    name = series_of(title)["name"]
    series = F.when(name.isNotNull(), F.try_element_at(table(by_series or {}), name))
    found = F.transform(F.regexp_extract_all(codes, F.lit("[0-9]{3}"), F.lit(0)), lambda c: F.try_element_at(table(by_code), c))
    code = F.try_element_at(F.filter(found, lambda g: g.isNotNull()), F.lit(1))
    source = F.when(series.isNotNull(), "series").when(code.isNotNull(), "code").otherwise("needs_review")
    return F.struct(F.coalesce(series, code).alias("genre"), source.alias("source"))


def first_publication(footer: Column) -> Column:
    """The first-publication block of a footer, its white space squeezed; null without one."""
    block = F.regexp_extract(footer, r"(?s)初出：(.*?)(?=\n[^　\s]|\z)", 1)
    return F.when(footer.contains("初出："), F.trim(F.regexp_replace(block, r"(?U)\s+", " ")))
