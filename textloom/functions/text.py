"""Text scalar functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.kana import KANJI

#: Sentence ends: the reference set, and one for Latin text.
ENDS, LATIN_ENDS = "。！？", ".!?"
#: Space that is not text at either end of a line: ideographic space, space, tab.
INDENT = "　 \t"
#: Where str.splitlines() parts lines (fixed values).
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def lines(text: Column) -> Column:
    return F.split(text, LINE_BREAK)


def plain(text: Column) -> Column:
    """Lines without indentation at either end, joined: what lengths are measured on."""
    strip = lambda x: F.regexp_replace(x, f"^[{INDENT}]+|[{INDENT}]+$", "")
    return F.array_join(F.transform(lines(text), strip), "")


def sentences(text: Column, ends: str = ENDS) -> Column:
    """Sentences of the plain text, each with its end mark; a rest counts if it is not blank."""
    parts = F.regexp_extract_all(plain(text), F.lit(f"(?s)[^{ends}]*[{ends}]|[^{ends}]+$"), F.lit(0))
    return F.filter(parts, lambda x: ~x.rlike(r"^(?U)\s*$"))


def speech_chars(text: Column) -> Column:
    """Characters inside outermost quotation brackets, line by line; an open one runs to the line's end."""

    def one(line: Column) -> Column:
        zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("inside"))

        def step(acc: Column, c: Column) -> Column:
            opens, closes = c.isin("「", "『"), c.isin("」", "』")
            depth = F.when(opens, acc["depth"] + 1).when(closes, F.greatest(acc["depth"] - 1, F.lit(0))).otherwise(acc["depth"])
            counts = (acc["depth"] > 0) & ~(closes & (acc["depth"] == 1))
            return F.struct(depth.alias("depth"), (acc["inside"] + counts.cast("int")).alias("inside"))

        return F.aggregate(F.split(line, ""), zero, step, lambda acc: acc["inside"])

    quoted = F.filter(lines(text), lambda x: x.rlike("[「『]"))
    return F.aggregate(F.transform(quoted, one), F.lit(0), lambda a, x: a + x).cast("long")


def skeleton(text: Column, keep: str = KANJI) -> Column:
    """Only the characters of a class: a frame that spelling does not touch."""
    return F.regexp_replace(text, f"[^{keep}]", "")


def grams(s: Column, n: int) -> Column:
    """The distinct character n-grams, by a lookahead that slides over the text."""
    return F.array_distinct(F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def is_index_term(surface: Column, pos2: Column | None = None, single: str = KANJI) -> Column:
    """Not a numeral; two characters or more, or a single one of the class."""
    ok = (F.length(surface) >= 2) | surface.rlike(f"^[{single}]$")
    return ok if pos2 is None else ok & (F.coalesce(pos2, F.lit("")) != "数詞")


def with_context(text: Column, title: Column, genre: Column, year: Column) -> Column:
    """A heading of title, genre and year, those that are there, before the text."""
    head = F.concat_ws("／", title, F.when(genre != "", genre), F.when(year != 0, F.concat(year.cast("string"), F.lit("年"))))
    return F.concat(head, F.lit("\n"), text)


def period(year: Column, unknown: str = "不明") -> Column:
    """The period of a year: up to 1937, 1945, 1949, or later (fixed values)."""
    return (
        F.when(year.isNull(), unknown)
        .when(year <= 1937, "初期(–1937)")
        .when(year <= 1945, "戦中(1938–45)")
        .when(year <= 1949, "戦後(1946–49)")
        .otherwise("晩年(1950–)")
    )


def note_shape(note: Column) -> Column:
    """A note's type: what it quotes and counts is blanked out."""
    return F.regexp_replace(F.regexp_replace(note, "「[^」]*」", "「…」"), r"(?U)\d+", "N")


def snippet(text: Column, most: int = 220) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("…"))).otherwise(text)


def escape_html(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def squeeze(text: Column) -> Column:
    """Runs of white space, ideographic space too, to one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)[\s　]+", " "))


def section(html: Column, start: str, end: str | None = None) -> Column:
    """From the anchor named `start` up to that named `end`, or to the end; null without `start`."""
    a = F.locate(f'name="{start}"', html)
    b = F.locate(f'name="{end}"', html) if end else F.lit(0)
    return F.when(a > 0, F.when(b > 0, F.substr(html, a, F.greatest(b - a, F.lit(0)))).otherwise(F.substr(html, a)))


def parse_pairs(text: Column, separator: str = " ") -> Column:
    """key=value pairs as a map; a later key wins."""
    pairs = F.filter(F.split(text, separator), lambda p: p.contains("="))
    keys = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
    last = F.filter(F.sequence(F.lit(1), F.size(pairs)), lambda i: (F.size(pairs) > 0) & ~F.array_contains(F.slice(keys, i + 1, F.size(keys)), F.element_at(keys, i)))
    entry = lambda i: F.struct(F.element_at(keys, i), F.substr(F.element_at(pairs, i), F.length(F.element_at(keys, i)) + 2))
    return F.when(F.size(pairs) > 0, F.map_from_entries(F.transform(last, entry))).otherwise(F.create_map().cast("map<string,string>"))


def parse_typed_pairs(text: Column, strings: tuple[str, ...] = (), separator: str = " ") -> Column:
    """key=value pairs as a map of variants: a value that is JSON is of its type, another one a string; a later key wins.

    The keys in `strings` are always strings, as a short hash of digits and an e would be taken for a number.
    Null for null; pieces without an equals sign are left out.
    """
    text_of = lambda v: v.cast("variant")
    typed = lambda k, v: F.when(k.isin(*strings), text_of(v)).otherwise(F.coalesce(F.try_parse_json(v), text_of(v))) if strings else F.coalesce(F.try_parse_json(v), text_of(v))
    return F.when(text.isNotNull(), F.transform_values(parse_pairs(text, separator), typed))
