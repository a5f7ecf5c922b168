"""Marked-up text: a lossless token tree of text, ruby and annotation nodes.

A body is read as gaps and ruby groups; how much of the gap before a group is
its base is decided by one pattern anchored at the gap's end. Parsing runs in
Arrow-batched Python, since a base depends on what the groups before it left
over; everything on parsed trees is column expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character classes that an implicit base is made of.
KANJI = r"一-鿿々〆ヶヵ豈-﫿㐀-䶿"
HIRAGANA = r"ぁ-ゖゝゞ"
KATAKANA = r"ァ-ヴーヽヾ"
LATIN = r"0-9A-Za-z０-９Ａ-Ｚａ-ｚ"
NOTE = r"［＃[^］]*］"
_BASE = re.compile(rf"(?:[{KANJI}]*(?:※?{NOTE})+|[{KANJI}]+|[{HIRAGANA}]+|[{KATAKANA}]+|[{LATIN}]+)\Z")
_BAR = re.compile(r"｜([^｜\n]*)\Z")
_GROUP = re.compile(r"《([^》]*)》")
_NOTE = re.compile(f"({NOTE})")
_RULE = re.compile(r"-{10,}\r*\Z")
_COLOPHON = re.compile(r"底本[：:]")

NODE = "struct<kind:string,raw:string,base:string,ruby:string,explicit:boolean>"
DOC = f"struct<title:string,subtitle:array<string>,author:string,header:string,body:array<{NODE}>,footer:string>"

Node = tuple[str, str, str | None, str | None, bool | None]


def _pieces(gap: str) -> list[Node]:
    """A gap as text and annotation nodes: every second part of the split is a note."""
    return [("a" if i % 2 else "t", part, None, None, None) for i, part in enumerate(_NOTE.split(gap)) if part]


def nodes(body: str) -> list[Node]:
    """The nodes of a body: kind t, r or a, the raw text, and for ruby its base, reading, and whether the base was marked."""
    out: list[Node] = []
    parts = _GROUP.split(body)
    for gap, ruby in zip(parts[::2], parts[1::2]):
        marked = _BAR.search(gap)
        found = marked or _BASE.search(gap)
        base = (marked[1] if marked else found[0]) if found else ""
        out += _pieces(gap[: found.start()] if found else gap)
        out.append(("r", f"{'｜' if marked else ''}{base}《{ruby}》", base, ruby, bool(marked)))
    return out + _pieces(parts[-1])


def sections(source: str) -> tuple[str, str, str]:
    """Header, body and footer, which together are the source.

    The header ends with the second rule line, or without two of those with the
    first blank line after text; the footer begins with the colophon line.
    """
    lines = source.split("\n")
    ends, at = [], 0
    for x in lines:
        at += len(x) + 1
        ends.append(min(at, len(source)))
    starts = [0, *ends[:-1]]
    live = [i for i, a in enumerate(starts) if a < len(source)]
    rules = [i for i in live if _RULE.match(lines[i])]
    if len(rules) > 1:
        head = ends[rules[1]]
    else:
        text = next((i for i in live if lines[i].strip()), None)
        blank = next((i for i in live if text is not None and i > text and not lines[i].strip()), None)
        head = 0 if blank is None else ends[blank]
    foot = next((starts[i] for i in live if _COLOPHON.match(lines[i])), len(source))
    head = min(head, foot)
    return source[:head], source[head:foot], source[foot:]


def head_fields(header: str) -> tuple[str, list[str], str]:
    """Title, subtitles and author: first, middle and last line of the first block; one line is a title alone."""
    block = next((b for b in re.split(r"\n(?:[^\S\n]*\n)+", header.strip("\n")) if b.strip()), "")
    rows = [x.rstrip("\r") for x in block.split("\n") if x.strip()]
    return (rows[0] if rows else "", rows[1:-1], rows[-1] if len(rows) > 1 else "")


def _parsed(source: str | None):
    if source is None:
        return None
    header, body, footer = sections(source)
    return *head_fields(header), header, nodes(body), footer


def parse(source: Column) -> Column:
    """The parsed document; null for null."""
    return F.udf(_parsed, DOC, useArrow=True)(source)


def parse_body(source: Column) -> Column:
    """The nodes of a fragment without header and footer."""
    return F.udf(lambda x: None if x is None else nodes(x), f"array<{NODE}>", useArrow=True)(source)


def serialize(doc: Column) -> Column:
    """The source that a parsed document came from, to the character."""
    return F.concat(doc["header"], F.array_join(F.transform(doc["body"], lambda n: n["raw"]), ""), doc["footer"])


def base_text(node: Column) -> Column:
    """A ruby base without notes."""
    return F.regexp_replace(node["base"], NOTE, "")


def body_text(body: Column) -> Column:
    """The reading text: text and bases, without readings and annotations."""
    read = F.filter(body, lambda n: n["kind"] != "a")
    return F.array_join(F.transform(read, lambda n: F.when(n["kind"] == "r", base_text(n)).otherwise(n["raw"])), "")


def paragraphs(text: Column) -> Column:
    """Lines with text, stripped at both ends."""
    stripped = F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(stripped, lambda x: x != "")


def ruby_html(body: Column) -> Column:
    """Nodes as HTML: ruby elements, escaped text, annotations in a span."""
    from textloom.functions.text import escape_html as esc

    def one(n: Column) -> Column:
        ruby = F.concat(F.lit("<ruby>"), esc(base_text(n)), F.lit("<rt>"), esc(n["ruby"]), F.lit("</rt></ruby>"))
        return F.when(n["kind"] == "r", ruby).when(n["kind"] == "a", F.concat(F.lit('<span class="note">'), esc(n["raw"]), F.lit("</span>"))).otherwise(esc(n["raw"]))

    return F.array_join(F.transform(body, one), "")
