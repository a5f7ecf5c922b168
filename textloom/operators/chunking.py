"""Passages: paragraphs bundled into chunks of 300 to 500 characters.

Packing is a running computation within a document, so each document is one
call of Python, a slice of a batch at a time; documents are independent of each other. A chunk
is held as a stretch of the document's characters with its paragraph span, and
only cut out at the end, so nothing can be lost.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.slices import by_rows
from textloom.operators.ranking import dense_ordinal

# The least, the most, and the size below which a chunk joins its neighbour.
MIN_CHARS, MAX_CHARS, FLOOR = 300, 500, 120
CHUNK = "array<struct<k:int,para_start:int,para_end:int,text:string>>"
CHUNKS = pa.list_(pa.struct([("k", pa.int32()), ("para_start", pa.int32()), ("para_end", pa.int32()), ("text", pa.string())]))

Span = tuple[int, int, int, int]  # start, end, first paragraph, last paragraph


def long_cuts(ends: list[int], start: int, end: int, most: int) -> list[int]:
    """Where a long paragraph is cut: after the last sentence that fits, or at `most`.

    What follows the last sentence end is no sentence and only cut at `most`.
    """
    cuts, at = [start], start
    for e in [x for x in ends if start < x <= end]:
        if e - cuts[-1] > most and at > cuts[-1]:
            cuts.append(at)
        cuts += range(cuts[-1] + most, e, most)
        at = e
    cuts += range(cuts[-1] + most, end, most)
    return [*cuts, end]


def bundle(paras: list[str], ends: list[int], least: int = MIN_CHARS, most: int = MAX_CHARS) -> list[Span]:
    """Chunks of whole paragraphs; a paragraph beyond `most` is cut at sentence ends."""
    out: list[Span] = []
    at = first = start = 0
    for i, p in enumerate(paras):
        stop = at + len(p)
        if stop - start > most:
            if at > start:
                out.append((start, at, first, i - 1))
            start, first = at, i
            if len(p) > most:
                cuts = long_cuts(ends, at, stop, most)
                out += [(a, b, i, i) for a, b in zip(cuts[:-2], cuts[1:-1])]
                start = cuts[-2]
                if stop - start >= least:
                    out.append((start, stop, i, i))
                    start, first = stop, i + 1
        elif stop - start >= least:
            out.append((start, stop, first, i))
            start, first = stop, i + 1
        at = stop
    if at > start:
        out.append((start, at, first, len(paras) - 1))
    return out


def even_cuts(ends: set[int], start: int, end: int, most: int) -> list[int]:
    """Near-equal parts of at most `most`, cut at a sentence end once a part is long enough."""
    n = -(-(end - start) // most)
    if n <= 1:
        return [start, end]
    aim = -(-(end - start) // n)
    cuts, at = [start], start
    while end - at >= aim:
        here = next((x for x in range(at + aim, min(at + most, end) + 1) if x in ends), None)
        if here is None:
            if at + most > end:
                break
            here = at + most
        cuts.append(here)
        at = here
    if at < end:
        if len(cuts) > 1 and end - cuts[-2] <= most:
            cuts[-1] = end
        else:
            cuts.append(end)
    return cuts


def rebalance(spans: list[Span], ends: set[int], most: int = MAX_CHARS, floor: int = FLOOR) -> list[Span]:
    """Chunks below the floor join the one before (the first the one after), then those beyond `most` are cut evenly."""
    done: list[Span] = []
    for s in spans:  # left to right: whatever stands before is already large enough, or the only one
        if done and (s[1] - s[0] < floor or done[-1][1] - done[-1][0] < floor):
            done[-1] = (done[-1][0], s[1], done[-1][2], s[3])
        else:
            done.append(s)
    return [(a, b, s[2], s[3]) for s in done for cuts in [even_cuts(ends, s[0], s[1], most) if s[1] - s[0] > most else [s[0], s[1]]] for a, b in zip(cuts, cuts[1:])]


def chunk(paras: list[str], least: int = MIN_CHARS, most: int = MAX_CHARS, floor: int = FLOOR, marks: str = "。！？", even: bool = True) -> list[tuple[int, int, int, str]]:
    """(k, para_start, para_end, text) of a document's chunks, in order."""
    text = "".join(paras)
    ends = [m.end() for m in re.finditer(f"[{re.escape(marks)}]", text)]
    spans = bundle(paras, ends, least, most)
    if even:
        spans = rebalance(spans, set(ends), most, floor)
    return [(k, p, q, text[a:b]) for k, (a, b, p, q) in enumerate(spans)]


def chunks(paras: Column, least: int = MIN_CHARS, most: int = MAX_CHARS, floor: int = FLOOR, marks: str = "。！？", even: bool = True) -> Column:
    """An array of paragraphs as an array of chunks; null for null."""
    return by_rows(lambda ps: None if ps is None else chunk([p or "" for p in ps], least, most, floor, marks, even), CHUNK, CHUNKS, paras)


def corpus_chunks(docs: DataFrame, id_col: str, paras: Column, **how) -> DataFrame:
    """(i, <id>, k, para_start, para_end, text): i numbers all chunks in document order.

    The ordinal comes from a range sort, so no task holds all chunks.
    """
    made = docs.select(F.col(id_col), chunks(paras, **how).alias("c"))
    rows = made.select(id_col, F.explode("c").alias("c")).select(id_col, "c.*")
    return dense_ordinal(rows, [F.col(id_col), F.col("k")], "i").select("i", *rows.columns)


