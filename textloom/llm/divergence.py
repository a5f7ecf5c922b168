"""Source divergence audit: how far apart the sources of a language are, and by which terms.

A byte-level tokenizer reads whole batches at once: a lookup table over the
concatenated UTF-8 buffer lowers A-Z and marks what parts terms, so boundaries
are where marks change. Slices get their XXH64, equal hashes are one group, and
the bytes of each slice are compared with those of its group. What leaves a
task is a count for each language, source and term. Counts of the kept terms
then meet in blocks of terms, each a sparse matrix of sources by terms, whose
divergences are summed by `reduceat`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import store

#: Documents of its language that a kept term is in, ranks of part `term`, and what a share of 1 is.
LEAST_DOCS, TOP_TERMS, ONE = 3, 200, 1_000_000_000
#: Bytes of text that are read at a time (a longer text is one piece), and counts of one block of terms.
PIECE, BLOCK = 8 << 20, 1 << 20

#: For each byte the byte that stands for it in a term, 0 where a term ends.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
LOWER[0x00:0x41] = LOWER[0x5B:0x61] = LOWER[0x7B:0x80] = 0

# The primes of XXH64.
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def slices(low: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the terms in a buffer of looked-up bytes; none goes over an edge between texts."""
    inside = low != 0
    before, after = np.zeros(len(low), dtype=bool), np.zeros(len(low), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[edges[edges < len(low)]] = False
    after[edges[edges > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def _turn(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _short(rows: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of the rows of a matrix of under 32 bytes a row."""
    n = rows.shape[1]
    h = np.full(len(rows), P5 + np.uint64(n), dtype=np.uint64)
    at = 0
    while at + 8 <= n:
        k = np.ascontiguousarray(rows[:, at : at + 8]).view("<u8").ravel()
        h = _turn(h ^ (_turn(k * P2, 31) * P1), 27) * P1 + P4
        at += 8
    if at + 4 <= n:
        k = np.ascontiguousarray(rows[:, at : at + 4]).view("<u4").ravel().astype(np.uint64)
        h = _turn(h ^ (k * P1), 23) * P2 + P3
        at += 4
    for i in range(at, n):
        h = _turn(h ^ (rows[:, i].astype(np.uint64) * P5), 11) * P1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def _by_size(size: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(size, places of that size), some 4 MB of slices at a time."""
    order = np.argsort(size, kind="stable")
    kinds, first = np.unique(size[order], return_index=True)
    for n, a, b in zip(kinds.tolist(), first.tolist(), [*first.tolist()[1:], len(size)]):
        step = max(1, (4 << 20) // n)
        for low in range(a, b, step):
            yield n, order[low : min(low + step, b)]


def hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each slice."""
    size = end - start
    out = np.empty(len(start), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n, at in _by_size(size):
            if n < 32:
                out[at] = _short(low[start[at][:, None] + np.arange(n)])
            else:
                out[at] = [xxhash.xxh64_intdigest(low[a : a + n].tobytes()) for a in start[at]]
    return out


def grouped(low: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code of each slice, a slice of each code): slices of one code have the same bytes.

    Equal hashes are one group at first; slices whose bytes are not those of their
    group's first are parted from it by their bytes.
    """
    code, _ = pd.factorize(h)
    first = np.full(int(code.max()) + 1 if len(code) else 0, -1, dtype=np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    size = end - start
    odd = size != size[first[code]]
    for n, at in _by_size(size):
        at = at[~odd[at]]
        by = np.arange(n)
        odd[at] = (low[start[at][:, None] + by] != low[start[first[code[at]]][:, None] + by]).any(axis=1)
    if odd.any():
        own: dict[bytes, int] = {}
        more = []
        for i in np.flatnonzero(odd):
            word = low[start[i] : end[i]].tobytes()
            if word not in own:
                own[word] = len(first) + len(more)
                more.append(i)
            code[i] = own[word]
        first = np.concatenate([first, np.array(more, dtype=np.int64)])
    return code, first


def _strings(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The slices as an array of strings."""
    size = end - start
    to = np.zeros(len(size) + 1, dtype=np.int64)
    np.cumsum(size, out=to[1:])
    at = np.repeat(start - to[:-1], size) + np.arange(to[-1])
    got = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(to.tobytes()), pa.py_buffer(low[at].tobytes())])
    return got.cast(pa.large_string()).cast(pa.string())


SCHEMA = "lang string, source string, term string, n long, docs long"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "source", "term", "n", "docs"]
    for batch in batches:
        lang, source, text = (pc.fill_null(batch.column(i), "").cast(pa.large_string()) for i in range(3))
        pair = [x.dictionary_encode() for x in (lang, source)]
        codes = [x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in pair]
        group, pairs = pd.factorize(codes[0] * max(1, len(pair[1].dictionary)) + codes[1])
        langs, sources = (pair[0].dictionary.take(pa.array(pairs // max(1, len(pair[1].dictionary)))).cast(pa.string()), pair[1].dictionary.take(pa.array(pairs % max(1, len(pair[1].dictionary)))).cast(pa.string()))
        docs = np.bincount(group, minlength=len(pairs))
        yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(pairs), pa.string()), pa.array(np.zeros(len(pairs), dtype=np.int64)), pa.array(docs.astype(np.int64))], names=names)

        edges = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
        whole = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
        a = 0
        while a < len(text):
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + PIECE, "right")) - 1)
            low, own = LOWER[whole[edges[a] : edges[b]]], edges[a : b + 1] - edges[a]
            start, end = slices(low, own)
            if len(start):
                code, first = grouped(low, start, end, hashes(low, start, end))
                doc = np.searchsorted(own, start, "right") - 1
                each, in_doc = pd.factorize(doc * len(first) + code)  # a document's term
                times = np.bincount(each)
                where, at = pd.factorize(group[a + in_doc // len(first)] * len(first) + in_doc % len(first))
                n, df = np.bincount(where, weights=times).astype(np.int64), np.bincount(where).astype(np.int64)
                term = first[at % len(first)]
                of = pa.array(at // len(first))
                yield pa.RecordBatch.from_arrays([langs.take(of), sources.take(of), _strings(low, start[term], end[term]), pa.array(n), pa.array(df)], names=names)
            a = b


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term; term null has each group's documents."""
    rows = docs.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "text")]).mapInArrow(_counts, SCHEMA)
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(ONE * (n + 1) / (total + kept)), by long division in thousands, exact while total + kept is under 9e15."""
    below = np.asarray(total, dtype=np.int64) + kept
    out, rest = np.divmod(n.astype(np.int64) + 1, below)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, below)
        out = out * 1000 + more
    return out + 1


def far(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of each row of a sparse matrix; empty rows are 0."""
    out = np.zeros(len(starts), dtype=np.int64)
    full = ends > starts
    if full.any():
        out[full] = np.add.reduceat(values, starts[full])
    return out


OUT = "lang string, source string, part string, item string, value long"


def _block(rows: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """A block's share of all pairs of sources, and the first terms of each source in it."""
    groups = groups.sort_by("source")
    lang, sources = groups["lang"][0], groups["source"].combine_chunks()
    total, lang_total, v = groups["total"].to_numpy(), groups["lang_total"][0].as_py(), groups["v"][0].as_py()
    s = len(sources)
    terms = pc.unique(rows["term"]).sort() if len(rows) else pa.array([], pa.string())
    col = pc.index_in(rows["term"], terms).to_numpy().astype(np.int64)
    row = pc.index_in(rows["source"], sources).to_numpy().astype(np.int64)
    order = np.lexsort((col, row))
    row, col, n = row[order], col[order], rows["n"].to_numpy()[order].astype(np.int64)
    edges = np.searchsorted(row, np.arange(s + 1))
    starts, ends = edges[:-1], edges[1:]
    wide = len(terms)
    sums, found = np.zeros((s, s), dtype=np.int64), []
    if wide:
        value, zero = share(n, total[row], v), share(np.zeros(s, dtype=np.int64), total, v)
        own_zero = zero[row]  # what the row's source gives a term that it lacks
        whole = share(np.bincount(col, weights=n, minlength=wide).astype(np.int64) if n.sum() < 1 << 52 else _by(col, n, wide), lang_total, v)
        for i in range(s):
            mine = slice(starts[i], ends[i])
            p = np.full(wide, zero[i], dtype=np.int64)
            p[col[mine]] = value[mine]
            # Over terms of the other: with its own value, less what it would be for a term that it lacks ...
            at = p[col]
            sums[i] = _sums(far(at, value) - far(at, own_zero), starts, ends)
            # ... and over all terms as if it lacked them: those of this source, and the rest.
            sums[i] += far(value[mine][None, :], zero[:, None]).sum(axis=1) + (wide - (ends[i] - starts[i])) * far(zero[i], zero)
            above = value[mine] > whole[col[mine]]
            f = far(value[mine], whole[col[mine]])[above]
            best = np.lexsort((col[mine][above], -f))[:top]
            found.append((i, col[mine][above][best], f[best]))
    a, b = np.nonzero(~np.eye(s, dtype=bool))
    who = np.concatenate([a, *[np.full(len(c), i) for i, c, _ in found]]).astype(np.int64)
    parts = ["pair"] * len(a) + ["term"] * (len(who) - len(a))
    items = pa.concat_arrays([sources.take(pa.array(b)), *[terms.take(pa.array(c)) for _, c, _ in found]])
    value = np.concatenate([sums[a, b], *[f for _, _, f in found]]).astype(np.int64)
    return pa.table({"lang": pa.array([lang.as_py()] * len(who), pa.string()), "source": sources.take(pa.array(who)), "part": pa.array(parts, pa.string()), "item": items, "value": value})


def _by(col: np.ndarray, n: np.ndarray, wide: int) -> np.ndarray:
    out = np.zeros(wide, dtype=np.int64)
    np.add.at(out, col, n)
    return out


def audit(docs: DataFrame, top: int = TOP_TERMS, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of `docs` (lang, source, text).

    Part `pair` has the divergence from each other source of the language, summed
    over the terms in at least `least` documents of that language; part `term` the `top`
    terms by which the group exceeds its language. Nulls are '', empty texts give
    their group without terms, a language without kept terms has pairs of 0, an
    only source no pairs. Repeated rows count each; other columns are not read; an
    empty table gives no rows. A text is a piece by itself, however long.
    """
    spark = docs.sparkSession
    by = Window.partitionBy("lang", "term")
    seen = counts(docs).select("*", F.sum("docs").over(by).alias("df"), F.min("source").over(by).alias("first"))
    kept = store(seen.where(F.col("term").isNull() | (F.col("df") >= least)).select("lang", "source", "term", "n", (F.col("first") == F.col("source")).alias("first")), "kept")
    blocks = max(1, -(-kept.count() // BLOCK))  # the number of blocks alone is known to the driver
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if(F.col("first") & F.col("term").isNotNull()).alias("v"))
    groups = totals.join(langs, "lang").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    terms = kept.where("term is not null").select("lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _block(left, right, top)

    groups = groups.select(*[F.col(c).alias(c) for c in groups.columns])  # columns of its own, as both sides come from one table
    sums = terms.groupBy("lang", "block").cogroup(groups.groupBy("lang", "block")).applyInArrow(run, OUT)
    sums = store(sums, "divergences")
    pairs = sums.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.select("lang", "source", "part", "item", "value", F.row_number().over(order).cast("int").alias("rank"))
    return ranked(pairs).unionByName(ranked(sums.where("part = 'term'")).where(F.col("rank") <= top))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
c AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0)::HUGEINT AS n FROM g JOIN kept k ON g.lang = k.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
s AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (SELECT c.lang, c.source, c.term, c.n, 1 + (1000000000 * (c.n + 1)) // (s.total + v.v) AS p FROM c JOIN s ON c.lang = s.lang AND c.source = s.source JOIN v ON c.lang = v.lang),
q AS (SELECT k.lang, k.term, 1 + (1000000000 * (k.n::HUGEINT + 1)) // (v.total + v.v) AS q FROM kept k JOIN v ON k.lang = v.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value
         FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, (((p.p - q.q) * (p.p - q.q)) // q.q)::BIGINT AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q),
parts AS (SELECT * FROM pair UNION ALL SELECT * FROM term)
SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts
QUALIFY part = 'pair' OR rank <= 200
"""
