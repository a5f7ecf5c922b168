"""Sharding by histogram sort.

Rows are ordered by (hash of the text, doc_id, number among rows alike), so equal
texts stand together, and shards are stretches of that order of near-equal bytes.
The number parts rows that repeat both id and text, of which there may be any
number. The splitters are found before anything moves: each round counts the exact
bytes and rows below a few candidate keys per splitter, and the candidates close
in on the target until each splitter meets the tolerance. Then the rows are
exchanged once. Between the rounds only counts reach the driver, a fixed number
per splitter.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import TMP, partitions, store

SHARDS = 40
#: Bytes that a row costs beside its text.
OVERHEAD = 16
#: A splitter may miss its target by this share of a shard's bytes.
TOLERANCE = 0.001
#: And by this share where the exact place would part a group of equal texts.
GROUP_TOLERANCE = 0.01
PROBES = 15
#: Rows of a run, the piece of a shard that one task numbers; it may miss by half.
RUN = 200_000
#: Rows alike that one task lists.
ALIKE = 10_000

Key = tuple[int, int, int]
#: Below and above every key, the hash as an unsigned, the id as an offset.
LOW, HIGH = (0, 0, 0), (1 << 64, 0, 0)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The narrow table that is sorted: a row's id, size, checksum, text hash, and number among the rows alike.

    Rows alike are counted before they move, and listed again in stretches of ALIKE.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    same = ["doc_id", "size", "text_crc32", "key"]
    alike = store(rows.groupBy(*same).agg(F.count(F.lit(1)).alias("n")), "alike")
    stretch = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / ALIKE)))
    many = alike.where("n > 1").withColumn("at", stretch).repartition(partitions(docs.sparkSession), *same, "at")
    nth = F.explode(F.sequence(F.col("at") * ALIKE, F.least((F.col("at") + 1) * ALIKE, F.col("n")) - 1))
    return alike.where("n = 1").select(*same, F.lit(0).cast("long").alias("nth")).unionByName(many.select(*same, nth.alias("nth")))


@dataclass(frozen=True)
class Span:
    """What the keys of a table lie between: ids count from `base`, which stands for null, to `last`; numbers are below `most`."""

    base: int
    last: int
    most: int

    @staticmethod
    def of(keys: DataFrame) -> Span:
        least, greatest, most = keys.agg(F.min("doc_id"), F.max("doc_id"), F.max("nth")).first()
        base = max(-(1 << 63), (least or 0) - 1)
        return Span(base, (greatest or 0) - base, (most or 0) + 1)

    def sortable(self, hashes: pa.Array, ids: pa.Array, nth: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unsigned forms that sort as (hash, id, number), null ids first."""
        plain = lambda c: c.to_numpy(zero_copy_only=False).view(np.uint64)
        return plain(hashes), plain(ids.fill_null(self.base)) - np.uint64(self.base % (1 << 64)), plain(nth)

    def between(self, low: Key, high: Key, n: int) -> list[Key]:
        """Up to n keys strictly between two keys, evenly spread: by hash, by id within one hash, by number within one id."""

        def spread(a: int, b: int) -> list[int]:
            return sorted({a + (b - a) * i // (n + 1) for i in range(1, n + 1)} - {a}) if b - a > 1 else []

        if high[0] - low[0] > 1:
            return [(x, 0, 0) for x in spread(low[0], high[0])]
        same = high[0] == low[0]
        last = high[1] if same else self.last + 1
        if ids := spread(low[1], last + (same and high[2] > 0)):
            return [(low[0], x, 0) for x in ids]
        most = high[2] if same and high[1] == low[1] else self.most
        return [(low[0], low[1], x) for x in spread(low[2], most)]


def _below(h: np.ndarray, d: np.ndarray, k: np.ndarray, probes: list[Key]) -> np.ndarray:
    """For each row the number of probes at or below it; `probes` are sorted."""
    heads = np.array([p[0] for p in probes], dtype=np.uint64)
    at = np.searchsorted(heads, h, side="right")
    # Rows whose hash equals a probe's: their id and number decide among the probes of that hash.
    for head in {p[0] for p in probes if p[1] or p[2]}:
        rows = np.flatnonzero(h == np.uint64(head))
        if len(rows):
            at[rows] = np.searchsorted(heads, np.uint64(head), side="left")
            for p in probes:
                if p[0] == head:
                    at[rows] += (d[rows] > np.uint64(p[1])) | ((d[rows] == np.uint64(p[1])) & (k[rows] >= np.uint64(p[2])))
    return at


def _histogram(keys: DataFrame, span: Span, probes: list[Key]) -> dict[int, tuple[int, int]]:
    """Exact (rows, bytes) between neighbouring probes, as one partial aggregate in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, b = np.zeros(len(probes) + 1, dtype=np.int64), np.zeros(len(probes) + 1, dtype=np.int64)
        for batch in batches:
            at = _below(*span.sortable(*batch.columns[:3]), probes)
            n += np.bincount(at, minlength=len(n))
            np.add.at(b, at, batch.column(3).to_numpy(zero_copy_only=False))
        full = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(n[full]), pa.array(b[full])], names=["bin", "n", "b"])

    rows = keys.select("key", "doc_id", "nth", "size").mapInArrow(run, "bin long, n long, b long")
    return {r[0]: (r[1], r[2]) for r in rows.groupBy("bin").agg(F.sum("n"), F.sum("b")).collect()}


def splitters(keys: DataFrame, span: Span, parts: int, tolerance: float = TOLERANCE, group_tolerance: float = GROUP_TOLERANCE, by_rows: bool = False) -> list[Key]:
    """The first keys of all parts but the first, of near-equal bytes (or rows).

    A round narrows the stretch that holds a splitter's target; it ends when the
    nearer end of every stretch is within the tolerance, or no row parts its ends.
    """
    n, total = keys.agg(F.count(F.lit(1)), F.sum("size")).first()
    by = 1 if by_rows else 2
    whole = (n if by_rows else total) or 0
    targets = [whole * (i + 1) // parts for i in range(parts - 1)]
    brackets = [[(LOW, 0, 0), (HIGH, n, total or 0)] for _ in targets]

    def done(i: int) -> bool:
        a, b = brackets[i]
        group = a[0][0] + 1 >= b[0][0] and not any(a[0][1:]) and not any(b[0][1:])  # one group, as yet unparted
        miss = min(targets[i] - a[by], b[by] - targets[i]) / max(1, whole) * parts
        return miss <= (max(tolerance, group_tolerance) if group else tolerance) or b[1] - a[1] <= 1 or not span.between(a[0], b[0], 1)

    while todo := [i for i in range(len(targets)) if not done(i)]:
        probes = sorted({k for ends in {(brackets[i][0][0], brackets[i][1][0]) for i in todo} for k in span.between(*ends, PROBES)})
        bins = _histogram(keys, span, probes)
        below, seen = [], (0, 0)
        for at, key in enumerate(probes):
            seen = tuple(map(sum, zip(seen, bins.get(at, (0, 0)))))
            below.append((key, *seen))
        for i in todo:
            for point in below[bisect_right(probes, brackets[i][0][0]) : bisect_left(probes, brackets[i][1][0])]:
                if point[by] > targets[i]:
                    brackets[i][1] = point
                    break
                brackets[i][0] = point
    return [min(b, key=lambda p: (abs(p[by] - t), p[0]))[0] for b, t in zip(brackets, targets)]


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's shard and place: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `bytes`: the shards' sizes are near equal. Slots count a shard's
    rows from 0 in the order of the sort. A null text has no bytes; rows with a
    null id come first among equal texts; repeated rows get a slot each and are
    parted like any others, so they may fill many shards. Other columns are not
    read; texts of any length count whole. An empty table gives no rows, and more
    shards than rows leave some shards empty.
    """
    keys = store(sized(docs, id_col, text_col), "keys")
    span = Span.of(keys)
    major = splitters(keys, span, shards)
    # Runs part the shards further, also within a group of equal texts, so that a task numbers a bounded number of rows.
    fine = splitters(keys, span, -(-keys.count() // RUN), 0.5, 0.5, by_rows=True)
    cuts = sorted({*major, *fine})
    owner = [bisect_right(major, c) for c in [LOW, *cuts]]
    bins = _histogram(keys, span, cuts)
    offsets, seen = [], [0] * shards
    for at, s in enumerate(owner):
        offsets.append(seen[s])
        seen[s] += bins.get(at, (0, 0))[0]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _below(*span.sortable(batch.column(3), batch.column(0), batch.column(4)), cuts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=["doc_id", "size", "text_crc32", "key", "nth", "run"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_slot: dict[int, int] = {}
        for batch in batches:
            run = batch.column(5).to_numpy()
            slot = np.empty(len(run), dtype=np.int64)
            edges = np.flatnonzero(np.r_[True, run[1:] != run[:-1], True]) if len(run) else []
            for a, b in zip(edges, edges[1:]):
                r = int(run[a])
                start = next_slot.get(r, offsets[r])
                slot[a:b] = np.arange(start, start + b - a)
                next_slot[r] = start + (b - a)
            where = np.array(owner, dtype=np.int32)[run]
            cols = [batch.column(i) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(where), pa.array(slot)], names=["doc_id", "size", "text_crc32", "shard", "slot"])

    placed = keys.select("doc_id", "size", "text_crc32", "key", "nth").mapInArrow(place, "doc_id long, size long, text_crc32 long, key long, nth long, run int")
    unsigned = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))  # sorts as the unsigned hash does
    moved = placed.repartition(len(cuts) + 1, "run").withColumn(f"{TMP}key", unsigned).sortWithinPartitions("run", f"{TMP}key", F.col("doc_id").asc_nulls_first(), "nth")
    out = moved.drop(f"{TMP}key").mapInArrow(number, "doc_id long, size long, text_crc32 long, shard int, slot long")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
