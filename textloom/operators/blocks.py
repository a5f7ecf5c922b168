"""Rows with vectors packed into numbered blocks, and blocks that meet by number.

A block is written once and read where it is needed. Two tables of blocks meet
by an equi-join on the number of a block, for stated pairs of numbers only, so
neither side is broadcast and no task packs anything anew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.ranking import scratch

SCHEMA = "block long, part long, rows long, ids binary, sizes binary, v binary, works array<string>"
#: Rows of one packed part, of which a block of more has several, and tasks over which a block is dealt.
PART, DEALT = 8192, 4


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack neighbouring rows of one block; a block that goes over several batches has several parts."""
    part = 0
    for batch in batches:
        block = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)] if len(block) else [0]
        for low, high in zip(edges, edges[1:]):
            for a in range(low, high, PART):
                some = batch.slice(a, min(PART, high - a))
                ids, sizes = (some.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
                v = some.column(3).flatten().to_numpy(zero_copy_only=False).astype("<f8")
                part += 1
                yield pa.RecordBatch.from_arrays([pa.array([int(block[a])]), pa.array([part]), pa.array([len(ids)]), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([sizes.astype("<f8").tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary()), pa.array([some.column(4).to_pylist()], pa.list_(pa.string()))], names=["block", "part", "rows", "ids", "sizes", "v", "works"])


def pack(rows: DataFrame, block: Column, blocks: int, name: str, dealt_over: int = DEALT) -> DataFrame:
    """Blocks of rows (id long, size double, v array<double>, and work string where there is one), written to the shared folder.

    `block` numbers the block of each row from 0 to `blocks`. Rows of a block are dealt
    over `dealt_over` tasks, and packed by the task that gets them, in parts of bounded size.
    """
    n = max(1, min(blocks * dealt_over, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    work = F.col("work") if "work" in rows.columns else F.lit(None).cast("string")
    dealt = rows.select(block.cast("long").alias("block"), "id", "size", "v", work.alias("work"))
    dealt = dealt.repartition(n, "block", F.pmod(F.xxhash64("id"), F.lit(dealt_over))).sortWithinPartitions("block", "id")
    return scratch(dealt.mapInArrow(_packed, SCHEMA), name)


def by_hash(blocks: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(blocks))


def meet(left: DataFrame, right: DataFrame, blocks: int | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """Each part of the left with each part of the right (columns led by `r_`): of all right blocks, or of the stated `pairs` (block, r_block)."""
    other = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    to = left.withColumn("r_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))) if pairs is None else left.join(pairs, "block")
    return to.join(other, "r_block")


class Rows:
    """The ids, sizes and vectors of one part."""

    def __init__(self, batch: pa.RecordBatch, at: int, prefix: str = ""):
        get = lambda c, kind: np.frombuffer(batch.column(prefix + c)[at].as_buffer(), dtype=kind)
        self.ids, self.sizes = get("ids", "<i8"), get("sizes", "<f8")
        self.v = get("v", "<f8").reshape(len(self.ids), -1)
        self.works = [w or "" for w in batch.column(prefix + "works")[at].as_py()]
