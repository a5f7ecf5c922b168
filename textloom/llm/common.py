"""What the training-data operators share: tables, shared scratch tables, words and ranks.

A word is a maximal run of bytes other than the six ASCII white-space bytes,
which is what `bytes.split()` yields; lower-casing bytes touches A-Z alone.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Reserved prefix of helper columns, so that a caller's own columns never clash.
TMP = "__tl_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="textloom-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of its own only where none is set and the session is local (tests)."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (at or _own_dir()).rstrip("/")


def store(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write the rows to the shared folder once and read them back.

    Losing executors later costs nothing that was computed before this point.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


#: Number of a row, fixed by writing it: ids may be null or repeat, so no decision on a row is told by its id.
ROW = f"{TMP}row"


def numbered(df: DataFrame, name: str) -> DataFrame:
    """The rows stored once with a number each (`ROW`) that no other has, whatever their ids."""
    return store(df.withColumn(ROW, F.monotonically_increasing_id()), name)


def place_in_file(df: DataFrame) -> Column:
    """What tells the rows of a table of Parquet files apart each time they are read: their file and place in it.

    The table may have a column named `_metadata` of its own.
    """
    place = df.metadataColumn("_metadata")
    return F.struct(F.xxhash64(place["file_path"]).alias("file"), place["row_index"].alias("at"))


def told_apart(df: DataFrame, row: Column | None, name: str) -> DataFrame:
    """The rows with what tells them apart as `ROW`: `row`, or if there is none, a number with which they are stored."""
    return numbered(df, name) if row is None else df.withColumn(ROW, row)


def words(text: str | None) -> list[bytes]:
    """The words of a text, none for null."""
    return text.encode().split() if text else []


def low_words(text: str | None) -> list[bytes]:
    """The words with A-Z in lower case."""
    return text.encode().lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def global_rank(df: DataFrame, order: list, name: str, within: list[str] | None = None) -> DataFrame:
    """Add `name`, the row's 0-based rank by `order`, without sorting in a single task.

    Rows are range-partitioned, ranked in each partition, and moved up by the
    counts of the partitions before (one small row for each). With `within`,
    whose columns must lead `order`, ranks start anew for each of its values.
    """
    spark = df.sparkSession
    part, local = f"{TMP}part", f"{TMP}local"
    ranged = df.repartitionByRange(partitions(spark), *order).withColumn(part, F.spark_partition_id())
    ranged = store(ranged, "ranged")
    counts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias(f"{TMP}n"))
    before = counts.withColumn(
        f"{TMP}before", F.sum(f"{TMP}n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    ).select(part, F.coalesce(f"{TMP}before", F.lit(0)).alias(f"{TMP}before"))
    ranked = ranged.withColumn(local, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    ranked = ranked.join(F.broadcast(before), part).withColumn(name, F.col(local) + F.col(f"{TMP}before") - 1)
    ranked = ranked.drop(part, local, f"{TMP}before")
    if not within:
        return ranked
    ranked = store(ranked, "ranked")
    first = ranked.groupBy(*within).agg(F.min(name).alias(f"{TMP}first"))
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in within]
    return (
        ranked.alias("a")
        .join(first.alias("b"), on)
        .select(*[F.col(f"a.{c}") for c in ranked.columns if c != name], (F.col(f"a.{name}") - F.col(f"b.{TMP}first")).alias(name))
    )
