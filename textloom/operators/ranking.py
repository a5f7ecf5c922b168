"""Ordinals and running totals of whole tables without a single-task sort."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@lru_cache(maxsize=1)
def _own_dir() -> str:
    """A folder for sessions of one machine that name none."""
    return "file://" + tempfile.mkdtemp(prefix="textloom-")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that all executors share."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(at or _own_dir()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the folder that all executors share, and read back."""
    spark: SparkSession = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parted(df: DataFrame, by: str, name: str) -> DataFrame:
    """As `scratch`, in a folder for each value of `by`, so that a filter on it reads only those."""
    path = shared_path(df.sparkSession, name)
    df.write.partitionBy(by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(df.columns)


def running_total(df: DataFrame, order: list, value: Column, name: str) -> DataFrame:
    """Add `name`, the sum of `value` over the rows before each in the order given, which must tell rows apart.

    Rows are range-partitioned and summed in each partition; partitions before
    add their totals, one small row for each. The ranges are fixed by writing.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = scratch(df.withColumn("_x", value.cast("long")).repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "running")
    totals = ranged.groupBy("_part").agg(F.sum("_x").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = totals.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    local = F.coalesce(F.sum("_x").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("_i", local).join(F.broadcast(start), "_part").withColumn(name, F.col("_i") + F.col("_start")).drop("_part", "_x", "_i", "_start")


def dense_ordinal(df: DataFrame, order: list, name: str) -> DataFrame:
    """Add `name`, each row's place from 0 in the order given."""
    return running_total(df, order, F.lit(1), name)
