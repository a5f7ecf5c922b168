"""Vectors: projection, quantisation, and what both cost in neighbours.

Gram and covariance matrices are sums over rows, built per partition and added
up, so only a dims x dims matrix reaches the driver; eigenvectors are found there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rows(col: pa.Array) -> np.ndarray:
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else np.zeros((0, 0))


def moments(df: DataFrame, vec_col: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, column sums, Gram matrix) of the vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, None, None
        for batch in batches:
            x = _rows(batch.column(0))
            if len(x):
                n, s, g = n + len(x), x.sum(axis=0) + (0 if s is None else s), x.T @ x + (0 if g is None else g)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()], pa.list_(pa.float64())), pa.array([g.ravel().tolist()], pa.list_(pa.float64()))], names=["n", "s", "g"])

    n, s, g = 0, 0.0, 0.0
    for row in df.select(vec_col).where(F.col(vec_col).isNotNull()).mapInArrow(run, "n long, s array<double>, g array<double>").toLocalIterator():
        n, s, g = n + row[0], s + np.array(row[1]), g + np.array(row[2])
    dims = len(s) if n else 0
    return n, np.asarray(s), np.asarray(g).reshape(dims, dims)


def components(df: DataFrame, vec_col: str, dims: int, center: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, basis, explained ratio): truncated SVD without centring, or principal components with it.

    Signs are fixed by making each axis' largest entry positive.
    """
    n, s, g = moments(df, vec_col)
    mean = s / n if center else np.zeros_like(s)
    c = g - n * np.outer(mean, mean) if center else g
    values, vectors = np.linalg.eigh(c)
    order = np.argsort(-values)
    values, basis = np.maximum(values[order], 0), vectors[:, order]
    basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), np.arange(basis.shape[1])] < 0, -1, 1)
    return mean, basis[:, :dims], values[:dims] / max(values.sum(), 1e-300)


def project(vec: Column, mean: np.ndarray, basis: np.ndarray, unit: bool = True) -> Column:
    """The vector in the basis, of unit length; a zero stays zero."""

    def run(batch: pd.Series) -> pd.Series:
        x = np.stack([np.asarray(v, dtype=np.float64) for v in batch]) if len(batch) else np.zeros((0, len(mean)))
        z = (x - mean) @ basis
        if unit:
            norm = np.linalg.norm(z, axis=1, keepdims=True)
            z = z / np.where(norm == 0, 1.0, norm)
        return pd.Series(list(z), index=batch.index)

    return F.pandas_udf(run, "array<double>")(vec)


def norm(vec: Column) -> Column:
    return F.sqrt(F.aggregate(vec, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(vec: Column) -> Column:
    """Of unit length; a zero stays zero. The norm is worked out once for a vector."""
    scaled = lambda s: F.transform(s["v"], lambda x: x.cast("double") / F.when(s["n"] == 0, 1.0).otherwise(s["n"]))
    return F.element_at(F.transform(F.array(F.struct(vec.alias("v"), norm(vec).alias("n"))), scaled), 1)


def row_scale(vec: Column) -> Column:
    """The largest absolute component, 1 for a zero vector."""
    most = F.array_max(F.transform(vec, lambda x: F.abs(x.cast("double"))))
    return F.when(most == 0, 1.0).otherwise(most)


def quantize(vec: Column, scale: Column) -> Column:
    """Symmetric 8-bit codes: round half to even, within 127."""
    return F.transform(vec, lambda x: F.greatest(F.least(F.bround(x.cast("double") / scale * 127.0), F.lit(127.0)), F.lit(-127.0)).cast("int"))


def dequantize(codes: Column, scale: Column) -> Column:
    return unit(F.transform(codes, lambda q: q * (scale / 127.0)))


def to_f16(vec: Column) -> Column:
    """Half-precision bytes, little-endian."""
    return F.udf(lambda v: None if v is None else np.asarray(v, dtype="<f2").tobytes(), "binary", useArrow=True)(vec)


def from_f16(raw: Column) -> Column:
    """The floats of half-precision bytes, subnormal and non-finite ones too."""
    return F.udf(lambda b: None if b is None else np.frombuffer(b, dtype="<f2").astype(np.float32).tolist(), "array<float>", useArrow=True)(raw)


def kendall(a: DataFrame, b: DataFrame) -> DataFrame:
    """(q, tau) over the items that both rankings (q, doc, rank) hold; 0 for fewer than two."""
    both = a.select("q", "doc", F.col("rank").alias("ra")).join(b.select("q", "doc", F.col("rank").alias("rb")), ["q", "doc"])
    x, y = both.alias("x"), both.alias("y")
    pairs = x.join(y, (F.col("x.q") == F.col("y.q")) & (F.col("x.ra") < F.col("y.ra"))).select(F.col("x.q").alias("q"), F.signum(F.col("y.rb") - F.col("x.rb")).alias("s"))
    tau = pairs.groupBy("q").agg((F.sum("s") / F.sum(F.abs("s"))).alias("tau"))
    return a.select("q").distinct().join(tau, "q", "left").select("q", F.coalesce("tau", F.lit(0.0)).alias("tau"))


def loss(base: DataFrame, other: DataFrame) -> DataFrame:
    """(recall10, top1, tau): means over queries of what a compressed ranking keeps of the base ranking."""
    a, b = base.where("rank <= 10").select("q", "doc"), other.where("rank <= 10").select("q", "doc")
    kept = base.select("q").distinct().join(a.join(b, ["q", "doc"]).groupBy("q").agg(F.count(F.lit(1)).alias("n")), "q", "left")
    first = base.where("rank = 1").select("q", "doc").join(other.where("rank = 1").select("q", F.col("doc").alias("d")), "q")
    recall = kept.agg(F.avg(F.coalesce("n", F.lit(0)) / 10).alias("recall10"))
    top1 = first.agg(F.avg((F.col("doc") == F.col("d")).cast("int")).alias("top1"))
    return recall.crossJoin(top1).crossJoin(kendall(base, other).agg(F.avg("tau").alias("tau")))
