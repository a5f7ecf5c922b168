"""Logistic regression on a bounded labelled sample, and its calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import TMP


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, label int) of at most `per_class` labelled ids of each class 0 and 1, those of the least id hashes.

    Rows whose id or label is null are no sample; of rows that repeat an id, the
    least text stands for it. The sample is broadcast: its size is bounded by the parameter.
    """
    named = labels.select(F.col("doc_id").cast("long").alias(f"{TMP}id"), F.col(label).cast("int").alias("label")).where(f"{TMP}id is not null")
    chosen = [named.where(F.col("label") == c).orderBy(F.xxhash64(f"{TMP}id"), f"{TMP}id").limit(per_class) for c in (0, 1)]
    sample = chosen[0].unionByName(chosen[1])
    met = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col(f"{TMP}id"))
    return met.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def newton(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    """Weights of a dense logistic model, the last for the constant; the ridge spares the constant."""
    x = np.c_[x, np.ones(len(x))]
    w, pull = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(rounds):
        p = sigmoid(x @ w)
        slope = x.T @ (weight * (p - y)) + pull * w
        step = np.linalg.solve((x.T * (weight * p * (1 - p) + 1e-9)) @ x + np.diag(pull), slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn scores into probabilities, with Platt's softened targets."""
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    soft = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = newton(z[:, None], soft, weight, 1e-3)
    return float(max(a, 1e-6)), float(b)


def sparse(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int, ridge: float = 0.2, rounds: int = 80) -> np.ndarray:
    """Weights of a logistic model on rows of (index, value), the last for the constant; accelerated descent."""
    at = np.concatenate([r[0] for r in rows]).astype(np.int64)
    v = np.concatenate([r[1] for r in rows])
    of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    n = len(rows)
    most = max(float((r[1] ** 2).sum()) for r in rows) + 1.0
    step = 1.0 / (0.25 * most + ridge / n)
    w, m, t = np.zeros(dim + 1), np.zeros(dim + 1), 1.0
    for _ in range(rounds):
        p = sigmoid(np.bincount(of, v * m[at], minlength=n) + m[dim])
        slope = np.r_[np.bincount(at, v * (p - y)[of], minlength=dim), (p - y).sum()] / n + ridge / n * m
        new, t_new = m - step * slope, (1 + (1 + 4 * t * t) ** 0.5) / 2
        m, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return w
