"""Quality classifier: hierarchical empirical Bayes over document, path and host.

A small classifier on style features gives each document its evidence. The
grouped sums of that evidence give each host, and each path on a host, a
Beta-binomial posterior: a host is drawn to the global mean, a path to its
host's, the more so the fewer documents it has. How strongly is fitted to the
spread between sites by moments. A document's log-odds then move from the
global prior to its site's posterior, from which its own evidence is left out,
so that it counts once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import TMP, store, words
from textloom.llm.logit import labelled, newton, platt

#: Labelled rows of each class that the classifier is fitted on, at most.
SAMPLE = 3000
RIDGE = 1.0
#: A document is kept from this posterior probability on.
THRESHOLD = 0.5
#: Bounds of a prior's strength in documents.
STRENGTH = (1.0, 1e4)

_CAPS, _DIGIT, _ALPHA = re.compile(rb"[A-Z]"), bytes(range(0x30, 0x3A)), bytes([*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_UPPER, _MARKS = bytes(range(0x41, 0x5B)), b"#*$%&|<>@~^=_{}[]\\"
FEATURES = 12


def style(text: str | None) -> list[float]:
    """Style features of a whole text, all bounded."""
    w = words(text)
    n = len(w)
    if not n:
        return [0.0] * (FEATURES - 1) + [1.0]
    raw = text.encode()
    size = len(raw)
    share = lambda chars: (size - len(raw.translate(None, chars))) / size
    distinct = set(w)
    again = sum(map(bytes.__eq__, w, w[1:])) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    alpha = share(_ALPHA)
    return [
        math.log1p(n) / 10,
        min(1.0, size / n / 30),
        min(1.0, 10 * share(_MARKS)),
        share(_UPPER) / max(alpha, 1e-9) if alpha else 0.0,
        min(1.0, 10 * share(_DIGIT)),
        1 - alpha,
        min(1.0, 10 * raw.count(b"!") / size),
        w.count(b"|") / n,
        again,
        len(distinct) / n**0.8 if n > 1 else 1.0,
        1 - len(set(lines)) / len(lines),
        float(n < 5),
    ]


def evidence(text: Column, weights: np.ndarray, a: float, b: float) -> Column:
    """The classifier's calibrated log-odds of each text."""

    def judge(texts: pa.Array) -> pa.Array:
        out = np.empty(len(texts))
        for low in range(0, len(texts), 500):
            x = np.array([style(t) for t in texts.slice(low, 500).to_pylist()])
            out[low : low + 500] = a * (x @ weights[:-1] + weights[-1]) + b
        return pa.array(np.clip(out, -30, 30))

    return F.arrow_udf(judge, "double").asNondeterministic()(text)  # so that a plan works it out once, not for each mention


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, per_class: int = SAMPLE) -> tuple[np.ndarray, float, float]:
    """Weights, calibration slope and shift. Without both classes the evidence is even (all zero)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [style(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])

    got = labelled(docs, labels, "quality", per_class, id_col, text_col).mapInArrow(run, "doc_id long, label int, x array<double>").collect()
    got.sort(key=lambda r: (r[0], r[1]))
    y = np.array([r[1] for r in got], dtype=np.float64)
    if not 0 < y.sum() < len(y):
        return np.zeros(FEATURES + 1), 1.0, 0.0
    x = np.array([r[2] for r in got])
    share = {r[0]: r[1] for r in labels.where("quality in (0, 1)").groupBy("quality").count().collect()}
    weight = np.where(y == 1, share.get(1, 1) / y.sum(), share.get(0, 1) / (len(y) - y.sum()))
    weight *= len(y) / weight.sum()
    half = np.arange(len(y)) % 2 == 0
    if not (0 < y[half].sum() < half.sum() and 0 < y[~half].sum() < (~half).sum()):
        half[:] = True
    w = newton(x[half], y[half], weight[half], RIDGE)
    held = half if half.all() else ~half
    return w, *platt(x[held] @ w[:-1] + w[-1], y[held], weight[held])


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, n: str, s: str, mean: Column) -> float:
    """The prior's strength in documents, from the spread of the sites' means around `mean` (method of moments)."""
    p = F.col(s) / F.col(n)
    row = (
        sites.select(F.col(n).alias("n"), p.alias("p"), mean.alias("m"))
        .where("n > 1")
        .agg(F.count(F.lit(1)), F.avg(F.pow(F.col("p") - F.col("m"), 2)), F.avg(F.col("m") * (1 - F.col("m")) / F.col("n")), F.avg(F.col("m") * (1 - F.col("m"))))
        .first()
    )
    if not row[0]:
        return STRENGTH[0]
    between = max(row[1] - row[2], 1e-9)
    return min(max((row[3] or 0.0) / between - 1, STRENGTH[0]), STRENGTH[1])


def _judged(rows: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """`rows` (helper columns host, path and z) with host_posterior, path_posterior and posterior of each, by helper names.

    The sums of a row's host and path, over `seen` (the same rows, if `rows` are not
    to be read for them), come to it from the small table of sites, and its own
    evidence is taken off there.
    """
    host, path, z, p = (F.col(f"{TMP}{c}") for c in ("host", "path", "z", "p"))
    own = 1 / (1 + F.exp(-z))
    rows = rows.withColumn(f"{TMP}p", own)
    paths = store((seen or rows).groupBy(host.alias("h"), path.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum(own).alias("s")), "paths")
    hosts = store(paths.groupBy("h").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")), "hosts")
    n, s = hosts.agg(F.sum("hn"), F.sum("hs")).first()
    prior = min(max((s or 0.0) / n if n else 0.5, 1e-6), 1 - 1e-6)
    kh = _strength(hosts, "hn", "hs", F.lit(prior))
    hosts = hosts.withColumn("mean", (F.col("hs") + kh * prior) / (F.col("hn") + kh)).withColumnRenamed("h", "own")
    sites = store(paths.join(hosts, F.col("h").eqNullSafe(F.col("own"))).drop("own"), "sites")
    kp = _strength(sites, "n", "s", F.col("mean"))
    sites = sites.select(*[F.col(c).alias(f"{TMP}{t}") for c, t in (("h", "h"), ("p", "q"), ("n", "n"), ("s", "s"), ("hn", "hn"), ("hs", "hs"))])
    others = lambda total, own: F.greatest(F.col(f"{TMP}{total}") - own, F.lit(0.0))
    of_host = (others("hs", p) + kh * prior) / (F.col(f"{TMP}hn") - 1 + kh)
    of_path = (others("s", p) + kp * of_host) / (F.col(f"{TMP}n") - 1 + kp)
    joined = rows.join(sites, host.eqNullSafe(F.col(f"{TMP}h")) & path.eqNullSafe(F.col(f"{TMP}q")))
    joined = joined.withColumn(f"{TMP}host_posterior", of_host).withColumn(f"{TMP}path_posterior", of_path)
    step = _logit(F.least(F.greatest(F.col(f"{TMP}path_posterior"), F.lit(1e-6)), F.lit(1 - 1e-6))) - float(math.log(prior / (1 - prior)))
    return joined.withColumn(f"{TMP}posterior", 1 / (1 + F.exp(-(z + step))))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | str = "source", path: Column | str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, host, path, evidence, host_posterior, path_posterior, posterior and kept of every row.

    The posteriors of host and path are those of a site's other documents, so a
    site of one document has its prior. Null and empty texts are judged like any
    other, by features of a text without words; long ones whole. Null hosts and
    paths are sites of their own. Repeated rows count and come back as often;
    null ids stay null. Without labels of both classes the evidence is even and
    every row is kept. Other columns are not read. An empty table gives no rows.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    z = evidence(F.col(text_col), *fit(docs, labels, id_col, text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), col(host).cast("string").alias(f"{TMP}host"), col(path).cast("string").alias(f"{TMP}path"), z.alias(f"{TMP}z"))
    out = {"host": "host", "path": "path", "evidence": "p", "host_posterior": "host_posterior", "path_posterior": "path_posterior", "posterior": "posterior"}
    return _judged(store(rows, "evidence")).select("doc_id", *[F.col(TMP + c).alias(name) for name, c in out.items()], (F.col(f"{TMP}posterior") >= threshold).alias("kept"))


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: Column | str = "source", path: Column | str = "lang", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the rows that are rejected, each judged by itself, whatever its id; columns may have any names.

    Nulls, long texts, missing labels and empty tables are as in `classify`. The
    evidence is worked out twice, for the sites and for the verdicts, so texts are
    neither stored nor moved.
    """
    col = lambda c: F.col(c) if isinstance(c, str) else c
    z = evidence(F.col(text_col), *fit(docs, labels, id_col, text_col))
    rows = docs.select("*", col(host).cast("string").alias(f"{TMP}host"), col(path).cast("string").alias(f"{TMP}path"), z.alias(f"{TMP}z"))
    return _judged(rows, rows.select(f"{TMP}host", f"{TMP}path", f"{TMP}z")).where(F.col(f"{TMP}posterior") >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
