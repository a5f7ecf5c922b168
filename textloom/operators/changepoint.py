"""Change points of series by penalised exact segmentation with pruning."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Calibrated multiple of the penalty, components used, years that count as near.
MULTIPLE, COMPONENTS, NEAR = 3.0, 4, 1


def penalty(n: int, dim: int, multiple: float = MULTIPLE) -> float:
    return multiple * dim * math.log(max(n, 2))


def segment(x: np.ndarray, pen: float) -> list[int]:
    """Where segments of least squared error begin, each costing `pen`; 0 is not named.

    All live starts are weighed at once from prefix sums; a start that is
    already costlier than the best end can never win again and is dropped.
    """
    x = np.asarray(x, dtype=float).reshape(len(x), -1)
    n = len(x)
    s1 = np.vstack([np.zeros(x.shape[1]), np.cumsum(x, axis=0)])
    s2 = np.r_[0.0, np.cumsum((x**2).sum(axis=1))]
    best, back = np.zeros(n + 1), np.zeros(n + 1, dtype=int)
    live = np.array([0])
    for t in range(1, n + 1):
        cost = best[live] + s2[t] - s2[live] - ((s1[t] - s1[live]) ** 2).sum(axis=1) / (t - live)
        at = int(np.argmin(cost))
        best[t], back[t] = cost[at] + pen, live[at]
        live = np.r_[live[cost <= best[t]], t]
    out: list[int] = []
    t = n
    while back[t] > 0:
        t = int(back[t])
        out.append(t)
    return out[::-1]


def change_points(series: DataFrame, group: str, t: str, cols: list[str], multiple: float = MULTIPLE) -> DataFrame:
    """(group, index, t): change points of every group's series in order of t; a series is serial, groups are not."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("t", ignore_index=True)
        at = segment(g[cols].to_numpy(dtype=float), penalty(len(g), len(cols), multiple))
        return g.iloc[at][["grp", "t"]].assign(index=np.array(at, dtype=np.int32))[["grp", "index", "t"]].reset_index(drop=True)

    rows = series.select(F.col(group).alias("grp"), F.col(t).alias("t"), *[F.col(c).cast("double").alias(c) for c in cols])
    kind = dict(rows.dtypes)
    return rows.groupBy("grp").applyInPandas(run, f"grp {kind['grp']}, index int, t {kind['t']}")


def split_costs(series: DataFrame, group: str, t: str, x: str) -> DataFrame:
    """(group, t, cost): squared error of the two parts before and from each t, from running sums."""
    run = Window.partitionBy(group).orderBy(t)
    all_ = Window.partitionBy(group)
    value = F.col(x).cast("double")
    rows = series.select(
        group, t, F.row_number().over(run).alias("i"), F.count(F.lit(1)).over(all_).alias("n"),
        (F.sum(value).over(run) - value).alias("a"), F.sum(value).over(all_).alias("sum"), F.sum(value * value).over(all_).alias("sq"),
    )
    left, right = F.col("i") - 1, F.col("n") - F.col("i") + 1
    b = F.col("sum") - F.col("a")
    cost = F.col("sq") - F.when(left > 0, F.col("a") * F.col("a") / left).otherwise(0.0) - b * b / right
    return rows.select(group, t, cost.alias("cost"))


def near(points: DataFrame, received: DataFrame, t: str, year: str, within: int = NEAR) -> DataFrame:
    """Change points with each received year at most `within` away."""
    return points.join(F.broadcast(received), F.abs(F.col(t) - F.col(year)) <= within)


def year_series(features: DataFrame, year: str, cols: list[str]) -> DataFrame:
    """Means by year, then standardised over the years; years without works are absent."""
    from textloom.operators.clusters import standardize

    means = features.where(F.col(year).isNotNull()).groupBy(F.col(year).alias("year")).agg(*[F.avg(c).alias(c) for c in cols])
    return standardize(means, cols)


def principal_series(series: DataFrame, t: str, cols: list[str], k: int = COMPONENTS) -> DataFrame:
    """(t, pc1 .. pck): scores on the first principal components."""
    from textloom.operators.vectors import components

    k = min(k, len(cols))
    mean, basis, _ = components(series.select(F.array(*cols).alias("v")), "v", k, center=True)
    score = lambda j: sum(((F.col(c) - float(mean[i])) * float(basis[i, j]) for i, c in enumerate(cols)), F.lit(0.0))
    return series.select(t, *[score(j).alias(f"pc{j + 1}") for j in range(k)])
