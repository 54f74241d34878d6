"""Trend lines: least squares inside the JVM, local regression by group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


def linear_trend(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """by…, slope, intercept, n of the least-squares line; null slope with fewer than two places."""
    known = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.filter(known).groupBy(*by).agg(F.regr_slope(F.col(y).cast("double"), F.col(x).cast("double")).alias("slope"), F.regr_intercept(F.col(y).cast("double"), F.col(x).cast("double")).alias("intercept"), F.count("*").alias("n"))


def local_fit(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: float = 0.75, times: np.ndarray | None = None) -> np.ndarray:
    """Local quadratic regression with tricube weights over the nearest share `span` of the points.

    A point may stand for several of the same place (`times`) with its mean: the fit is that of all of them, since points of one
    place have one weight and errors about their mean do not depend on the fit.
    """
    times = np.ones(len(x)) if times is None else np.asarray(times, float)
    n = int(times.sum())
    if n < 2:
        return np.full(len(at), y[0] if n else np.nan)
    q = min(n, max(3, int(np.ceil(span * n))))
    out = np.empty(len(at))
    for i, x0 in enumerate(at):
        far = np.abs(x - x0)
        order = np.argsort(far, kind="stable")
        reach = far[order[np.searchsorted(np.cumsum(times[order]), q)]]
        reach = max(reach, 1e-12) * (1 + 1e-9)
        w = np.sqrt(times * np.clip(1 - (far / reach) ** 3, 0, None) ** 3)
        basis = np.vander((x - x0) / reach, 3, increasing=True)[:, : min(3, n)]
        out[i] = np.linalg.lstsq(basis * w[:, None], y * w, rcond=None)[0][0]
    return out


def loess_trend(df: DataFrame, x: str, y: str, by: list[str], *, span: float = 0.75, points: int = 80) -> DataFrame:
    """by…, x, fitted at evenly spaced places between the least and the largest x. x and y become doubles.

    Values of one place are averaged first, on the map side too, and count as many times in the fit, which is the same: a group in
    a task is as large as it has places (days of an analysis, for one), however many athletes it is made of.
    """
    group = by or ["_all"]
    src = df if by else df.withColumn("_all", F.lit(0))
    src = src.select(*group, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null")
    src = src.groupBy(*group, "x").agg(F.avg("y").alias("y"), F.count("*").alias("times"))
    kinds = dict(src.dtypes)

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("x")
        a, b = part.x.to_numpy(), part.y.to_numpy()
        at = np.unique(np.linspace(a.min(), a.max(), points))
        return pd.DataFrame({**{g: [part[g].iloc[0]] * len(at) for g in group}, "x": at, "fitted": local_fit(a, b, at, span, part.times.to_numpy())})

    schema = ", ".join(f"`{g}` {kinds[g]}" for g in group) + ", x double, fitted double"
    return src.groupBy(*group).applyInPandas(fit, schema).select(*by, "x", "fitted")
