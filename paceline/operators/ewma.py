"""Acute-to-chronic ratio by exponential weights, with moving-block bootstrap bands."""

from __future__ import annotations

import datetime as dt
import math
import warnings
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..params import frame, one_of, ordered_periods, positive_ints, types as as_types, window
from ..schema import ATHLETE
from .acwr import _check
from .load import with_load
from .spine import daily_spine, ratio, rolling_mean, with_athlete


def smoothing_factor(half_life: float) -> float:
    return 1 - math.exp(-math.log(2) / half_life)


def ewma_series(days: DataFrame, alpha_acute: float, alpha_chronic: float) -> DataFrame:
    """athlete_id, date, atl, ctl: both states begin with the first known load; a day of unknown load shows null and leaves them.

    The recursion is a running sum of loads scaled up by their age, scaled down at each day.  So that the scale keeps within 100
    powers of ten, known days are taken in blocks; what a block adds to the next but one is below the precision of a double.
    """
    line = Window.partitionBy(ATHLETE).orderBy("date")
    known, x = F.col("daily_load").isNotNull(), F.col("daily_load")
    s = days.withColumn("_m", F.count("daily_load").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    for name, alpha in (("atl", alpha_acute), ("ctl", alpha_chronic)):
        keep = F.lit(1 - alpha)
        size = max(1, int(100 / -math.log10(1 - alpha)))
        s = s.withColumns({"_b": F.floor((F.col("_m") - 1) / size), "_r": F.pmod(F.col("_m") - 1, F.lit(size)) + 1})
        term = F.when(known, F.when(F.col("_m") == 1, 1.0).otherwise(alpha) * x * F.pow(keep, -F.col("_r")))
        inside = Window.partitionBy(ATHLETE, "_b").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
        s = s.withColumn("_t", term).withColumn("_z", F.pow(keep, F.col("_r")) * F.sum("_t").over(inside))
        before = F.last(F.when(known & (F.col("_r") == size), F.col("_z")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
        s = s.withColumn("_c", before).withColumn(name, F.when(known, F.col("_z") + F.coalesce(F.pow(keep, F.col("_r")) * F.col("_c"), F.lit(0.0))))
    return s.select(ATHLETE, "date", "atl", "ctl")


def ewma_loads(loads: np.ndarray, alpha_acute: float, alpha_chronic: float, smoothing_period: int) -> np.ndarray:
    """The smoothed ratio of rows of daily loads (NaN: unknown), all rows at once."""
    n_rows, n = loads.shape
    a = np.full(n_rows, np.nan)
    c = np.full(n_rows, np.nan)
    out = np.full((n_rows, n), np.nan)
    for i in range(n):
        x = loads[:, i]
        known = ~np.isnan(x)
        fresh = known & np.isnan(a)
        a = np.where(fresh, x, np.where(known, alpha_acute * x + (1 - alpha_acute) * a, a))
        c = np.where(fresh, x, np.where(known, alpha_chronic * x + (1 - alpha_chronic) * c, c))
        ok = known & (c > 0.01)
        out[ok, i] = a[ok] / c[ok]
    smooth = np.full((n_rows, n), np.nan)
    if n >= smoothing_period:
        smooth[:, smoothing_period - 1 :] = np.lib.stride_tricks.sliding_window_view(out, smoothing_period, axis=1).mean(2)
    return smooth


def block_starts(seed: int, athlete: object, n: int, block_len: int, replicates: int) -> np.ndarray:
    """Block starts from 0, replicates x blocks: a function of the seed and the athlete alone."""
    words = [seed, *str(athlete).encode()]
    return np.random.default_rng(words).integers(0, n - block_len + 1, (replicates, -(-n // block_len)))


def resample(loads: np.ndarray, block_len: int, starts: np.ndarray) -> np.ndarray:
    """Rows of loads put together from overlapping blocks at the starts (from 0), cut to the length of the loads."""
    n = len(loads)
    block_len = min(max(1, block_len), n)
    starts = np.atleast_2d(starts)
    if starts.shape[1] < -(-n // block_len) or starts.min() < 0 or starts.max() > n - block_len:
        raise ValueError("starts must be enough places of whole blocks")
    at = starts[:, : -(-n // block_len), None] + np.arange(block_len)
    return loads[at.reshape(len(starts), -1)[:, :n]]


def bootstrap_bands(days: DataFrame, alpha_acute: float, alpha_chronic: float, smoothing_period: int, *, replicates: int, block_len: int, conf_level: float, seed: int) -> DataFrame:
    """athlete_id, date, acwr_lower, acwr_upper: quantiles of the smoothed ratio over resampled series of each athlete."""
    kind = dict(days.dtypes)[ATHLETE]

    def bands(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("date", ignore_index=True)
        loads = part.daily_load.to_numpy(float, na_value=np.nan)
        n = len(loads)
        size = min(block_len, n)
        ratios = ewma_loads(resample(loads, size, block_starts(seed, part[ATHLETE].iloc[0], n, size, replicates)), alpha_acute, alpha_chronic, smoothing_period)
        lower, upper = np.full(n, np.nan), np.full(n, np.nan)
        some = ~np.isnan(ratios).all(0)
        tail = (1 - conf_level) / 2
        if some.any():
            lower[some], upper[some] = np.nanquantile(ratios[:, some], [tail, 1 - tail], axis=0)
        return pd.DataFrame({ATHLETE: part[ATHLETE], "date": part.date, "acwr_lower": lower, "acwr_upper": upper})

    out = days.select(ATHLETE, "date", "daily_load").groupBy(ATHLETE).applyInPandas(bands, f"{ATHLETE} {kind}, date date, acwr_lower double, acwr_upper double")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("acwr_lower", "acwr_upper")})


def calculate_acwr_ewma(
    activities: DataFrame, activity_type: str | Sequence[str] | None = None, load_metric: str = "duration_mins", method: str = "ra", acute_period: int = 7, chronic_period: int = 28,
    half_life_acute: float = 3.5, half_life_chronic: float = 14, start_date: object = None, end_date: object = None, user_ftp: float | None = None, user_max_hr: float | None = None,
    user_resting_hr: float | None = None, smoothing_period: int = 7, ci: bool = False, B: int = 200, block_len: int = 7, conf_level: float = 0.95, missing_load: str = "zero", seed: int = 1, *, checked: bool = False,
) -> DataFrame:
    """athlete_id, date, atl, ctl, acwr, acwr_smooth (and acwr_lower, acwr_upper with ci) by rolling means or exponential weights.

    Here the ratio is smoothed before the analysis is cut out, so its first days have values.  Bands need method "ewma".
    `checked` as in calculate_acwr().
    """
    kinds = as_types(activity_type, required=True)
    one_of("method", method, ("ra", "ewma"))
    ordered_periods(acute_period, chronic_period)
    ordered_periods(half_life_acute, half_life_chronic, "half-life")
    positive_ints(smoothing_period=smoothing_period, B=B, block_len=block_len)
    if not 0 < conf_level < 1:
        raise ValueError(f"conf_level must be between 0 and 1, not {conf_level!r}")
    if ci and method == "ra":
        warnings.warn("bands are made for method 'ewma' only", stacklevel=2)
        ci = False
    start, end = window(start_date, end_date)
    buffer = chronic_period if method == "ra" else math.ceil(4 * half_life_chronic)
    if checked:
        _check(activities, kinds, load_metric, start, end, buffer, chronic_period, missing_load, user_ftp, user_max_hr, user_resting_hr)
    loads = with_load(with_athlete(frame(activities)), load_metric, user_ftp=user_ftp, user_max_hr=user_max_hr, user_resting_hr=user_resting_hr)
    days = daily_spine(loads, types=kinds, fetch_start=start - dt.timedelta(days=buffer), end=end, missing_load=missing_load)
    if method == "ra":
        x = F.col("daily_load")
        series = days.select(ATHLETE, "date", rolling_mean(x, acute_period).alias("atl"), rolling_mean(x, chronic_period).alias("ctl"))
    else:
        acute, chronic = smoothing_factor(half_life_acute), smoothing_factor(half_life_chronic)
        series = ewma_series(days, acute, chronic)
    series = series.withColumn("acwr", ratio(F.col("atl"), F.col("ctl"), 0.01)).withColumn("acwr_smooth", rolling_mean(F.col("acwr"), smoothing_period))
    series = series.filter(F.col("date") >= F.lit(start))
    if ci:
        bands = bootstrap_bands(days, acute, chronic, smoothing_period, replicates=B, block_len=block_len, conf_level=conf_level, seed=seed)
        series = series.join(bands, [ATHLETE, "date"], "left")
    return series
