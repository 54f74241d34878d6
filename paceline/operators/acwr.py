"""Acute-to-chronic workload ratio from rolling means, and load exposure."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..params import frame, ordered_periods, positive_ints, types as as_types, window
from ..schema import ACWR_ZONES, ATHLETE
from .load import with_load
from .spine import daily_spine, ratio, rolling_mean, with_athlete

EXPOSURE_TYPES = ("Run", "Ride", "VirtualRide", "VirtualRun")


def _check(activities: DataFrame, kinds, metric: str, start: dt.date, end: dt.date, history_days: int, baseline_days: int, missing_load: str, ftp, max_hr, rest_hr) -> None:
    from ..checks import check_history

    check_history(activities, kinds, metric, start=start, end=end, history_days=history_days, baseline_days=baseline_days, missing_load=missing_load, user_ftp=ftp, user_max_hr=max_hr, user_resting_hr=rest_hr)


def calculate_acwr(
    activities: DataFrame, activity_type: str | Sequence[str] | None = None, load_metric: str = "duration_mins", acute_period: int = 7, chronic_period: int = 28,
    start_date: object = None, end_date: object = None, user_ftp: float | None = None, user_max_hr: float | None = None, user_resting_hr: float | None = None,
    smoothing_period: int = 7, missing_load: str = "zero", *, checked: bool = False,
) -> DataFrame:
    """athlete_id, date, atl, ctl, acwr, acwr_smooth for each day of the analysis.

    The smoothed ratio averages days of the analysis only, so its first days are null.  With `checked`, a small job first fails
    if there is nothing to analyse and warns of short histories and unknown loads (see check_history).
    """
    kinds = as_types(activity_type, required=True)
    ordered_periods(acute_period, chronic_period)
    positive_ints(smoothing_period=smoothing_period)
    start, end = window(start_date, end_date)
    if checked:
        _check(activities, kinds, load_metric, start, end, chronic_period, chronic_period, missing_load, user_ftp, user_max_hr, user_resting_hr)
    loads = with_load(with_athlete(frame(activities)), load_metric, user_ftp=user_ftp, user_max_hr=user_max_hr, user_resting_hr=user_resting_hr)
    days = daily_spine(loads, types=kinds, fetch_start=start - dt.timedelta(days=chronic_period), end=end, missing_load=missing_load)
    x = F.col("daily_load")
    series = days.select(ATHLETE, "date", rolling_mean(x, acute_period).alias("atl"), rolling_mean(x, chronic_period).alias("ctl"))
    series = series.filter(F.col("date") >= F.lit(start)).withColumn("acwr", ratio(F.col("atl"), F.col("ctl"), 0.01))
    return series.withColumn("acwr_smooth", rolling_mean(F.col("acwr"), smoothing_period))


def calculate_exposure(
    activities: DataFrame, activity_type: str | Sequence[str] | None = EXPOSURE_TYPES, load_metric: str = "duration_mins", acute_period: int = 7, chronic_period: int = 42,
    user_ftp: float | None = None, user_max_hr: float | None = None, user_resting_hr: float | None = None, end_date: object = None, missing_load: str = "zero", *, checked: bool = False,
) -> DataFrame:
    """athlete_id, date, daily_load, atl, ctl, acwr for the last chronic_period days; `checked` as in calculate_acwr()."""
    kinds = as_types(activity_type)
    ordered_periods(acute_period, chronic_period)
    _, end = window(None, end_date)
    start = end - dt.timedelta(days=chronic_period - 1)
    if checked:
        _check(activities, kinds, load_metric, start, end, chronic_period, chronic_period, missing_load, user_ftp, user_max_hr, user_resting_hr)
    loads = with_load(with_athlete(frame(activities)), load_metric, user_ftp=user_ftp, user_max_hr=user_max_hr, user_resting_hr=user_resting_hr)
    days = daily_spine(loads, types=kinds, fetch_start=end - dt.timedelta(days=2 * chronic_period - 1), end=end, missing_load=missing_load)
    x = F.col("daily_load")
    series = days.select(ATHLETE, "date", "daily_load", rolling_mean(x, acute_period).alias("atl"), rolling_mean(x, chronic_period).alias("ctl"))
    return series.filter(F.col("date") >= F.lit(start)).withColumn("acwr", ratio(F.col("atl"), F.col("ctl"), 0.0))


def zone(value: Column) -> Column:
    """The name of the ratio's zone: low, reference, elevated or high; null for null."""
    out = F.lit(None).cast("string")
    for name, low, _ in ACWR_ZONES:
        out = F.when(value.isNotNull() if low is None else value > low if name == "high" else value >= low, F.lit(name)).otherwise(out)
    return out
