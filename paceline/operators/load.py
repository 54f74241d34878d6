"""Training load of activities, with a status for each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clean, column_or_null, normalized_power
from ..params import load_metric
from ..schema import ATHLETE


def _value_and_status(df: DataFrame, metric: str, *, user_ftp: float | None = None, user_max_hr: float | None = None, user_resting_hr: float | None = None) -> tuple[Column, Column]:
    """The load, of use where the status is ok, and the status: the first test of a metric that fails."""
    get = lambda name: clean(column_or_null(df, name))
    moving, elapsed, meters, climb, heart = (get(c) for c in ("moving_time", "elapsed_time", "distance", "elevation_gain", "average_heartrate"))
    power = normalized_power(df)
    ftp, top, rest = (F.lit(None).cast("double") if x is None else F.lit(float(x)) for x in (user_ftp, user_max_hr, user_resting_hr))
    no_time = (moving.isNull() | (moving <= 0), "missing_duration")
    rules: dict[str, tuple[list[tuple[Column, str]], Column]] = {
        "duration_mins": ([no_time], moving / 60),
        "distance_km": ([(meters.isNull(), "missing_distance")], meters / 1000),
        "elapsed_time_mins": ([(elapsed.isNull() | (elapsed <= 0), "missing_elapsed_time")], elapsed / 60),
        "elevation_gain_m": ([(climb.isNull(), "missing_elevation_gain")], climb),
        "hrss": (
            [no_time, (top.isNull() | rest.isNull() | (top <= rest), "missing_threshold_hr"), (heart.isNull() | (heart <= 0), "missing_heart_rate"), ((heart <= rest) | (heart > top), "hr_out_of_range")],
            moving / 60 * F.try_divide(heart - rest, top - rest),
        ),
        "tss": (
            [no_time, (ftp.isNull() | (ftp <= 0), "missing_ftp"), (power <= 0, "missing_power")],
            F.try_divide(moving * power * F.try_divide(power, ftp), ftp * 3600) * 100,
        ),
    }
    tests, value = rules.get(metric, ([(F.lit(True), "unsupported_metric")], F.lit(None).cast("double")))
    status = F.lit("ok")
    for test, name in reversed(tests):
        status = F.when(test, F.lit(name)).otherwise(status)
    return value, status


def load_columns(df: DataFrame, metric: str = "duration_mins", **thresholds) -> dict[str, Column]:
    """load (null unless the status is ok) and load_status. Absent columns, nulls, NaN and infinities are missing."""
    value, status = _value_and_status(df, metric, **thresholds)
    return {"load": F.when(status == "ok", value), "load_status": status}


def long_loads(activities: DataFrame, metrics: Sequence[str], keep: Sequence[str], **thresholds) -> DataFrame:
    """The columns of `keep`, metric, load, load_status: a row for each activity and metric.

    Values and statuses are columns of their own before they are put together, so each is worked out once.
    """
    both = {m: _value_and_status(activities, m, **thresholds) for m in metrics}
    wide = activities.select(*keep, *[c.alias(f"{part}_{m}") for m, pair in both.items() for part, c in zip(("value", "status"), pair)])
    rows = [F.struct(F.lit(m).alias("metric"), F.when(F.col(f"status_{m}") == "ok", F.col(f"value_{m}")).alias("load"), F.col(f"status_{m}").alias("load_status")) for m in metrics]
    return wide.select(*keep, F.inline(F.array(*rows)))


def with_load(activities: DataFrame, metric: str = "duration_mins", **thresholds) -> DataFrame:
    """activities with load and load_status; rows whose load cannot be computed stay."""
    load_metric(metric, thresholds.get("user_ftp"), thresholds.get("user_max_hr"), thresholds.get("user_resting_hr"))
    return activities.withColumns(load_columns(activities, metric, **thresholds))


def daily_load(loads: DataFrame, by: tuple[str, ...] = (ATHLETE, "date")) -> DataFrame:
    """Sum of loads by athlete and day; null only if no load of the day is known."""
    return loads.groupBy(*by).agg(F.sum("load").alias("daily_load"), F.count("*").alias("n_activities"))


def status_histogram(loads: DataFrame, limit: int | None = 3) -> DataFrame:
    """The most frequent statuses other than ok, by count, then name; all of them for limit None."""
    out = loads.filter("load_status != 'ok'").groupBy("load_status").agg(F.count("*").alias("n"))
    return out if limit is None else out.orderBy(F.desc("n"), "load_status").limit(limit)
