"""Daily load of activities that arrive as a stream; the operators themselves are for bounded tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.load import with_load
from ..schema import ATHLETE


def daily_load_stream(activities: DataFrame, *, metric: str = "duration_mins", time: str = "start_date_local", lateness: str = "2 days", **thresholds) -> DataFrame:
    """athlete_id, date, daily_load, n_activities of a streaming (or bounded) table of activities; a day is final once its end is
    `lateness` behind the latest start seen, and later activities of it are dropped."""
    loads = with_load(activities, metric, **thresholds).withWatermark(time, lateness)
    by = loads.groupBy(F.window(time, "1 day"), ATHLETE).agg(F.sum("load").alias("daily_load"), F.count("*").alias("n_activities"))
    return by.select(ATHLETE, F.to_date("window.start").alias("date"), "daily_load", "n_activities")
