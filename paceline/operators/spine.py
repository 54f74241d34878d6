"""Gap-free daily series by athlete, and rolling means over them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..params import one_of
from ..schema import ATHLETE


def with_athlete(df: DataFrame) -> DataFrame:
    """df with athlete_id: the literal "self" where the table is of one athlete and has no such column."""
    return df if ATHLETE in df.columns else df.withColumn(ATHLETE, F.lit("self"))


def in_scope(activities: DataFrame, types: Sequence[str] | None, end: dt.date) -> DataFrame:
    """Activities of the types up to the last day; null types are all types."""
    out = activities.filter(F.col("date") <= F.lit(end))
    return out if types is None else out.filter(F.col("type").isin(*types))


def history_bounds(scoped: DataFrame, fetch_start: dt.date) -> DataFrame:
    """athlete_id, first_day of the series, first_available: a series begins with the history buffer, or with the athlete's first
    activity if that is later, so days before anything is known are absent, not zero.  Athletes without activity in it are left out.
    """
    by = scoped.groupBy(ATHLETE).agg(F.min("date").alias("first_available"), F.max("date").alias("last_available"))
    by = by.filter(F.col("last_available") >= F.lit(fetch_start))
    return by.select(ATHLETE, F.greatest(F.lit(fetch_start), "first_available").alias("first_day"), "first_available")


def daily_spine(loads: DataFrame, *, types: Sequence[str] | None, fetch_start: dt.date, end: dt.date, missing_load: str = "zero") -> DataFrame:
    """athlete_id, date, daily_load for each day from the athlete's first day to the last, from activities with load.

    Days without activity count 0.  A day whose loads are all unknown counts 0 ("zero") or null ("na").  Empty days are added
    as rows and summed with the rest, so the series needs no join.
    """
    one_of("missing_load", missing_load, ("zero", "na"))
    scoped = in_scope(loads, types, end)
    days = history_bounds(scoped, fetch_start).select(ATHLETE, F.explode(F.sequence("first_day", F.lit(end))).alias("date"), F.lit(None).cast("double").alias("load"), F.lit(0).alias("active"))
    own = scoped.filter(F.col("date") >= F.lit(fetch_start)).select(ATHLETE, "date", F.col("load").cast("double").alias("load"), F.lit(1).alias("active"))
    by = days.unionByName(own).groupBy(ATHLETE, "date").agg(F.sum("load").alias("load"), F.max("active").alias("active"))
    value = F.coalesce("load", F.lit(0.0))
    if missing_load == "na":
        value = F.when(F.col("active") == 1, F.col("load")).otherwise(F.lit(0.0))
    return by.select(ATHLETE, "date", value.alias("daily_load"), (F.col("active") == 1).alias("had_activity"))


def by_day() -> "Window":
    return Window.partitionBy(ATHLETE).orderBy("date")


def rolling_mean(x: Column, k: int) -> Column:
    """Mean of the last k days; null unless all k are known."""
    frame = by_day().rowsBetween(-(k - 1), 0)
    return F.when(F.count(x).over(frame) == k, F.avg(x).over(frame))


def ratio(acute: Column, chronic: Column, above: float) -> Column:
    """acute / chronic where chronic is above a bound, else null."""
    return F.when(chronic > above, F.try_divide(acute, chronic))


def history_warnings(loads: DataFrame, *, types: Sequence[str] | None, fetch_start: dt.date, start: dt.date, end: dt.date, baseline_days: int) -> DataFrame:
    """athlete_id, first_available, affected_days, n_unknown of the athletes whose first days rest on a short baseline,
    or in whose series loads are unknown: what a caller may want to be warned of."""
    scoped = in_scope(loads, types, end)
    by = scoped.groupBy(ATHLETE).agg(F.min("date").alias("first_available"), F.count(F.when(F.col("load").isNull() & (F.col("date") >= F.lit(fetch_start)), 1)).alias("n_unknown"))
    until = F.least(F.date_add("first_available", baseline_days - 2), F.lit(end))
    days = F.when(F.col("first_available") > F.lit(fetch_start), F.greatest(F.lit(0), F.datediff(until, F.lit(start)) + 1)).otherwise(0)
    return by.select(ATHLETE, "first_available", days.alias("affected_days"), "n_unknown").filter("affected_days > 0 or n_unknown > 0")
