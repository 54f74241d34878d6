"""Per-activity figures of a stream: sampling interval and time-weighted coverage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..schema import ACTIVITY, ATHLETE

KEYS = (ATHLETE, ACTIVITY)


def with_keys(streams: DataFrame) -> DataFrame:
    """streams with athlete_id ("self"), activity_id (0) and seq_no where they are absent.

    Without seq_no the order of rows is that of time; rows of equal time are then in no order.
    """
    for name, value in ((ATHLETE, F.lit("self")), (ACTIVITY, F.lit(0).cast("long"))):
        if name not in streams.columns:
            streams = streams.withColumn(name, value)
    return streams if "seq_no" in streams.columns else streams.withColumn("seq_no", F.lit(0).cast("long"))


def normalized(streams: DataFrame) -> DataFrame:
    """streams with the names that operators use: heartrate and watts (also from heart_rate and power), time_s in seconds (also
    from time, a number or a timestamp), and the keys."""
    out = with_keys(streams)
    for old, new in (("heart_rate", "heartrate"), ("power", "watts")):
        if old in out.columns:
            out = out.drop(old) if new in out.columns else out.withColumnRenamed(old, new)
    if "time_s" not in out.columns and "time" in out.columns:
        out = out.withColumn("time_s", F.col("time").cast("timestamp").cast("double") if dict(out.dtypes)["time"].startswith("timestamp") else F.col("time").cast("double"))
    return out


def checked_rows(df: DataFrame, what: str) -> None:
    """An error if df has no rows."""
    from ..checks import require_rows

    require_rows(df, what)


def streams_of(activities: DataFrame, export_dir: str | None) -> DataFrame:
    """The streams of the activities' files in an export."""
    if export_dir is None:
        raise ValueError("give streams, or export_dir to read them from")
    from ..sources.tracks import activity_streams

    return activity_streams(activities.sparkSession, activities, export_dir)


def of_activity(*more: str) -> Window:
    return Window.partitionBy(*KEYS, *more)


def in_time(*more: str) -> Window:
    return of_activity(*more).orderBy(F.col("time_s").asc_nulls_last(), "seq_no")


def positive_gap(*more: str) -> Column:
    """Seconds since the previous sample; null if not positive."""
    gap = F.col("time_s") - F.lag("time_s").over(in_time(*more))
    return F.when(gap > 0, gap)


def sampling_interval(streams: DataFrame) -> DataFrame:
    """athlete_id, activity_id, sampling_interval_seconds: the median of the positive gaps, 1 without any."""
    s = normalized(streams).withColumn("gap", positive_gap())
    return s.groupBy(*KEYS).agg(F.coalesce(F.median("gap"), F.lit(1.0)).alias("sampling_interval_seconds"))


def coverage_columns(valid: Column) -> dict[str, Column]:
    """_valid and _segment (seconds of the gap before a row, null at the first), _covered (those with valid samples at both ends)."""
    both = F.col("_valid") & F.lag("_valid").over(in_time())
    return {"_valid": F.coalesce(valid, F.lit(False)), "_segment": F.col("time_s") - F.lag("time_s").over(in_time()), "_both": both}


def coverage_value() -> Column:
    """The share of time with valid samples at both ends, from the columns above; of rows if there is one row or no time passes."""
    total, rows = F.sum("_segment"), F.avg(F.col("_valid").cast("double"))
    return F.when((F.count("*") < 2) | total.isNull() | (total <= 0), rows).otherwise(F.coalesce(F.sum(F.when(F.col("_both"), F.col("_segment"))), F.lit(0.0)) / total)


def coverage(streams: DataFrame, column: str = "heartrate", valid: Callable[[Column], Column] | None = None) -> DataFrame:
    """athlete_id, activity_id, coverage of a channel; an absent channel counts as covered. Valid: known and above 0, or by a predicate."""
    s = normalized(streams)
    if column not in s.columns:
        return s.select(*KEYS).distinct().withColumn("coverage", F.lit(1.0))
    test = valid(F.col(column)) if valid else F.col(column).isNotNull() & (F.col(column) > 0)
    parts = coverage_columns(test)
    s = s.withColumn("_valid", parts["_valid"]).withColumn("_segment", parts["_segment"]).withColumn("_both", parts["_both"])
    return s.groupBy(*KEYS).agg(coverage_value().alias("coverage"))
