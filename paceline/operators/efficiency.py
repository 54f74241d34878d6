"""Efficiency Factor and decoupling of activities, from streams or from summaries.

All steps of the stream path are windows within an activity, so one exchange by activity
serves them; rows that a step drops stay as a part of their own (`_ok…` is false), and each
activity gets its one result row, with the reason if there is no value, from one aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import clean, column_or_null, normalized_power, present
from ..params import fractions, frame, not_negative, output_metric, positive, quality_control as check_control, types as as_types, window
from ..schema import ACTIVITY, ATHLETE
from .coverage import KEYS, coverage_columns, coverage_value, in_time, normalized, of_activity, checked_rows, positive_gap, streams_of
from .spine import with_athlete
from .steady import WINDOW_SECONDS, qualifies, rolling_variation, window_rows, with_blocks

_ENOUGH = 100


def _first_status(*tests: tuple[Column, str]) -> Column:
    out = F.lit("ok")
    for test, name in reversed(tests):
        out = F.when(F.coalesce(test, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def _analysed(streams: DataFrame, metric: str, min_steady_minutes: float, steady_cv_threshold: float, control: str) -> DataFrame:
    """Stream rows with what the steps of the stream path find; constants of the activity are on all of its rows.

    _output and _ratio belong to rows of _ok3; block, block_minutes and block_rows to runs among them.
    """
    s = normalized(streams)
    whole = of_activity()
    speed = metric == "speed_hr"
    s = s.select(
        *KEYS, "seq_no", column_or_null(s, "time_s").alias("time_s"), column_or_null(s, "heartrate").alias("heartrate"), column_or_null(s, "watts").alias("watts"),
        column_or_null(s, "distance").alias("distance"), column_or_null(s, "velocity_smooth").alias("velocity_smooth"),
        (present(s, "time") if "has_time" in s.columns else F.lit("time_s" in s.columns)).alias("_has_time"), present(s, "heartrate").alias("_has_hr"), present(s, "watts").alias("_has_watts"),
        present(s, "distance").alias("_has_distance"), present(s, "velocity_smooth").alias("_has_velocity"))
    s = s.repartition(*KEYS)
    parts = coverage_columns(F.col("heartrate").isNotNull() & (F.col("heartrate") > 0))
    s = s.withColumn("_valid", parts["_valid"]).withColumns({"_segment": parts["_segment"], "_both": parts["_both"], "_gap": positive_gap()})
    s = s.withColumn("_dt", F.coalesce(F.median("_gap").over(whole), F.lit(1.0)))
    s = s.withColumn("_ok1", F.col("time_s").isNotNull() & F.col("heartrate").isNotNull())
    if speed:
        line = in_time("_ok1")
        step, gap = F.col("distance") - F.lag("distance").over(line), F.col("time_s") - F.lag("time_s").over(line)
        first = F.row_number().over(line) == 1
        derived = F.when(first & F.col("distance").isNotNull(), F.lit(0.0)).when(F.coalesce(gap > 0, F.lit(False)), F.try_divide(step, gap)).when(~first, F.lit(0.0))
        s = s.withColumn("_output", F.when(F.col("_has_velocity"), F.col("velocity_smooth")).otherwise(derived))
        low, high = 0.5, 15.0
    else:
        s = s.withColumn("_output", F.col("watts"))
        low, high = 0.0, 2000.0
    s = s.withColumn("_ok2", F.coalesce(F.col("_ok1") & (F.col("_output") > 0) & (F.col("heartrate") > 0), F.lit(False)))
    odd = (F.col("_output") <= low) | (F.col("_output") >= high) | (F.col("heartrate") <= 50) | (F.col("heartrate") >= 220)
    s = s.withColumn("_odd", (F.col("_ok2") & odd) if control != "off" else F.lit(False))
    s = s.withColumn("_ok3", F.col("_ok2") & ~F.col("_odd") if control == "filter" else F.col("_ok2"))
    s = s.withColumn("_gap3", positive_gap("_ok3"))
    s = s.withColumns({"_n3": F.count("*").over(of_activity("_ok3")), "_dt3": F.coalesce(F.median("_gap3").over(of_activity("_ok3")), F.lit(1.0))})
    floor = F.greatest(F.lit(60), F.ceil(F.lit(60.0) / F.col("_dt")))
    s = s.withColumn("_k", window_rows(WINDOW_SECONDS, F.col("_dt3"), floor, F.greatest(F.lit(1), F.floor(F.col("_n3") / 4))))
    s = rolling_variation(s, "_output", "_k", ("_ok3",), out="_cv")
    s = s.withColumn("_steady", F.col("_ok3") & F.coalesce(F.col("_cv") < steady_cv_threshold, F.lit(False)))
    s = with_blocks(s, "_steady", ("_ok3",))
    s = s.withColumn("_qualifies", qualifies(F.col("_steady"), F.col("block_minutes"), F.col("block_rows"), min_steady_minutes))
    best = F.max(F.when(F.col("_qualifies"), F.struct(F.col("block_minutes").alias("minutes"), (-F.col("block")).alias("order")))).over(whole)
    s = s.withColumn("_best", best).withColumn("_chosen", F.col("_qualifies") & (F.col("block") == -F.col("_best.order")))
    return s.withColumn("_ratio", F.when(F.col("_chosen"), F.col("_output") / F.col("heartrate")))


def _gates() -> list[Column]:
    """Counts and figures of an activity that its status is decided by."""
    ok = lambda c: F.count(F.when(F.col(c), 1))
    return [
        F.first("_has_time").alias("has_time"), F.first("_has_hr").alias("has_hr"), F.first("_has_watts").alias("has_watts"), (F.first("_has_distance") | F.first("_has_velocity")).alias("has_speed"),
        coverage_value().alias("coverage"), F.first("_dt").alias("dt"), ok("_ok1").alias("n1"), ok("_ok2").alias("n2"), ok("_ok3").alias("n3"),
        F.count(F.when(F.col("_odd"), 1)).alias("odd"), ((F.max(F.when(F.col("_ok3"), F.col("time_s"))) - F.min(F.when(F.col("_ok3"), F.col("time_s")))) / 60).alias("span"),
        F.coalesce(F.max("_steady"), F.lit(False)).alias("any_steady"), F.first("_best.minutes").alias("minutes"),
        F.count_distinct(F.when(F.col("_qualifies"), F.col("block"))).cast("int").alias("n_blocks"),
    ]


def _quality(control: str) -> Column:
    return F.lit(1.0) if control == "off" else 1 - F.col("odd") / F.col("n2")


def ef_from_streams(streams: DataFrame, ef_metric: str = "speed_hr", *, min_steady_minutes: float = 20, steady_cv_threshold: float = 0.08, min_hr_coverage: float = 0.9, quality_control: str = "filter") -> DataFrame:
    """One row per activity: ef_value, status, ef_metric_requested, ef_metric_used, quality_score, hr_coverage,
    steady_duration_minutes, n_steady_blocks, sampling_interval_seconds.

    Streams have no grade-adjusted speed: gap_hr uses plain speed and says so.  Figures that a rejected activity did not reach are null.
    """
    asked = output_metric("ef_metric", ef_metric)
    metric = "speed_hr" if asked == "gap_hr" else asked
    rows = _analysed(frame(streams, "streams"), metric, min_steady_minutes, steady_cv_threshold, check_control(quality_control))
    by = rows.groupBy(*KEYS).agg(*_gates(), F.median("_ratio").alias("ef"))
    channel = (~F.col("has_speed"), "missing_velocity_data") if metric == "speed_hr" else (~F.col("has_watts"), "missing_power_data")
    status = _first_status(
        channel, (~F.col("has_time") | ~F.col("has_hr"), "missing_hr_data"), (F.col("coverage") < min_hr_coverage, "insufficient_hr_data"), (F.col("n1") < _ENOUGH, "insufficient_data_points"),
        (F.col("n2") < _ENOUGH, "insufficient_valid_data"), (F.col("n3") < _ENOUGH, "insufficient_data_after_quality_filter"), (F.col("span") < min_steady_minutes, "too_short"),
        (~F.col("any_steady"), "non_steady"), (F.col("minutes").isNull(), "insufficient_steady_duration"), (F.col("ef").isNull() | (F.col("ef") <= 0), "calculation_failed"))
    by = by.withColumn("status", status)
    early = F.col("status").isin("missing_velocity_data", "missing_power_data", "missing_hr_data")
    scored = ~early & ~F.col("status").isin("insufficient_hr_data", "insufficient_data_points", "insufficient_valid_data")
    done = F.col("status").isin("ok", "calculation_failed")
    return by.select(
        *KEYS, F.when(F.col("status") == "ok", F.col("ef")).alias("ef_value"),
        F.when((F.col("status") == "ok") & F.lit(asked == "gap_hr"), F.lit("gap_stream_unavailable_fallback_to_speed")).otherwise(F.col("status")).alias("status"),
        F.lit(asked).alias("ef_metric_requested"), F.lit(metric).alias("ef_metric_used"), F.when(scored, _quality(quality_control)).alias("quality_score"), F.when(~early, F.col("coverage")).alias("hr_coverage"),
        F.when(done, F.col("minutes")).alias("steady_duration_minutes"), F.when(done, F.col("n_blocks")).alias("n_steady_blocks"), F.when(~early, F.col("dt")).alias("sampling_interval_seconds"))


def decoupling_from_streams(streams: DataFrame, decouple_metric: str = "speed_hr", *, min_steady_minutes: float = 40, steady_cv_threshold: float = 0.08, min_hr_coverage: float = 0.9, quality_control: str = "filter") -> DataFrame:
    """One row per activity: decoupling (percent, first against second half of the longest steady block, split at the middle of
    its time), status, quality_score, hr_coverage, steady_duration_minutes, sampling_interval_seconds."""
    metric = output_metric("decouple_metric", decouple_metric, ("speed_hr", "power_hr"))
    rows = _analysed(frame(streams, "streams"), metric, min_steady_minutes, steady_cv_threshold, check_control(quality_control))
    block = of_activity("_chosen")
    rows = rows.withColumn("_half", F.col("time_s") <= (F.min("time_s").over(block) + F.max("time_s").over(block)) / 2)
    half = lambda test: F.median(F.when(F.col("_chosen") & test, F.col("_ratio")))
    by = rows.groupBy(*KEYS).agg(*_gates(), half(F.col("_half")).alias("first"), half(~F.col("_half")).alias("second"))
    channel = (~F.col("has_speed"), "missing_velocity_data") if metric == "speed_hr" else (~F.col("has_watts"), "missing_power_data")
    status = _first_status(
        (~F.col("has_time"), "missing_time_data"), (~F.col("has_hr"), "missing_hr_data"), channel, (F.col("coverage") < min_hr_coverage, "insufficient_hr_data"), (F.col("n1") < _ENOUGH, "insufficient_data_points"),
        (F.col("n2") < _ENOUGH, "insufficient_valid_data"), (F.col("n3") < _ENOUGH, "insufficient_data_after_quality_filter"), (~F.col("any_steady"), "non_steady"),
        (F.col("minutes").isNull(), "insufficient_steady_duration"), (F.col("first").isNull() | F.col("second").isNull(), "non_steady"), (F.col("first") <= 0, "calculation_failed"))
    by = by.withColumn("status", status)
    early = F.col("status").isin("missing_time_data", "missing_velocity_data", "missing_power_data", "missing_hr_data")
    scored = ~early & ~F.col("status").isin("insufficient_hr_data", "insufficient_data_points", "insufficient_valid_data")
    return by.select(
        *KEYS, F.when(F.col("status") == "ok", F.try_divide(F.col("first") - F.col("second"), F.col("first")) * 100).alias("decoupling"), "status", F.when(scored, _quality(quality_control)).alias("quality_score"),
        F.when(~early, F.col("coverage")).alias("hr_coverage"), F.when(scored & (F.col("status") != "insufficient_data_after_quality_filter"), F.col("minutes")).alias("steady_duration_minutes"), F.when(~early, F.col("dt")).alias("sampling_interval_seconds"))


def _eligible(activities: DataFrame, types: Sequence[str] | None, start, end, min_minutes: float) -> DataFrame:
    df = with_athlete(frame(activities)).filter(F.col("date").between(F.lit(start), F.lit(end)) & (F.col("moving_time") >= min_minutes * 60) & (clean(F.col("average_heartrate")) > 0))
    return df.filter(F.col("type").isin(*(types or ())))


def ef_from_summaries(activities: DataFrame, ef_metric: str = "speed_hr", *, min_steady_minutes: float = 20, quality_control: str = "filter") -> dict[str, Column]:
    """The columns of a result row made from an activity's averages."""
    asked, control = output_metric("ef_metric", ef_metric), check_control(quality_control)
    time, heart, meters, gap = (clean(column_or_null(activities, c)) for c in ("moving_time", "average_heartrate", "distance", "average_gap"))
    speed = F.when((meters > 0) & (time > 0), F.try_divide(F.try_divide(meters, time), heart))
    power = normalized_power(activities)
    no_gap = F.lit(asked == "gap_hr") & ~F.coalesce(gap > 0, F.lit(False)) & speed.isNotNull()
    value = {"speed_hr": speed, "gap_hr": F.when(gap > 0, F.try_divide(gap, heart)).otherwise(speed), "power_hr": F.when(power > 0, F.try_divide(power, heart))}[asked]
    odd = (heart < 50) | (heart > 220)
    short = time < min_steady_minutes * 60
    poor = odd if control == "filter" else F.lit(False)
    good = F.coalesce(value > 0, F.lit(False))
    status = F.when(poor, "poor_hr_quality").when(short, "too_short").when(~good, "calculation_failed").when(no_gap, "gap_stream_unavailable_fallback_to_speed")
    status = status.when(odd & F.lit(control == "flag"), "poor_hr_quality_flagged").otherwise("no_streams")
    null = lambda kind: F.lit(None).cast(kind)
    return {
        "ef_value": F.when(~poor & ~short & good, value), "status": status, "ef_metric_requested": F.lit(asked), "ef_metric_used": F.when(~poor & ~short & no_gap, F.lit("speed_hr")).otherwise(F.lit(asked)),
        "quality_score": null("double"), "hr_coverage": null("double"), "steady_duration_minutes": null("double"), "n_steady_blocks": null("int"), "sampling_interval_seconds": null("double"),
    }


def calculate_ef(
    activities: DataFrame, activity_type: str | Sequence[str] | None = ("Run", "Ride"), ef_metric: str = "speed_hr", start_date: object = None, end_date: object = None, min_duration_mins: float = 20,
    min_steady_minutes: float = 20, steady_cv_threshold: float = 0.08, min_hr_coverage: float = 0.9, quality_control: str = "filter", streams: DataFrame | None = None,
    *, export_dir: str | None = None, ordered: bool = False, checked: bool = False,
) -> DataFrame:
    """athlete_id, activity_id, date, activity_type and the Efficiency Factor columns of each eligible activity.

    Activities with rows in `streams` (keyed by athlete_id and activity_id), or with a file in export_dir, use them; the others
    their averages.  Activities outside the dates and types, too short, or without heart rate are left out; without types, all are.
    Rows are unsorted, or by athlete, day and activity if `ordered`; `checked` makes an empty scope an error, at the cost of a small job.
    """
    not_negative(min_duration_mins=min_duration_mins, min_steady_minutes=min_steady_minutes)
    fractions(steady_cv_threshold=steady_cv_threshold, min_hr_coverage=min_hr_coverage)
    start, end = window(start_date, end_date)
    df = _eligible(activities, as_types(activity_type), start, end, min_duration_mins)
    if checked:
        checked_rows(df, f"activities of {activity_type} with a heart rate from {start} to {end}")
    summary = ef_from_summaries(df, ef_metric, min_steady_minutes=min_steady_minutes, quality_control=quality_control)
    last = (lambda x: x.orderBy(ATHLETE, "date", ACTIVITY)) if ordered else (lambda x: x)
    if streams is None and export_dir is not None:
        streams = streams_of(df, export_dir)
    df = df.select(ATHLETE, F.col("id").alias(ACTIVITY), "date", F.col("type").alias("activity_type"), F.struct(*[c.alias(n) for n, c in summary.items()]).alias("_summary"))
    if streams is None:
        return last(df.select(ATHLETE, ACTIVITY, "date", "activity_type", "_summary.*"))
    wanted = df.select(ATHLETE, ACTIVITY)
    found = ef_from_streams(normalized(streams).join(wanted, list(KEYS), "left_semi"), ef_metric, min_steady_minutes=min_steady_minutes, steady_cv_threshold=steady_cv_threshold, min_hr_coverage=min_hr_coverage, quality_control=quality_control)
    found = found.select(*KEYS, F.struct(*summary).alias("_stream"))
    best = F.coalesce("_stream", "_summary")
    return last(df.join(found, list(KEYS), "left").select(ATHLETE, ACTIVITY, "date", "activity_type", *[best[n].alias(n) for n in summary]))


def calculate_decoupling(
    activities: DataFrame | None = None, streams: DataFrame | None = None, activity_type: str | Sequence[str] | None = ("Run", "Ride"), decouple_metric: str = "speed_hr", start_date: object = None, end_date: object = None,
    min_duration_mins: float = 40, min_steady_minutes: float = 40, steady_cv_threshold: float = 0.08, min_hr_coverage: float = 0.9, quality_control: str = "filter",
    *, export_dir: str | None = None, stream_df: DataFrame | None = None, return_diagnostics: bool = False, ordered: bool = False, checked: bool = False,
) -> DataFrame:
    """athlete_id, activity_id, date and the decoupling columns of each eligible activity that has a stream, given or read from
    its file in export_dir.

    With stream_df, streams of activities that need no table, the result is decoupling alone (null where the stream does not
    serve), or with return_diagnostics its status and figures too; streams of several activities keep their keys.
    Rows are unsorted, or by athlete, day and activity if `ordered`; `checked` makes an empty scope an error, at the cost of a small job.
    """
    positive(min_duration_mins=min_duration_mins, min_steady_minutes=min_steady_minutes)
    fractions(steady_cv_threshold=steady_cv_threshold, min_hr_coverage=min_hr_coverage)
    if stream_df is not None:
        one = decoupling_from_streams(normalized(frame(stream_df, "stream_df")), decouple_metric, min_steady_minutes=min_steady_minutes, steady_cv_threshold=steady_cv_threshold, min_hr_coverage=min_hr_coverage, quality_control=quality_control)
        keys = [k for k in KEYS if k in stream_df.columns]
        return one.drop(*[k for k in KEYS if k not in keys]) if return_diagnostics else one.select(*keys, "decoupling")
    start, end = window(start_date, end_date)
    df = with_athlete(frame(activities)).filter(F.col("date").between(F.lit(start), F.lit(end)) & (F.col("moving_time") >= min_duration_mins * 60))
    df = df.filter(F.col("type").isin(*(as_types(activity_type) or ())))
    if checked:
        checked_rows(df, f"activities of {activity_type} of {min_duration_mins} minutes from {start} to {end}")
    if streams is None:
        streams = streams_of(df, export_dir)
    df = df.select(ATHLETE, F.col("id").alias(ACTIVITY), "date")
    found = decoupling_from_streams(normalized(streams).join(df.select(*KEYS), list(KEYS), "left_semi"), decouple_metric, min_steady_minutes=min_steady_minutes, steady_cv_threshold=steady_cv_threshold, min_hr_coverage=min_hr_coverage, quality_control=quality_control)
    out = df.join(found, list(KEYS))
    return out.orderBy(ATHLETE, "date", ACTIVITY) if ordered else out
