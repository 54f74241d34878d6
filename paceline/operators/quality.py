"""Quality flags of stream samples and their summary."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import column_or_null, round_even
from ..params import frame, positive, renamed
from .coverage import KEYS, in_time, normalized, of_activity
from .steady import rolling_variation, window_rows

FLAGS = ("flag_hr_spike", "flag_pw_spike", "flag_gps_drift", "flag_any", "is_steady_state")


def flag_quality(
    streams: DataFrame, sport: str | Column = "Run", hr_range: tuple[float, float] = (30, 220), pw_range: tuple[float, float] = (0, 1500), max_run_speed: float = 7, max_ride_speed: float = 25,
    max_accel: float = 3, max_hr_jump: float = 10, max_pw_jump: float = 300, min_steady_minutes: float = 20, steady_cv_threshold: float = 0.08,
) -> DataFrame:
    """streams with flag_hr_spike, flag_pw_spike, flag_gps_drift, flag_any, is_steady_state and the activity's quality_score.

    Changes count per second, from sample to sample in the order of the file (seq_no); where time does not go on there is none.
    Steady: the variation of power (or of speed, where an activity has no power) over a centred window of min_steady_minutes,
    nulls skipped, is below the threshold and the sample has no flag.  A threshold of 1 or more is taken as percent.
    `sport` is a text or a column; any but ride has the run's speed limit.
    """
    positive(min_steady_minutes=min_steady_minutes, steady_cv_threshold=steady_cv_threshold)
    if steady_cv_threshold >= 1:
        warnings.warn(f"steady_cv_threshold {steady_cv_threshold} is read as percent", stacklevel=2)
        steady_cv_threshold /= 100
    s = normalized(frame(streams, "streams"))
    given = s.columns
    speed_name = "velocity_smooth" if "velocity_smooth" in given else "speed"
    file_order = of_activity().orderBy("seq_no", "time_s")
    s = s.withColumns({"_hr": column_or_null(s, "heartrate"), "_pw": column_or_null(s, "watts"), "_speed": column_or_null(s, speed_name), "_time": column_or_null(s, "time_s")})
    s = s.withColumn("_step", F.col("_time") - F.lag("_time").over(file_order))
    gap = F.when(F.col("_step") > 0, F.col("_step"))
    rate = lambda c: F.abs(F.try_divide(F.col(c) - F.lag(c).over(file_order), gap))
    yes = lambda test: F.coalesce(test, F.lit(False))
    limit = F.when(F.lower(sport if isinstance(sport, Column) else F.lit(sport)) == "ride", F.lit(float(max_ride_speed))).otherwise(F.lit(float(max_run_speed)))
    s = s.withColumns({
        "flag_hr_spike": yes((F.col("_hr") < hr_range[0]) | (F.col("_hr") > hr_range[1])) | yes(rate("_hr") > max_hr_jump),
        "flag_pw_spike": yes((F.col("_pw") < pw_range[0]) | (F.col("_pw") > pw_range[1])) | yes(rate("_pw") > max_pw_jump),
        "flag_gps_drift": yes(F.col("_speed") > limit) | yes(rate("_speed") > max_accel),
    })
    s = s.withColumn("flag_any", F.col("flag_hr_spike") | F.col("flag_pw_spike") | F.col("flag_gps_drift"))
    whole = of_activity()
    s = s.withColumn("quality_score", 1 - F.avg(F.col("flag_any").cast("double")).over(whole))
    line = in_time()
    s = s.withColumn("_gap", F.col("_time") - F.lag("_time").over(line)).withColumn("_gap", F.when(F.col("_gap") > 0, F.col("_gap")))
    s = s.withColumns({"_dt": F.coalesce(F.median("_gap").over(whole), F.lit(1.0)), "_rows": F.count("*").over(whole), "_powered": F.count("_pw").over(whole) > 0})
    s = s.withColumn("_metric", F.when(F.col("_powered"), F.col("_pw")).otherwise(F.col("_speed")))
    s = s.withColumn("_k", window_rows(min_steady_minutes * 60, F.col("_dt"), F.greatest(F.lit(1), F.ceil(F.lit(60.0) / F.col("_dt"))), F.col("_rows")))
    s = rolling_variation(s, "_metric", "_k", (), skip_nulls=True, out="_cv")
    s = s.withColumn("is_steady_state", yes(F.col("_cv") < steady_cv_threshold) & ~F.col("flag_any"))
    return s.select(*given, *FLAGS, "quality_score")


def summarize_quality(flagged: DataFrame) -> DataFrame:
    """One row per activity: points, flagged and steady points, and percentages, rounded half to even."""
    missing = {"flag_any", "is_steady_state", "quality_score"} - set(flagged.columns)
    if missing:
        raise ValueError(f"not from flag_quality(): no {', '.join(sorted(missing))}")
    count = lambda c: F.count(F.when(F.col(c), 1)) if c in flagged.columns else F.lit(0)
    share = lambda c: round_even(100 * F.try_divide(count(c).cast("double"), F.count("*").cast("double")), 2)
    return flagged.groupBy(*[k for k in KEYS if k in flagged.columns]).agg(
        F.count("*").alias("total_points"), count("flag_any").alias("flagged_points"), share("flag_any").alias("flagged_pct"), count("is_steady_state").alias("steady_state_points"),
        share("is_steady_state").alias("steady_state_pct"), round_even(F.avg("quality_score"), 3).alias("quality_score"), share("flag_hr_spike").alias("hr_spike_pct"),
        share("flag_pw_spike").alias("pw_spike_pct"), share("flag_gps_drift").alias("gps_drift_pct"))


def quality_summary(flagged: DataFrame) -> DataFrame:
    renamed("quality_summary", "summarize_quality")
    return summarize_quality(flagged)
