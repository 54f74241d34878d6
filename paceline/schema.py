"""Tables, columns and status words of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

#: one row per activity, in this order
ACTIVITY_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("sport_type", T.StringType()),
    T.StructField("start_date_local", T.TimestampType()),
    T.StructField("date", T.DateType()),
    T.StructField("distance", T.DoubleType()),
    T.StructField("moving_time", T.IntegerType()),
    T.StructField("elapsed_time", T.IntegerType()),
    T.StructField("average_heartrate", T.DoubleType()),
    T.StructField("max_heartrate", T.DoubleType()),
    T.StructField("average_watts", T.DoubleType()),
    T.StructField("max_watts", T.DoubleType()),
    T.StructField("weighted_average_watts", T.DoubleType()),
    T.StructField("elevation_gain", T.DoubleType()),
    T.StructField("elevation_loss", T.DoubleType()),
    T.StructField("average_speed", T.DoubleType()),
    T.StructField("max_speed", T.DoubleType()),
    T.StructField("average_gap", T.DoubleType()),
    T.StructField("calories", T.DoubleType()),
    T.StructField("relative_effort", T.DoubleType()),
    T.StructField("filename", T.StringType()),
])

#: one row per sensor sample; seq_no is the order in the file, time_s seconds since the epoch (or since the start)
STREAM_SCHEMA = T.StructType([
    T.StructField("seq_no", T.LongType()),
    T.StructField("time_s", T.DoubleType()),
    T.StructField("latitude", T.DoubleType()),
    T.StructField("longitude", T.DoubleType()),
    T.StructField("elevation", T.DoubleType()),
    T.StructField("heartrate", T.DoubleType()),
    T.StructField("watts", T.DoubleType()),
    T.StructField("cadence", T.DoubleType()),
    T.StructField("speed", T.DoubleType()),
    T.StructField("distance", T.DoubleType()),
])

ATHLETE, ACTIVITY = "athlete_id", "activity_id"

#: fixed values: metrics and statuses, part of the results' contract
LOAD_METRICS = ("duration_mins", "distance_km", "elapsed_time_mins", "elevation_gain_m", "tss", "hrss")
LOAD_STATUSES = (
    "ok", "missing_duration", "missing_heart_rate", "missing_threshold_hr", "hr_out_of_range", "missing_power",
    "missing_ftp", "missing_distance", "missing_elapsed_time", "missing_elevation_gain", "unsupported_metric",
)
EF_METRICS = ("speed_hr", "gap_hr", "power_hr")
EF_STATUSES = (
    "ok", "no_streams", "gap_stream_unavailable_fallback_to_speed", "missing_velocity_data", "missing_power_data",
    "missing_hr_data", "insufficient_hr_data", "insufficient_data_points", "insufficient_valid_data",
    "insufficient_data_after_quality_filter", "poor_hr_quality", "poor_hr_quality_flagged", "too_short", "non_steady",
    "insufficient_steady_duration", "calculation_failed",
)
DECOUPLING_STATUSES = (
    "ok", "missing_hr_data", "missing_time_data", "missing_velocity_data", "missing_power_data", "insufficient_hr_data",
    "insufficient_data_points", "insufficient_valid_data", "insufficient_data_after_quality_filter",
    "insufficient_steady_duration", "non_steady", "calculation_failed", "calculation_error",
)
ACWR_ZONES = (("low", None, 0.8), ("reference", 0.8, 1.3), ("elevated", 1.3, 1.5), ("high", 1.5, None))
PB_DISTANCES = (1000.0, 5000.0, 10000.0, 21097.5, 42195.0)
