"""The registered queries: each operator over whole tables, doubles rounded to six places."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import charts
from ..functions import distance_label, haversine, period_text
from ..operators import acwr, cohort, coverage, efficiency, ewma, load, pbs, quality, spine, steady, trend
from ..schema import LOAD_METRICS
from ..sources.activities import load_local_activities
from ..sources.tracks import read_tracks
from ..storage import as_files, as_text
from .adapters import activities, streams

#: the analysis spans the tables' dates and types
START, END = "1995-01-01", "2001-08-01"
TYPES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
HEART = {"user_max_hr": 190, "user_resting_hr": 50}
DISTANCES = (400.0, 1000.0, 2000.0)
STEADY = {"min_steady_minutes": 4}
_REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _REGISTRY[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_REGISTRY)


def _series(spark, sf_dir, types=TYPES, **options):
    return acwr.calculate_acwr(activities(spark, sf_dir), types, start_date=START, end_date=END, **options)


def _with_sport(spark, sf_dir):
    """The ratio series with each athlete's sport."""
    acts = activities(spark, sf_dir)
    sports = acts.select("athlete_id", "sport").distinct()
    return acwr.calculate_acwr(acts, TYPES, start_date=START, end_date=END).join(sports, "athlete_id", "left")


def _days(spark, sf_dir):
    """Daily loads of the athletes."""
    loads = load.with_load(activities(spark, sf_dir))
    return spine.daily_spine(loads, types=TYPES, fetch_start=dt.date.fromisoformat(START), end=dt.date.fromisoformat(END)).select("athlete_id", "date", "daily_load")


@query
def load_metrics_all(spark, sf_dir):
    acts = activities(spark, sf_dir)
    return load.long_loads(acts, LOAD_METRICS, ("id",), user_ftp=250, **HEART)


@query
def load_thresholds(spark, sf_dir):
    """Statuses of missing thresholds and of an unknown metric."""
    acts = activities(spark, sf_dir)
    cases = {"tss": {}, "hrss": {"user_max_hr": 50, "user_resting_hr": 60}, "pulse": {}}
    out = [F.struct(F.lit(m).alias("metric"), load.load_columns(acts, m, **o)["load_status"].alias("load_status")) for m, o in cases.items()]
    return acts.select(F.explode(F.array(*out)).alias("x")).groupBy("x.metric", "x.load_status").agg(F.count("*").alias("n"))


@query
def load_status_histogram(spark, sf_dir):
    return load.status_histogram(load.with_load(activities(spark, sf_dir), "hrss", **HEART))


@query
def daily_load(spark, sf_dir):
    return load.daily_load(load.with_load(activities(spark, sf_dir), "tss", user_ftp=250))


@query
def acwr_duration(spark, sf_dir):
    return _series(spark, sf_dir)


@query
def acwr_missing_na(spark, sf_dir):
    """Of one type, so that days without load are many."""
    return _series(spark, sf_dir, TYPES[:1], load_metric="hrss", missing_load="na", **HEART)


@query
def acwr_ewma_ra(spark, sf_dir):
    return ewma.calculate_acwr_ewma(activities(spark, sf_dir), TYPES, start_date=START, end_date=END)


@query
def acwr_ewma(spark, sf_dir):
    return ewma.calculate_acwr_ewma(activities(spark, sf_dir), TYPES, load_metric="hrss", method="ewma", start_date=START, end_date=END, missing_load="na", **HEART)


@query
def bootstrap_resample_fixed_starts(spark, sf_dir):
    """Each athlete's daily loads of a year, put together from blocks of seven days at starts that the athlete's number fixes."""
    days = _days(spark, sf_dir)

    def put_together(part):
        loads = part.sort_values("date").daily_load.to_numpy()
        n = len(loads)
        starts = (np.arange(-(-n // 7)) * 37 + int(part.athlete_id.iloc[0])) % (n - 6)
        return pd.DataFrame({"athlete_id": part.athlete_id.iloc[0], "place": range(n), "daily_load": ewma.resample(loads, 7, starts)[0]})

    return days.groupBy("athlete_id").applyInPandas(put_together, "athlete_id long, place long, daily_load double")


@query
def bootstrap_bands_by_day(spark, sf_dir):
    """With blocks as long as the series there is one resampling, the series itself: both bands are the smoothed ratio."""
    days = _days(spark, sf_dir)
    bands = ewma.bootstrap_bands(days, ewma.smoothing_factor(3.5), ewma.smoothing_factor(14), 7, replicates=3, block_len=100_000, conf_level=0.9, seed=4)
    return bands.filter("date >= '2000-01-01'")


@query
def bootstrap_ci(spark, sf_dir):
    return ewma.calculate_acwr_ewma(activities(spark, sf_dir), TYPES, method="ewma", ci=True, start_date=START, end_date=END)


@query
def exposure(spark, sf_dir):
    return acwr.calculate_exposure(activities(spark, sf_dir), TYPES, end_date=END)


@query
def acwr_zones(spark, sf_dir):
    return _series(spark, sf_dir).groupBy(acwr.zone(F.col("acwr")).alias("zone")).agg(F.count("*").alias("n"))


@query
def history_warnings(spark, sf_dir):
    loads = load.with_load(activities(spark, sf_dir), "hrss", **HEART)
    return spine.history_warnings(loads, types=None, fetch_start=dt.date(1994, 12, 4), start=dt.date(1995, 1, 1), end=dt.date(1995, 6, 30), baseline_days=28)


@query
def rest_days(spark, sf_dir):
    days = spine.daily_spine(load.with_load(activities(spark, sf_dir)), types=TYPES, fetch_start=dt.date.fromisoformat(START), end=dt.date.fromisoformat(END))
    return days.groupBy("athlete_id").agg(F.count("*").alias("n_days"), F.count(F.when(~F.col("had_activity"), 1)).alias("n_rest"))


@query
def cohort_bands(spark, sf_dir):
    return cohort.calculate_cohort_reference(_with_sport(spark, sf_dir))


@query
def cohort_wide(spark, sf_dir):
    return cohort.wide_bands(cohort.calculate_cohort_reference(_with_sport(spark, sf_dir), by=None), check=False)


@query
def cohort_overlay(spark, sf_dir):
    series = _series(spark, sf_dir)
    return cohort.with_bands(series, cohort.calculate_cohort_reference(series, by=None))


@query
def duplicate_bands(spark, sf_dir):
    return cohort.duplicate_bands(cohort.calculate_cohort_reference(_with_sport(spark, sf_dir)))


def _ef(spark, sf_dir, metric, **options):
    return efficiency.calculate_ef(activities(spark, sf_dir), TYPES, metric, START, END, **options)


@query
def ef_summary_speed(spark, sf_dir):
    return _ef(spark, sf_dir, "speed_hr")


@query
def ef_summary_gap(spark, sf_dir):
    return _ef(spark, sf_dir, "gap_hr", quality_control="flag")


@query
def ef_summary_power(spark, sf_dir):
    return _ef(spark, sf_dir, "power_hr", min_duration_mins=10, quality_control="off")


@query
def ef_stream(spark, sf_dir):
    return efficiency.ef_from_streams(streams(spark, sf_dir), **STEADY)


@query
def ef_stream_power(spark, sf_dir):
    return efficiency.ef_from_streams(streams(spark, sf_dir), "power_hr", quality_control="off", **STEADY)


@query
def decoupling_stream(spark, sf_dir):
    return efficiency.decoupling_from_streams(streams(spark, sf_dir), quality_control="flag", **STEADY)


@query
def flag_quality(spark, sf_dir):
    flagged = quality.flag_quality(streams(spark, sf_dir), "Ride", min_steady_minutes=2, max_run_speed=7)
    return flagged.select("activity_id", "seq_no", *quality.FLAGS, "quality_score")


@query
def quality_summary(spark, sf_dir):
    return quality.summarize_quality(quality.flag_quality(streams(spark, sf_dir), min_steady_minutes=2))


@query
def hr_coverage(spark, sf_dir):
    return coverage.coverage(streams(spark, sf_dir))


@query
def sampling_interval(spark, sf_dir):
    return coverage.sampling_interval(streams(spark, sf_dir).withColumn("time_s", F.col("time_s") * (F.col("activity_id") % 4 + 1) / 2))


@query
def rolling_variation(spark, sf_dir):
    s = coverage.normalized(streams(spark, sf_dir)).withColumn("k", (F.col("activity_id") % 10 * 7 + 20).cast("long"))
    return steady.rolling_variation(s, "velocity_smooth", "k", ()).select("activity_id", "seq_no", "cv")


@query
def steady_blocks(spark, sf_dir):
    s = coverage.normalized(streams(spark, sf_dir)).withColumn("steady", F.col("velocity_smooth").between(3, 3.3))
    s = steady.with_blocks(s, "steady", ())
    return s.filter("steady").groupBy("activity_id", "block").agg(F.max("block_rows").alias("n"), F.max("block_minutes").alias("minutes")).filter("n >= 20").drop("block")


@query
def best_efforts(spark, sf_dir):
    return pbs.best_efforts(streams(spark, sf_dir), DISTANCES)


@query
def pb_progression(spark, sf_dir):
    """Records over one effort per activity of 10 km or more, at its mean speed."""
    acts = activities(spark, sf_dir).filter("distance >= 10000 and moving_time > 0")
    efforts = acts.select("athlete_id", F.col("id").alias("activity_id"), F.col("date").alias("activity_date"), F.lit(10000.0).alias("distance"), (F.col("moving_time") * F.lit(10000.0) / F.col("distance")).alias("time_seconds"))
    return pbs.progression(efforts).drop("elapsed_time", "moving_time", "time_period")


@query
def labels_and_periods(spark, sf_dir):
    rows = spark.sql("select explode(array(1000D, 5000D, 10000D, 21097.5D, 42195D, 3000D, 400D)) as distance")
    return rows.select("distance", distance_label(F.col("distance")).alias("label"), period_text(F.col("distance") / 4).alias("period"))


@query
def haversine_track(spark, sf_dir):
    s = streams(spark, sf_dir).select("activity_id", "seq_no", (F.col("seq_no") * 0.0001 + 1.3).alias("lat"), (F.col("seq_no") % 50 * 0.0002 + 103.8).alias("lon"))
    w = Window.partitionBy("activity_id").orderBy("seq_no")
    leg = haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return s.withColumn("leg", leg).groupBy("activity_id").agg(F.sum("leg").alias("meters"), F.max("leg").alias("longest"))


@query
def ef_stream_from_distance(spark, sf_dir):
    """Streams without speed: it comes from the distance."""
    return efficiency.ef_from_streams(streams(spark, sf_dir).drop("velocity_smooth"), **STEADY)


def _stream_activities(spark, sf_dir):
    """The activities that the streams belong to, a third of the athletes' on wheels."""
    by = streams(spark, sf_dir).groupBy("athlete_id", "activity_id").agg(F.max("time_s").alias("t"), F.max("distance").alias("distance"))
    kind = F.when(F.col("activity_id") % 5 == 1, "Ride").otherwise("Run")
    return by.select("athlete_id", F.col("activity_id").alias("id"), F.date_add(F.lit("2000-01-01").cast("date"), (F.col("activity_id") * 7 % 400).cast("int")).alias("date"), kind.alias("type"), F.col("t").cast("int").alias("moving_time"), "distance")


@query
def decoupling_of_activities(spark, sf_dir):
    return efficiency.calculate_decoupling(_stream_activities(spark, sf_dir), streams(spark, sf_dir), "Run", start_date="2000-01-01", end_date="2000-12-31", min_duration_mins=16.5, quality_control="flag", **STEADY)


@query
def pbs_of_activities(spark, sf_dir):
    return pbs.calculate_pbs(_stream_activities(spark, sf_dir), streams(spark, sf_dir), "Run", "2000-01-01", "2000-12-31", DISTANCES).drop("time_period", "elapsed_time", "moving_time")


@query
def export_load(spark, sf_dir):
    """The activities through a bulk export: written as CSV in three forms of date, loaded, cleaned and filtered."""
    acts = activities(spark, sf_dir)
    start = F.expr("cast(date as timestamp) + make_dt_interval(0, 0, 0, id * 61 % 86400)")
    forms = ("MMM d, yyyy, h:mm:ss a", "M/d/yyyy h:mm:ss a", "yyyy-MM-dd HH:mm:ss")
    told = F.when(F.col("id") % 101 == 0, "some day")
    for i, form in enumerate(forms):
        told = told.when(F.col("id") % 3 == i, F.date_format(start, form))
    table = acts.select(
        F.col("id").alias("Activity ID"), told.alias("Activity Date"), F.concat(F.lit('a "long", way '), "id").alias("Activity Name"), F.col("type").alias("Activity Type"), (F.col("elapsed_time") + 0.9).alias("Elapsed Time"),
        F.col("moving_time").alias("Moving Time"), F.when(F.col("id") % 103 == 0, "far").otherwise(F.col("distance").cast("string")).alias("Distance"), F.col("average_heartrate").alias("Average Heart Rate"), F.lit("").alias("Filename"))
    loaded = load_local_activities(spark, as_text(table, "export"), START, END, TYPES)
    return loaded.select("id", "name", "type", "sport_type", "date", F.date_format("start_date_local", "HH:mm:ss").alias("clock"), "distance", "moving_time", "elapsed_time", "average_heartrate", "max_watts")


_DOCUMENTS = {
    "gpx": ("<gpx><trk><trkseg>", "</trkseg></trk></gpx>", """format_string('<trkpt lat="%s" lon="%s"><time>%s</time><extensions><hr>%s</hr></extensions></trkpt>', lat, lon, at, hr)"""),
    "tcx": ("<TrainingCenterDatabase><Activities><Activity><Lap><Track>", "</Track></Lap></Activity></Activities></TrainingCenterDatabase>",
            "format_string('<Trackpoint><Time>%s</Time><DistanceMeters>%s</DistanceMeters><HeartRateBpm><Value>%s</Value></HeartRateBpm><Extensions><TPX><Watts>%s</Watts></TPX></Extensions></Trackpoint>', at, distance, hr, watts)"),
}


@query
def export_tracks(spark, sf_dir):
    """The streams through sensor files: even activities written as GPX, odd ones as gzipped TCX, parsed and summed up by file."""
    s = streams(spark, sf_dir).selectExpr(
        "activity_id as key", "seq_no as place", "seq_no * 0.0001 + 1.3 as lat", "seq_no % 50 * 0.0002 + 103.8 as lon", "distance", "watts", "coalesce(cast(heartrate as string), '') as hr",
        "format_string('%sT%02d:%02d:%02dZ', cast(date_add(date'2020-01-01', cast(seq_no div 86400 as int)) as string), seq_no % 86400 div 3600, seq_no % 3600 div 60, seq_no % 60) as at")
    parsed = []
    for i, (form, (head, foot, point)) in enumerate(_DOCUMENTS.items()):
        points = s.filter(F.col("key") % 2 == i)
        ends = points.groupBy("key").agg(F.max("place").alias("last")).selectExpr("key", f"inline(array(struct(-1L as place, '{head}' as line), struct(last + 1 as place, '{foot}' as line)))")
        path = as_files(points.selectExpr("key", "place", f"{point} as line").unionByName(ends), "tracks", form, "gzip" if form == "tcx" else "none")
        parsed.append(read_tracks(spark, path))
    rows = parsed[0].unionByName(parsed[1]).withColumn("activity_id", F.regexp_extract("file", r"key=(\d+)", 1).cast("long"))
    return rows.groupBy("activity_id", "format", "parse_status").agg(
        F.count("*").alias("n"), F.count("heartrate").alias("n_heart"), F.sum("heartrate").alias("heart"), F.sum("watts").alias("watts"), F.max("distance").alias("distance"), F.max("speed").alias("speed"), (F.max("time_s") - F.min("time_s")).alias("seconds"))


@query
def chart_acwr_line(spark, sf_dir):
    return charts.plot_acwr(_series(spark, sf_dir)).layers["series"]


@query
def chart_exposure_latest(spark, sf_dir):
    return charts.plot_exposure(acwr.calculate_exposure(activities(spark, sf_dir), TYPES, end_date=END)).layers["latest"]


@query
def chart_ef_trend(spark, sf_dir):
    return charts.plot_ef(_ef(spark, sf_dir, "speed_hr"), smoothing_method="lm", smooth_per_activity_type=True).layers["trend"]


@query
def chart_cohort_bands(spark, sf_dir):
    series = _series(spark, sf_dir)
    return charts.plot_with_reference(series, cohort.calculate_cohort_reference(series, by=None)).layers["bands"]


@query
def monthly_ef(spark, sf_dir):
    ef = _ef(spark, sf_dir, "speed_hr").filter("ef_value is not null")
    return ef.groupBy(F.to_date(F.date_trunc("month", "date")).alias("month"), "activity_type").agg(F.avg("ef_value").alias("mean_ef"), F.count("*").alias("n"))


@query
def type_counts(spark, sf_dir):
    return activities(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"), F.min("date").alias("first_day"), F.max("date").alias("last_day"))


@query
def activity_date_type_filter(spark, sf_dir):
    return spine.in_scope(activities(spark, sf_dir), TYPES[:2], dt.date(2000, 12, 31)).filter("date >= '2000-01-01'").select("id", "type", "date", "distance")


@query
def topk_longest(spark, sf_dir):
    return activities(spark, sf_dir).filter("distance is not null").select("id", "athlete_id", "distance").orderBy(F.desc("distance"), "id").limit(25)


@query
def union_methods(spark, sf_dir):
    acts = activities(spark, sf_dir)
    both = [ewma.calculate_acwr_ewma(acts, TYPES, method=m, start_date=START, end_date=END) for m in ("ra", "ewma")]
    return charts.compare_methods(*both).groupBy("method").agg(F.count("*").alias("n"), F.count("acwr").alias("n_known"), F.avg("acwr").alias("mean_acwr"))


@query
def lm_trend(spark, sf_dir):
    ef = _ef(spark, sf_dir, "speed_hr").withColumn("day", F.datediff("date", F.lit(START).cast("date")))
    return trend.linear_trend(ef, "day", "ef_value", ["activity_type"])


@query
def loess_trend(spark, sf_dir):
    ef = _ef(spark, sf_dir, "speed_hr").withColumn("day", F.datediff("date", F.lit(START).cast("date")))
    return trend.loess_trend(ef, "day", "ef_value", ["athlete_id", "activity_type"], points=20)
