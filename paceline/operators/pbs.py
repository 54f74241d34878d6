"""Personal bests: the fastest stretch of a fixed distance of each activity, and records over time.

Distance is made strictly increasing and time a moving time: pauses on a plateau do not
count, time lost to a bounce below the distance already reached does.  The time at a
distance is interpolated between the samples next to it, found by a frame over distance
that ends `target` meters before or after a sample; no join of samples is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import distance_label, period_text
from ..params import frame, types as as_types, window
from ..schema import ACTIVITY, ATHLETE, PB_DISTANCES
from .coverage import KEYS, in_time, checked_rows, normalized, of_activity, streams_of
from .spine import with_athlete

MIN_SAMPLES = 10


def moving_axis(streams: DataFrame) -> DataFrame:
    """athlete_id, activity_id, d, t: each sample that reaches a new distance, and the moving time up to it.

    Activities with fewer than MIN_SAMPLES samples, or so reached, have no rows.  Of samples at the same time the first counts.
    """
    s = normalized(streams).select(*KEYS, "seq_no", F.col("time_s").cast("double").alias("time_s"), F.col("distance").cast("double").alias("d"))
    s = s.filter(F.col("time_s").isNotNull() & F.col("d").isNotNull()).repartition(*KEYS)
    s = s.withColumn("samples", F.count("*").over(of_activity())).withColumn("_same", F.row_number().over(Window.partitionBy(*KEYS, "time_s").orderBy("seq_no")))
    s = s.filter((F.col("samples") >= MIN_SAMPLES) & (F.col("_same") == 1))
    line = in_time()
    s = s.withColumn("_top", F.max("d").over(line.rowsBetween(Window.unboundedPreceding, -1)))
    s = s.withColumn("_new", F.col("_top").isNull() | (F.col("d") > F.col("_top")))
    s = s.withColumn("_seg", F.sum(F.col("_new").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("_reached", F.greatest("d", "_top"))
    s = s.withColumn("_bounce", F.min(F.when(F.col("d") < F.col("_reached"), F.col("time_s"))).over(of_activity("_seg")))
    level = (F.col("d") == F.col("_reached")) & (F.col("_bounce").isNull() | (F.col("time_s") < F.col("_bounce")))
    by = s.groupBy(*KEYS, "_seg").agg(F.max("d").alias("d"), F.min("time_s").alias("begin"), F.max(F.when(level, F.col("time_s"))).alias("counted"))
    order = of_activity().orderBy("_seg")
    by = by.withColumn("_gain", F.coalesce(F.col("begin") - F.lag("counted").over(order), F.lit(0.0)))
    by = by.withColumn("t", F.sum("_gain").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("knots", F.count("*").over(of_activity()))
    return by.filter(F.col("knots") >= MIN_SAMPLES).select(*KEYS, "d", "t")


def _time_at(knot: Column, x: Column) -> Column:
    """Moving time at distance x from the last sample not beyond it: (d, t) and those of the next."""
    part = F.try_divide((knot["t_next"] - knot["t"]) * (x - knot["d"]), knot["d_next"] - knot["d"])
    return knot["t"] + F.when(knot["d_next"].isNull() | (x <= knot["d"]), F.lit(0.0)).otherwise(part)


def best_efforts(streams: DataFrame, distances: Sequence[float] = PB_DISTANCES) -> DataFrame:
    """athlete_id, activity_id, distance, time_seconds, start_distance, end_distance: the least positive moving time over each
    distance, of stretches that begin or end at a sample; of equal ones the first.  Activities that are too short have no row."""
    targets = [float(x) for x in dict.fromkeys(distances)]
    k = moving_axis(streams)
    order = of_activity().orderBy("d")
    k = k.withColumns({"d_next": F.lead("d").over(order), "t_next": F.lead("t").over(order), "d_first": F.min("d").over(of_activity()), "d_last": F.max("d").over(of_activity())})
    knot = "struct(d, t, d_next, t_next)"
    over = "over (partition by athlete_id, activity_id order by d range between unbounded preceding and"
    for i, x in enumerate(targets):
        k = k.withColumns({f"ahead{i}": F.expr(f"last({knot}) {over} {x!r}D following)"), f"behind{i}": F.expr(f"last({knot}) {over} {x!r}D preceding)")})
    found = []
    for i, x in enumerate(targets):
        long = F.col("d_last") - F.col("d_first") >= x
        ahead = F.when(long & (F.col("d") + x <= F.col("d_last")), F.struct((_time_at(F.col(f"ahead{i}"), F.col("d") + x) - F.col("t")).alias("time_seconds"), F.col("d").alias("start")))
        back = F.col("d") - x
        behind = F.when(long & (back >= F.col("d_first")), F.struct((F.col("t") - _time_at(F.col(f"behind{i}"), back)).alias("time_seconds"), back.alias("start")))
        found.append(F.struct(F.lit(x).alias("distance"), F.array(ahead, behind).alias("efforts")))
    rows = k.select(*KEYS, F.explode(F.array(*found)).alias("x")).select(*KEYS, "x.distance", F.explode("x.efforts").alias("e"))
    best = rows.filter("e.time_seconds > 0").groupBy(*KEYS, "distance").agg(F.min("e").alias("e"))
    return best.select(*KEYS, "distance", F.col("e.time_seconds").alias("time_seconds"), F.col("e.start").alias("start_distance"), (F.col("e.start") + F.col("distance")).alias("end_distance"))


def progression(efforts: DataFrame) -> DataFrame:
    """efforts (athlete_id, activity_id, activity_date, distance, time_seconds) with records and labels; an equal time is a record too."""
    so_far = Window.partitionBy(ATHLETE, "distance").orderBy("activity_date", ACTIVITY).rowsBetween(Window.unboundedPreceding, 0)
    out = efforts.withColumn("cumulative_pb_seconds", F.min("time_seconds").over(so_far))
    return out.select(
        ATHLETE, ACTIVITY, "activity_date", "distance", F.col("time_seconds").alias("elapsed_time"), F.col("time_seconds").alias("moving_time"), "time_seconds", "cumulative_pb_seconds",
        (F.col("time_seconds") == F.col("cumulative_pb_seconds")).alias("is_pb"), distance_label(F.col("distance")).alias("distance_label"), period_text(F.col("time_seconds")).alias("time_period"), F.lit("moving").alias("time_basis"))


def calculate_pbs(
    activities: DataFrame, streams: DataFrame | None = None, activity_type: str | Sequence[str] | None = "Run", start_date: object = None, end_date: object = None, distances_m: Sequence[float] = PB_DISTANCES,
    *, export_dir: str | None = None, ordered: bool = False, checked: bool = False,
) -> DataFrame:
    """Best efforts and records of the activities of a type (null: all) that are long enough and have a stream.

    Streams are given, or read from the activities' files in export_dir.  Activities without a column id are numbered by athlete,
    in the order of their columns.  Rows are unsorted, or by athlete, day, activity and distance if `ordered`;
    `checked` makes an empty scope an error.
    """
    start, end = window(start_date, end_date, check=False)
    df = with_athlete(frame(activities)).filter(F.col("date").between(F.lit(start), F.lit(end)) & (F.col("distance") >= float(min(distances_m))))
    kinds = as_types(activity_type)
    df = df if kinds is None else df.filter(F.col("type").isin(*kinds))
    if "filename" in df.columns:
        df = df.filter(F.col("filename") != "")
    if "id" not in df.columns:
        df = df.withColumn("id", F.row_number().over(Window.partitionBy(ATHLETE).orderBy("date", *[c for c in sorted(df.columns) if c not in (ATHLETE, "date")])).cast("long"))
    if checked:
        checked_rows(df, f"activities of {activity_type} of {min(distances_m)} meters from {start} to {end}")
    if streams is None:
        streams = streams_of(df, export_dir)
    when = F.col("start_date_local") if "start_date_local" in df.columns else F.col("date")
    df = df.select(ATHLETE, F.col("id").alias(ACTIVITY), when.alias("activity_date"))
    wanted = normalized(streams).join(df.select(*KEYS), list(KEYS), "left_semi")
    out = progression(best_efforts(wanted, distances_m).join(df, list(KEYS)))
    return out.orderBy(ATHLETE, "activity_date", ACTIVITY, "distance") if ordered else out
