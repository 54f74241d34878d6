import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline import params
from paceline.operators import acwr, ewma, load, spine

DAY = dt.date(2024, 1, 1)
KIND = "id long, athlete_id string, type string, date date, distance double, moving_time int, elapsed_time int, average_heartrate double, average_watts double, weighted_average_watts double, elevation_gain double"


def acts(spark, rows):
    """rows: (athlete, day number, minutes, more)."""
    out = []
    for i, (who, day, minutes, *more) in enumerate(rows):
        x = {"distance": 10000.0, "average_heartrate": 150.0, "type": "Run"} | (more[0] if more else {})
        out.append((i, who, x["type"], DAY + dt.timedelta(days=day), x["distance"], None if minutes is None else int(minutes * 60), 3600, x["average_heartrate"], x.get("average_watts"), x.get("weighted_average_watts"), x.get("elevation_gain")))
    return spark.createDataFrame(out, KIND)


def by_day(df):
    return {r.date: r for r in df.collect()}


def test_constant_load_is_in_balance(spark):
    df = acts(spark, [("a", d, 60) for d in range(121)])
    got = by_day(acwr.calculate_acwr(df, "Run", start_date="2024-04-01", end_date="2024-04-30"))
    assert len(got) == 30
    assert all((r.atl, r.ctl, r.acwr) == (60, 60, 1) for r in got.values())
    assert got[dt.date(2024, 4, 6)].acwr_smooth is None and got[dt.date(2024, 4, 7)].acwr_smooth == 1
    early = by_day(ewma.calculate_acwr_ewma(df, "Run", start_date="2024-04-01", end_date="2024-04-30"))
    assert early[dt.date(2024, 4, 6)].acwr_smooth == 1  # smoothed before the cut


def test_a_step_in_load_raises_the_ratio(spark):
    df = acts(spark, [("a", d, 30 if d < 28 else 90) for d in range(35)])
    last = by_day(acwr.calculate_acwr(df, "Run", start_date="2024-01-28", end_date="2024-02-04"))[dt.date(2024, 2, 4)]
    assert last.atl > 80 and last.acwr > 1.5


def test_series_begins_with_the_first_known_activity(spark):
    df = acts(spark, [("late", 100, 30), ("late", 110, 30), ("old", 0, 30), ("old", 112, 30), ("gone", 0, 30)])
    got = acwr.calculate_acwr(df, "Run", start_date="2024-04-10", end_date="2024-04-25").collect()
    late = {r.date: r for r in got if r.athlete_id == "late"}
    old = {r.date: r for r in got if r.athlete_id == "old"}
    assert min(late) == DAY + dt.timedelta(days=100) and min(old) == dt.date(2024, 4, 10)
    assert late[DAY + dt.timedelta(days=106)].atl is not None and all(r.ctl is None for r in late.values())
    assert old[dt.date(2024, 4, 10)].ctl == 0 and old[dt.date(2024, 4, 10)].acwr is None  # rest was observed
    assert not [r for r in got if r.athlete_id == "gone"]


def test_unknown_loads_count_zero_or_stay_unknown(spark):
    df = acts(spark, [("a", d, 60, {"average_heartrate": None if d == 30 else 150.0}) for d in range(60)])
    args = dict(load_metric="hrss", start_date="2024-01-20", end_date="2024-02-29", user_max_hr=190, user_resting_hr=50)
    zero, na = (by_day(acwr.calculate_acwr(df, "Run", missing_load=m, **args)) for m in ("zero", "na"))
    d = dt.date(2024, 2, 2)
    assert na[d].atl is None and zero[d].atl == pytest.approx(6 * 60 / 1.4 / 7)
    assert na[dt.date(2024, 2, 8)].atl == pytest.approx(60 / 1.4)
    e = by_day(ewma.calculate_acwr_ewma(df, "Run", method="ewma", missing_load="na", **args))
    assert e[dt.date(2024, 1, 31)].atl is None and e[dt.date(2024, 2, 1)].atl == pytest.approx(60 / 1.4)


def test_exposure_covers_one_chronic_period(spark):
    df = acts(spark, [("a", d, 60) for d in range(121)])
    got = acwr.calculate_exposure(df, "Run", end_date="2024-04-30").collect()
    assert len(got) == 42 and {(r.daily_load, r.atl, r.ctl, r.acwr) for r in got} == {(60, 60, 60, 1)}
    few = acwr.calculate_exposure(acts(spark, [("a", 116 + d, 60) for d in range(5)]), None, end_date="2024-04-30").collect()
    assert few and all(r.ctl is None for r in few)


CASES = [
    ("tss", {"moving_time": 3600, "weighted_average_watts": 250.0}, 100.0, "ok"),
    ("tss", {"moving_time": 3600, "weighted_average_watts": 0.0, "average_watts": 250.0}, 100.0, "ok"),
    ("tss", {"moving_time": 3600}, None, "missing_power"),
    ("hrss", {"moving_time": 3600, "average_heartrate": 120.0}, 60 * 70 / 140, "ok"),
    ("hrss", {"moving_time": 3600, "average_heartrate": 50.0}, None, "hr_out_of_range"),
    ("hrss", {"moving_time": 3600, "average_heartrate": 191.0}, None, "hr_out_of_range"),
    ("hrss", {"moving_time": 3600, "average_heartrate": 0.0}, None, "missing_heart_rate"),
    ("hrss", {"moving_time": 0, "average_heartrate": 120.0}, None, "missing_duration"),
    ("duration_mins", {"moving_time": 90}, 1.5, "ok"),
    ("duration_mins", {}, None, "missing_duration"),
    ("distance_km", {"distance": -5.0}, -0.005, "ok"),
    ("distance_km", {"distance": float("nan")}, None, "missing_distance"),
    ("distance_km", {"distance": float("inf")}, None, "missing_distance"),
    ("elapsed_time_mins", {"elapsed_time": 0}, None, "missing_elapsed_time"),
    ("elevation_gain_m", {"elevation_gain": 12.0}, 12.0, "ok"),
    ("elevation_gain_m", {}, None, "missing_elevation_gain"),
]


@pytest.mark.parametrize("metric, values, want, status", CASES)
def test_loads_and_statuses(spark, metric, values, want, status):
    kinds = {"moving_time": "int", "elapsed_time": "int"}
    names = ["moving_time", "elapsed_time", "distance", "average_heartrate", "average_watts", "weighted_average_watts", "elevation_gain"]
    df = spark.createDataFrame([tuple(values.get(n) for n in names)], ", ".join(f"{n} {kinds.get(n, 'double')}" for n in names))
    r = load.with_load(df, metric, user_ftp=250, user_max_hr=190, user_resting_hr=50).first()
    assert r.load_status == status and (r.load is None if want is None else r.load == pytest.approx(want))


def test_absent_columns_are_missing(spark):
    df = spark.createDataFrame([(1,)], "id int")
    assert [load.with_load(df, m, user_ftp=1, user_max_hr=2, user_resting_hr=1).first().load_status for m in ("duration_mins", "distance_km", "elevation_gain_m", "tss")] == ["missing_duration", "missing_distance", "missing_elevation_gain", "missing_duration"]


def fold(loads, alpha):
    out, last = [], None
    for x in loads:
        if x is None:
            out.append(None)
            continue
        last = x if last is None else alpha * x + (1 - alpha) * last
        out.append(last)
    return out


@pytest.mark.parametrize("half_lives", [(4, 14), (0.5, 3.5), (0.05, 200)])
def test_exponential_weights_equal_the_recursion(spark, half_lives):
    rng = random.Random(1)
    loads = {"a": [100.0, 0.0, 0.0, 0.0, 0.0], "b": [None, None, 5.0, None, 7.0, 0.0], "c": [rng.choice([None, 0.0, rng.uniform(1, 300)]) for _ in range(900)], "d": [None]}
    rows = [(k, DAY + dt.timedelta(days=i), x) for k, xs in loads.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "athlete_id string, date date, daily_load double")
    alphas = [ewma.smoothing_factor(h) for h in half_lives]
    got = ewma.ewma_series(df, *alphas).orderBy("date").collect()
    for k, xs in loads.items():
        mine = [r for r in got if r.athlete_id == k]
        for name, alpha in zip(("atl", "ctl"), alphas):
            for g, w in zip([r[name] for r in mine], fold(xs, alpha)):
                assert g is None if w is None else g == pytest.approx(w, rel=1e-9, abs=1e-12)
    if half_lives[0] == 4:
        assert [r.atl for r in got if r.athlete_id == "a"][4] == pytest.approx(50)


def test_moving_blocks():
    assert ewma.resample(np.arange(1.0, 11), 4, np.array([1, 4, 6])).tolist() == [[2, 3, 4, 5, 5, 6, 7, 8, 7, 8]]
    with pytest.raises(ValueError):
        ewma.resample(np.arange(10.0), 4, np.array([1, 7, 2]))
    starts = ewma.block_starts(1, "a", 30, 7, 50)
    assert (starts == ewma.block_starts(1, "a", 30, 7, 50)).all() and starts.max() <= 23


def test_bootstrap_bands(spark):
    rng = random.Random(5)
    df = acts(spark, [(who, d, rng.randrange(10, 120)) for who in "ab" for d in range(100)])
    args = dict(method="ewma", ci=True, B=40, start_date="2024-03-01", end_date="2024-04-05")
    got = ewma.calculate_acwr_ewma(df, "Run", **args).orderBy("athlete_id", "date").collect()
    assert len(got) == 72 and all(r.acwr_lower <= r.acwr_upper for r in got)
    assert got == ewma.calculate_acwr_ewma(df, "Run", **args).orderBy("athlete_id", "date").collect()
    with pytest.warns(UserWarning):
        assert "acwr_lower" not in ewma.calculate_acwr_ewma(df, "Run", ci=True, start_date="2024-03-01", end_date="2024-04-05").columns


def test_arguments_are_checked(spark):
    df = acts(spark, [("a", 1, 30)])
    for bad in (dict(activity_type=None), dict(acute_period=28), dict(acute_period=0), dict(load_metric="x"), dict(load_metric="tss"), dict(load_metric="hrss"), dict(start_date="2024-02-01", end_date="2024-01-01"), dict(missing_load="x")):
        with pytest.raises(ValueError):
            acwr.calculate_acwr(df, **({"activity_type": "Run", "start_date": "2024-01-01", "end_date": "2024-02-01"} | bad))
    for bad in (dict(half_life_acute=14), dict(B=0), dict(conf_level=1), dict(smoothing_period=1.5), dict(method="x"), dict(block_len=0)):
        with pytest.raises(ValueError):
            ewma.calculate_acwr_ewma(df, "Run", **bad)
    with pytest.raises(TypeError):
        acwr.calculate_acwr([1], "Run")
    with pytest.warns(UserWarning):
        assert params.day("soon", DAY) == DAY
    with pytest.warns(DeprecationWarning):
        assert params.output_metric("m", "PACE_HR") == "speed_hr"


def test_warnings_and_histogram(spark):
    df = acts(spark, [("a", 10, 30), ("a", 12, None), ("b", 0, 30)])
    loads = load.with_load(df)
    assert [(r.load_status, r.n) for r in load.status_histogram(loads).collect()] == [("missing_duration", 1)]
    w = spine.history_warnings(loads, types=["Run"], fetch_start=DAY, start=DAY + dt.timedelta(days=5), end=DAY + dt.timedelta(days=60), baseline_days=28).collect()
    assert [(r.athlete_id, r.affected_days, r.n_unknown) for r in w] == [("a", 32, 1)]


def test_zones(spark):
    df = spark.createDataFrame([(0.79,), (0.8,), (1.3,), (1.5,), (1.51,), (None,)], "x double")
    assert [r.z for r in df.select(acwr.zone(F.col("x")).alias("z")).collect()] == ["low", "reference", "elevated", "elevated", "high", None]


def test_daily_load_of_a_stream(spark, tmp_path):
    from paceline.streaming.daily import daily_load_stream

    rows = [("a", dt.datetime(2024, 1, 1, 8), 1800), ("a", dt.datetime(2024, 1, 1, 20), 600), ("b", dt.datetime(2024, 1, 2, 8), None), ("a", dt.datetime(2024, 1, 9, 8), 60)]
    df = spark.createDataFrame(rows, "athlete_id string, start_date_local timestamp, moving_time int")
    df.write.parquet(str(tmp_path / "in"))
    stream = daily_load_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("append").format("memory").queryName("daily_loads").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.athlete_id, r.date): r.daily_load for r in spark.sql("select * from daily_loads").collect()}
    assert got[("a", dt.date(2024, 1, 1))] == 40 and got[("b", dt.date(2024, 1, 2))] is None and math.isclose(len(got), 2)
    assert daily_load_stream(df).count() == 3
