import datetime as dt
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.operators import coverage, efficiency, pbs, quality, steady


def stream(spark, columns, **more):
    """One activity from columns of equal length."""
    n = len(next(iter(columns.values())))
    names = [*columns, *more]
    rows = [(i, *[None if columns[c][i] is None else float(columns[c][i]) for c in columns], *more.values()) for i in range(n)]
    kinds = ", ".join(["seq_no long", *[f"{c} double" for c in columns], *[f"{c} {'boolean' if isinstance(v, bool) else 'long'}" for c, v in more.items()]])
    assert names
    return spark.createDataFrame(rows, kinds)


def steady_run(n=3600, seed=1, speed=3.0, hr=150):
    rng = np.random.default_rng(seed)
    return {"time_s": np.arange(n), "heartrate": hr + rng.normal(0, 1, n), "velocity_smooth": speed + rng.normal(0, 0.05, n), "watts": 200 + rng.normal(0, 3, n)}


def ef(spark, cols, metric="speed_hr", **options):
    return efficiency.ef_from_streams(stream(spark, cols), metric, **options).first()


def test_steady_stream_has_an_efficiency(spark):
    cols = steady_run()
    r = ef(spark, cols)
    assert r.status == "ok" and r.ef_value == pytest.approx(3 / 150, rel=0.01) and r.n_steady_blocks == 1 and r.sampling_interval_seconds == 1 and r.quality_score == 1 and r.hr_coverage == 1
    assert r.steady_duration_minutes == pytest.approx((3600 - 300) / 60, abs=0.1)
    assert ef(spark, cols, "power_hr").ef_value == pytest.approx(200 / 150, rel=0.01)
    g = ef(spark, cols, "gap_hr")
    assert (g.status, g.ef_metric_requested, g.ef_metric_used) == ("gap_stream_unavailable_fallback_to_speed", "gap_hr", "speed_hr") and g.ef_value == r.ef_value


def test_rejections(spark):
    cols = steady_run()
    n = len(cols["time_s"])
    assert ef(spark, {k: v for k, v in cols.items() if k != "heartrate"}).status == "missing_hr_data"
    assert ef(spark, {k: v for k, v in cols.items() if k != "velocity_smooth"}).status == "missing_velocity_data"
    assert ef(spark, {k: v for k, v in cols.items() if k != "watts"}, "power_hr").status == "missing_power_data"
    r = ef(spark, cols | {"heartrate": [150 if i < n / 4 else None for i in range(n)]})
    assert r.status == "insufficient_hr_data" and 0.2 < r.hr_coverage < 0.3 and r.quality_score is None
    assert ef(spark, {k: v[:99] for k, v in cols.items()}).status == "insufficient_data_points"
    assert ef(spark, cols | {"velocity_smooth": [0] * n}).status == "insufficient_valid_data"
    assert ef(spark, cols | {"velocity_smooth": [20] * n}).status == "insufficient_data_after_quality_filter"
    assert ef(spark, {k: v[:1100] for k, v in cols.items()}).status == "too_short"
    assert ef(spark, cols | {"velocity_smooth": [1 if i % 40 < 20 else 5 for i in range(n)]}).status == "non_steady"
    islands = [3.0 if (i // 300) % 2 == 0 else 1 + 4 * ((i // 7) % 2) for i in range(n)]
    assert ef(spark, cols | {"velocity_smooth": islands}, min_steady_minutes=15).status in ("insufficient_steady_duration", "non_steady")


def test_quality_control_modes(spark):
    rng = random.Random(3)
    cols = steady_run()
    cols["heartrate"] = [230 if rng.random() < 0.05 else h for h in cols["heartrate"]]
    by = {m: ef(spark, cols, quality_control=m) for m in ("filter", "flag", "off")}
    assert by["flag"].ef_value == by["off"].ef_value != by["filter"].ef_value
    assert by["flag"].quality_score == by["filter"].quality_score < 1 == by["off"].quality_score


def test_two_samples_a_second(spark):
    cols = steady_run(7200)
    cols["time_s"] = np.arange(7200) / 2
    r = ef(spark, cols)
    assert r.status == "ok" and r.sampling_interval_seconds == 0.5


def test_velocity_from_distance(spark):
    cols = steady_run()
    cols["distance"] = np.cumsum(cols.pop("velocity_smooth"))
    assert ef(spark, cols).ef_value == pytest.approx(0.02, rel=0.01)


def test_decoupling(spark):
    cols = steady_run(5400)
    cols["heartrate"] = [h * (1.0 if i < 2700 else 1.1) for i, h in enumerate(cols["heartrate"])]
    r = efficiency.decoupling_from_streams(stream(spark, cols)).first()
    assert r.status == "ok" and r.decoupling == pytest.approx((1 - 1 / 1.1) * 100, abs=1)
    assert efficiency.decoupling_from_streams(stream(spark, {k: v for k, v in cols.items() if k != "time_s"})).first().status == "missing_time_data"
    two = [3.0 if i < 900 or 1800 <= i < 2700 else 1 + 4 * ((i // 7) % 2) for i in range(5400)]
    r = efficiency.decoupling_from_streams(stream(spark, cols | {"velocity_smooth": two}), min_steady_minutes=25).first()
    assert r.status == "insufficient_steady_duration" and r.decoupling is None


def test_streams_are_told_apart_and_joined_with_activities(spark):
    good, bad = steady_run(), steady_run(300)
    s = stream(spark, good, activity_id=1).unionByName(stream(spark, bad, activity_id=2)).withColumn("athlete_id", F.lit("a"))
    rows = [(i, "a", "Run", dt.date(2024, 1, i), 10000.0, 3600, 150.0) for i in (1, 2, 3)] + [(4, "a", "Swim", dt.date(2024, 1, 4), 1.0, 3600, 150.0), (5, "a", "Run", dt.date(2024, 1, 5), 1.0, 60, 150.0), (6, "a", "Run", dt.date(2024, 1, 6), 1.0, 3600, None)]
    acts = spark.createDataFrame(rows, "id long, athlete_id string, type string, date date, distance double, moving_time int, average_heartrate double")
    got = {r.activity_id: r for r in efficiency.calculate_ef(acts, start_date="2023-12-31", end_date="2024-02-01", streams=s).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "ok", 2: "too_short", 3: "no_streams"}
    assert got[3].ef_value == pytest.approx(0.0185185, abs=1e-6) and got[3].quality_score is None
    dec = efficiency.calculate_decoupling(acts, s, start_date="2023-12-31", end_date="2024-02-01").collect()
    assert {r.activity_id: r.status for r in dec} == {1: "ok", 2: "insufficient_steady_duration"}


def test_coverage_and_interval(spark):
    s = stream(spark, {"time_s": [*range(10), 1000], "heartrate": [150] * 10 + [None]})
    assert coverage.coverage(s).first().coverage == pytest.approx(9 / 1000)
    assert coverage.coverage(s, "watts").first().coverage == 1
    assert coverage.coverage(stream(spark, {"time_s": [1], "heartrate": [0]})).first().coverage == 0
    for times, want in (([0, 1, 2, 3], 1), ([0, 2, 4], 2), ([0, 0.5, 1], 0.5), ([0], 1), ([3, 3, 3], 1), ([4, 0, 2], 2)):
        assert coverage.sampling_interval(stream(spark, {"time_s": times})).first().sampling_interval_seconds == want


@pytest.mark.parametrize("k", [1, 2, 5, 8, 60])
def test_rolling_variation_against_slices(spark, k):
    rng = random.Random(k)
    v = [rng.uniform(1, 9) for _ in range(70)]
    some = [x if rng.random() < 0.8 else None for x in v]
    for values, skip in ((v, False), (some, False), (some, True)):
        s = coverage.normalized(stream(spark, {"time_s": range(70), "v": values})).withColumn("k", F.lit(k))
        got = [r.cv for r in steady.rolling_variation(s, "v", "k", (), skip_nulls=skip).orderBy("seq_no").collect()]
        for i, g in enumerate(got):
            a, b = i - (k - 1) // 2, i + k // 2
            part = values[a : b + 1] if a >= 0 and b < 70 else []
            known = [x for x in part if x is not None]
            if len(part) == k and (skip or len(known) == k) and len(known) > 1:
                assert g == pytest.approx(statistics.stdev(known) / statistics.mean(known), rel=1e-6, abs=1e-9)
            else:
                assert g is None


def test_flags(spark):
    s = stream(spark, {"time_s": range(100), "heartrate": [250] * 10 + [150] * 90})
    r = quality.summarize_quality(quality.flag_quality(s)).first()
    assert (r.flagged_points, r.flagged_pct, r.total_points) == (11, 11.0, 100) and r.quality_score == 0.89
    for gap, want in ((1, True), (5, False)):
        s = stream(spark, {"time_s": [0, gap], "heart_rate": [140, 152]})
        assert [x.flag_hr_spike for x in quality.flag_quality(s).orderBy("seq_no").collect()] == [False, want]
    s = stream(spark, {"time_s": [0, 1, 1, 2], "speed": [8, 8, 30, 8], "power": [100, 100, 1501, 100]})
    run = quality.flag_quality(s).orderBy("seq_no").collect()
    ride = quality.flag_quality(s, "Ride").orderBy("seq_no").collect()
    assert [x.flag_gps_drift for x in run] == [True, True, True, True] and [x.flag_gps_drift for x in ride] == [False, False, True, True]
    assert [x.flag_pw_spike for x in run] == [False, False, True, True]
    with pytest.warns(UserWarning):
        quality.flag_quality(s, steady_cv_threshold=8)
    with pytest.raises(ValueError):
        quality.summarize_quality(s)


def test_steady_state_of_a_stream(spark):
    cols = {"time_s": range(400), "watts": [200 if i < 200 else 200 + 150 * (i % 2) for i in range(400)]}
    got = quality.flag_quality(stream(spark, cols), min_steady_minutes=1).orderBy("seq_no").collect()
    assert [r.seq_no for r in got if r.is_steady_state] == list(range(29, 170 + (got[170].is_steady_state)))


def best(spark, d, t, x):
    rows = pbs.best_efforts(stream(spark, {"distance": list(d), "time_s": list(t)}), [x]).collect()
    return tuple(rows[0])[3:] if rows else None


def test_best_efforts_golden(spark):
    assert best(spark, [3 * i for i in range(667)], range(667), 1000)[0] == pytest.approx(1000 / 3)
    assert best(spark, range(21), [*range(11), *[10 + k / 10 for k in range(1, 11)]], 15.5) == pytest.approx((6.5, 4.5, 20))
    assert best(spark, [*range(6), *[5] * 5, *range(6, 21)], range(26), 15)[0] == 15
    assert best(spark, [*range(11), 9, 10, *range(11, 26)], [*range(0, 101, 10), 110, 120, *range(121, 136)], 15) == (35, 10, 25)
    assert best(spark, range(9), range(9), 2) is None and best(spark, range(12), range(12), 50) is None


def plain_best(t, d, target):
    """Fixed-distance best effort the long way, for distinct times."""
    knots, top, last, moving, bounce = [(d[0], 0.0)], d[0], t[0], 0.0, False
    for x, y in zip(t[1:], d[1:]):
        if y > top:
            moving, top, last, bounce = moving + x - last, y, x, False
            knots.append((y, moving))
        elif y == top:
            last = last if bounce else x
        else:
            bounce = True
    if len(d) < 10 or len(knots) < 10 or knots[-1][0] - knots[0][0] < target:
        return None
    ds, ts = zip(*knots)
    starts = sorted({x for x in ds if x + target <= ds[-1]} | {x - target for x in ds if x - target >= ds[0]})
    return min(((float(np.interp(s + target, ds, ts) - np.interp(s, ds, ts)), s) for s in starts), default=None)


def test_best_efforts_on_random_streams(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for a in range(40):
        t, d = [0.0], [0.0]
        for _ in range(rng.randrange(5, 80)):
            t.append(t[-1] + rng.choice([0.5, 1, 1, 2, 30]))
            d.append(max(0.0, d[-1] + rng.choice([0, 0, 3.0, 4.5, 2.25, -4.5])))
        rows += [(a, i, x, y) for i, (x, y) in enumerate(zip(t, d))]
        for target in (20.0, 55.5):
            w = plain_best(t, d, target)
            if w and w[0] > 0:
                want[a, target] = w[0]
    df = spark.createDataFrame(rows, "activity_id long, seq_no long, time_s double, distance double")
    got = {(r.activity_id, r.distance): r.time_seconds for r in pbs.best_efforts(df, [20.0, 55.5]).collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want) and len(want) > 30


def test_records_and_labels(spark):
    rows = [("a", i, dt.date(2024, 1, d), 5000.0, s) for i, (d, s) in enumerate([(1, 1500.0), (2, 1600.0), (3, 1500.0), (3, 1333.3), (4, 3900.0)])]
    got = pbs.progression(spark.createDataFrame(rows, "athlete_id string, activity_id long, activity_date date, distance double, time_seconds double")).orderBy("activity_id").collect()
    assert [r.is_pb for r in got] == [True, False, True, True, False]
    assert [r.cumulative_pb_seconds for r in got] == [1500, 1500, 1500, 1333.3, 1333.3]
    assert {r.distance_label for r in got} == {"5k"} and [r.time_period for r in got][3:] == ["22M 13.3S", "1H 5M 0S"]
