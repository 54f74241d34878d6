import datetime as dt
import json

import numpy as np
import pytest

from paceline import charts
from paceline.operators import cohort, trend
from paceline.params import Result

D = dt.date(2024, 1, 1)


def cohort_rows(spark, n=10, days=5):
    rows = [(D + dt.timedelta(days=d), f"a{i}", "Run" if i % 2 else "Ride", 0.5 + i / 10 + d / 100) for i in range(n) for d in range(days)]
    return spark.createDataFrame(rows, "date date, athlete_id string, sport string, acwr_smooth double")


def test_bands_weigh_athletes_equally(spark):
    df = spark.createDataFrame([(D, "A", 0.5)] * 10 + [(D, "B", 5.0), (D, "C", None), (D, "D", float("nan"))], "date date, athlete_id string, acwr_smooth double")
    with pytest.warns(UserWarning):
        got = {r.percentile: r for r in cohort.calculate_cohort_reference(df, min_athletes=2).collect()}
    assert got["p50"].value == 2.75 and got["p50"].n_athletes == 2 and list(got) == ["p05", "p25", "p50", "p75", "p95"]
    with pytest.warns(UserWarning):
        assert cohort.calculate_cohort_reference(df, min_athletes=3).count() == 0


def test_bands_equal_linear_quantiles(spark):
    df = cohort_rows(spark)
    got = {(r.date, r.percentile): r.value for r in cohort.calculate_cohort_reference(df, by=None, probs=[0.05, 0.333, 1]).collect()}
    assert {k[1] for k in got} == {"p05", "p33_3", "p100"}
    assert got[D, "p33_3"] == pytest.approx(np.quantile(np.arange(10) / 10 + 0.5, 0.333))


def test_guards(spark):
    df = cohort_rows(spark)
    with pytest.raises(ValueError):
        cohort.calculate_cohort_reference(df.drop("athlete_id"))
    with pytest.raises(ValueError):
        cohort.calculate_cohort_reference(df, metric="nothing")
    with pytest.warns(UserWarning):
        assert cohort.calculate_cohort_reference(df.drop("athlete_id"), allow_unknown_athlete=True, min_athletes=1).count() == 50
    bands = cohort.calculate_cohort_reference(df, min_athletes=2)
    assert cohort.duplicate_bands(bands).count() == 25
    with pytest.raises(ValueError):
        cohort.wide_bands(bands)
    wide = cohort.wide_bands(bands.filter("sport = 'Run'"))
    assert wide.columns == ["date", "p05", "p25", "p50", "p75", "p95"] and wide.count() == 5
    with pytest.warns(DeprecationWarning):
        cohort.cohort_reference(df)


def test_trends(spark):
    df = spark.createDataFrame([("g", float(x), 2.0 * x + 1) for x in range(12)], "k string, x double, y double")
    r = trend.linear_trend(df, "x", "y", ["k"]).first()
    assert (r.slope, r.intercept, r.n) == (pytest.approx(2), pytest.approx(1), 12)
    fitted = trend.loess_trend(df, "x", "y", ["k"], points=5).collect()
    assert all(f.fitted == pytest.approx(2 * f.x + 1) for f in fitted) and len(fitted) == 5


def series(spark, top=1.2, ci=False):
    rows = [(D + dt.timedelta(days=i), 50.0, 50.0, 1.0, None if i < 3 else 0.9 + (top - 0.9) * i / 39, 0.8, 1.3) for i in range(40)]
    df = spark.createDataFrame(rows, "date date, atl double, ctl double, acwr double, acwr_smooth double, acwr_lower double, acwr_upper double")
    return df if ci else df.drop("acwr_lower", "acwr_upper")


def test_acwr_chart(spark):
    c = charts.plot_acwr(Result(series(spark), "acwr", {"load_metric": "tss", "activity_type": ["Run"], "acute_period": 7, "chronic_period": 28}))
    assert c.scales["y"] == [0, 2.0] and c.scales["y_breaks"][-1] == 2.0 and c.scales["x"] == (dt.date(2024, 1, 2), dt.date(2024, 2, 11))
    assert c.labels["subtitle"] == "load: tss; types: Run; 7 against 28 days" and c.layers["series"].count() == 37
    assert [m.get("name") for m in c.marks[:4]] == ["high", "elevated", "reference", "low"]
    assert charts.plot_acwr(series(spark, 2.31)).scales["y"] == [0, pytest.approx(2.31)]
    assert charts.plot_acwr(series(spark), highlight_zones=False).scales["y"] == [0, 1.5]
    for bad in (dict(sweet_spot_min=1.4), dict(high_risk_min=1.3)):
        with pytest.raises(ValueError):
            charts.plot_acwr(series(spark), **bad)
    with pytest.warns(UserWarning):
        charts.plot_acwr(series(spark).drop("acwr_smooth"))
    with pytest.warns(DeprecationWarning):
        charts.plot_acwr(series(spark), load_metric="tss")
    doc = json.loads(charts.render(c))
    assert len(doc["datasets"]["series"]) == 37 and doc["usermeta"]["kind"] == "acwr"


def test_bands_on_charts(spark):
    bands = cohort.calculate_cohort_reference(cohort_rows(spark), by=None)
    c = charts.plot_acwr_enhanced(series(spark, ci=True), bands, method_label="weights")
    assert c.labels["subtitle"] == "by weights; own bands shaded; over the cohort's bands" and len(c.marks) == 7 + 3 + 2 and c.layers["bands"].count() == 5
    assert len(charts.plot_acwr_enhanced(series(spark), highlight_zones=False).marks) == 1
    assert len(charts.add_reference_bands(charts.plot_acwr(series(spark)), bands, ["p50"]).marks) == 9
    with pytest.raises(TypeError):
        charts.add_reference_bands("p", bands)
    assert charts.plot_with_reference(series(spark), bands).labels["title"] == "Acwr_smooth beside a cohort"
    both = charts.plot_acwr_comparison(series(spark), series(spark, ci=True))
    assert {r.method for r in both.layers["series"].select("method").distinct().collect()} == {"rolling means", "exponential weights"}


def test_other_charts(spark):
    ef = spark.createDataFrame([(D + dt.timedelta(days=i), "Run" if i % 2 else "Ride", 1 + i / 100 if i else None) for i in range(20)], "date date, activity_type string, ef_value double")
    c = charts.plot_ef(Result(ef, "ef", {"ef_metric": "power_hr"}), smooth_per_activity_type=True)
    assert c.labels["y"] == charts.EF_LABELS["power_hr"] and c.layers["points"].count() == 19 and c.layers["trend"].select("activity_type").distinct().count() == 2
    assert "trend" not in charts.plot_ef(ef, add_trend_line=False).layers
    assert charts.plot_ef(ef, smoothing_method="lm").layers["trend"].count() == 2
    dec = ef.withColumnRenamed("ef_value", "decoupling")
    assert "trend" in charts.plot_decoupling(dec).layers and "trend" not in charts.plot_decoupling(dec.limit(2)).layers
    x = charts.plot_exposure(series(spark))
    assert x.scales["x"] == [0, pytest.approx(55)] and x.layers["latest"].count() == 1 and len(x.marks) == 5
    assert charts.plot_exposure(series(spark), axis_limit=80).scales["y"] == [0, 80] and len(charts.plot_exposure(series(spark), risk_zones=False).marks) == 2
    pbs = spark.createDataFrame([(D + dt.timedelta(days=i), d, 300.0 - i) for i in range(4) for d in (1000.0, 3000.0)], "activity_date date, distance double, elapsed_time double")
    p = charts.plot_pbs(pbs)
    assert p.scales["distance_order"] == ["1k", "3000m"] and p.layers["trend"].count() == 4
    assert charts.minutes_seconds(119.6) == "02:00" and charts.minutes_seconds(59) == "00:59"
    assert len(charts.palette_nature()) == 9 and len(charts.palette_vibrant()) == 8 and charts.theme(20)["title"]["fontSize"] == 30
    with pytest.raises(ValueError):
        charts.plot_exposure(ef)


def test_every_distance_has_its_place_and_layers_are_bounded(spark):
    rows = [(D, float(x), 10.0 + x) for x in range(100, 400)]
    p = charts.plot_pbs(spark.createDataFrame(rows, "activity_date date, distance double, time_seconds double"))
    assert len(p.scales["distance_order"]) == len(p.scales["facets"]) == 300 and p.scales["distance_order"][0] == "100m"
    with pytest.raises(ValueError, match="more than 299 rows"):
        charts.render(p, max_rows=299)
    assert charts.render(p, max_rows=700).startswith("{")


def test_local_regression_of_means_is_that_of_all_values(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 30, 400).astype(float)
    y = x * x / 40 + rng.normal(0, 1, 400)
    at = np.linspace(0, 29, 12)
    places, back, times = np.unique(x, return_inverse=True, return_counts=True)
    means = np.bincount(back, y) / times
    assert np.allclose(trend.local_fit(x, y, at), trend.local_fit(places, means, at, times=times))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(4)
    got = sorted((r.x, r.fitted) for r in trend.loess_trend(df, "x", "y", [], points=12).collect())
    want = trend.local_fit(x, y, np.linspace(x.min(), x.max(), 12))
    assert np.allclose([v for _, v in got], want)
