import datetime as dt

import pytest
from pyspark.sql import functions as F

import paceline
from paceline import charts
from paceline.functions import distance_label, haversine, month_year, period_text
from tests.core.test_load_series import acts


def test_described_results_label_charts(spark):
    df = acts(spark, [("a", d, 60) for d in range(121)])
    r = paceline.described(paceline.calculate_acwr, df, "Run", start_date="2024-04-01", end_date="2024-04-30")
    assert r.kind == "acwr" and r.params["chronic_period"] == 28 and "activities" not in r.params
    assert charts.plot_acwr(r).labels["subtitle"] == "load: duration_mins; types: Run; 7 against 28 days"
    e = paceline.described(paceline.calculate_exposure, df, "Run", end_date="2024-04-30")
    assert charts.plot_exposure(e).labels["subtitle"] == "load: duration_mins; 7 against 42 days, up to 2024-04-30"


def test_history_is_checked(spark):
    df = acts(spark, [("a", 80, 30), ("a", 82, None)])
    args = dict(start=dt.date(2024, 3, 1), end=dt.date(2024, 4, 30), history_days=28, baseline_days=28)
    with pytest.warns(UserWarning) as said:
        paceline.check_history(df, ["Run"], "duration_mins", **args)
    text = " / ".join(str(w.message) for w in said)
    assert "2 activities are few" in text and "1 of 2 loads are unknown and count as zero: missing_duration 1" in text and "short baseline" in text
    with pytest.raises(ValueError):
        paceline.check_history(df, ["Swim"], "duration_mins", **args)
    with pytest.warns(UserWarning):
        paceline.require_rows(df.limit(0), "efforts", error=False)
    with pytest.raises(ValueError):
        paceline.require_rows(df.limit(0), "efforts")


def test_samples_draw_every_chart(spark):
    made = {
        charts.plot_acwr: paceline.sample_acwr(spark), charts.plot_ef: paceline.sample_ef(spark), charts.plot_decoupling: paceline.sample_decoupling(spark),
        charts.plot_exposure: paceline.sample_exposure(spark), charts.plot_pbs: paceline.sample_pbs(spark),
    }
    for plot, df in made.items():
        assert df.collect() == df.collect() and df.count() >= 50
        assert charts.render(plot(df)).startswith("{")
    assert paceline.sample_pbs(spark).filter("is_pb").count() > 4
    with pytest.raises(AttributeError):
        paceline.nothing


def test_scalars(spark):
    df = spark.createDataFrame([(42195.0, 10507.25, dt.date(2024, 3, 5)), (1609.34, 59.999, dt.date(2024, 12, 31)), (1000.0, 90061.0, None)], "d double, s double, day date")
    got = df.select(distance_label(F.col("d")).alias("l"), period_text(F.col("s")).alias("p"), month_year(F.col("day")).alias("m")).collect()
    assert [tuple(r) for r in got] == [("Marathon", "2H 55M 7.25S", "Mar 2024"), ("1609m", "60S", "Dec 2024"), ("1k", "1d 1H 1M 1S", None)]
    m = spark.range(1).select(haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("x"), haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("y")).first()
    assert m.x == pytest.approx(111194.93, abs=0.01) and m.y == pytest.approx(20015086.8, abs=0.1)


def test_calls_check_on_demand(spark, capsys):
    df = acts(spark, [("a", 80, 30), ("a", 82, None)])
    window = {"start_date": "2024-03-01", "end_date": "2024-04-30"}
    for call in (lambda t, **o: paceline.calculate_acwr(df, t, **window, **o), lambda t, **o: paceline.calculate_acwr_ewma(df, t, method="ewma", **window, **o), lambda t, **o: paceline.calculate_exposure(df, t, end_date="2024-04-30", **o)):
        with pytest.warns(UserWarning, match="are few"):
            call("Run", checked=True)
        with pytest.raises(ValueError, match="no activities"):
            call("Swim", checked=True)
        assert call("Swim").count() == 0
    paceline.checks.verbose()
    paceline.described(paceline.calculate_acwr, df, "Run", **window)
    assert "acwr" in capsys.readouterr().err
    paceline.checks.verbose(False)
