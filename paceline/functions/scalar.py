"""Column expressions that several operators share; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

__all__ = ["clean", "column_or_null", "distance_label", "divide", "finite", "haversine", "month_year", "normalized_power", "period_text", "present", "round_even"]

EARTH_RADIUS_M = 6_371_000.0


def finite(x: Column) -> Column:
    """True for a value that is neither null, NaN nor infinite."""
    x = x.cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def clean(x: Column) -> Column:
    """x as a double; NaN and infinities are null."""
    return F.when(finite(x), x.cast("double"))


def divide(a: Column, b: Column) -> Column:
    """a / b; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def column_or_null(df: DataFrame, name: str, kind: str = "double") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def present(df: DataFrame, name: str) -> Column:
    """Whether an activity has a channel: has_<name> if there is such a column, else whether the table has the column."""
    flag = f"has_{name}"
    return F.coalesce(F.col(flag), F.lit(False)) if flag in df.columns else F.lit(name in df.columns)


def normalized_power(df: DataFrame) -> Column:
    """The first positive one of weighted and plain average power, else 0."""
    weighted, plain = (clean(column_or_null(df, c)) for c in ("weighted_average_watts", "average_watts"))
    return F.when(weighted > 0, weighted).when(plain > 0, plain).otherwise(F.lit(0.0))


def round_even(x: Column, digits: int) -> Column:
    """Rounding half to even."""
    return F.bround(x, digits)


def distance_label(meters: Column) -> Column:
    """Names of the usual race distances; others in whole meters."""
    named = {1000.0: "1k", 5000.0: "5k", 10000.0: "10k", 21097.5: "21.1k", 42195.0: "Marathon"}
    out = F.concat(F.bround(meters, 0).cast("long").cast("string"), F.lit("m"))
    for d, label in named.items():
        out = F.when(meters == d, label).otherwise(out)
    return out


def period_text(seconds: Column) -> Column:
    """Days, hours, minutes and seconds as in "1H 5M 0S"; leading zero units are left out, seconds have up to two decimals."""
    whole = F.floor(seconds).cast("long")
    d, h, m = F.floor(whole / 86400).cast("long"), F.floor(whole / 3600).cast("long") % 24, F.floor(whole / 60).cast("long") % 60
    s = F.round(seconds - F.floor(seconds / 60) * 60, 2)
    text = F.regexp_replace(F.format_string("%.2f", s), r"\.?0+$", "")
    text = F.when(s == 0, F.lit("0")).otherwise(text)
    return F.concat(
        F.when(d > 0, F.concat(d.cast("string"), F.lit("d "))).otherwise(F.lit("")),
        F.when((d > 0) | (h > 0), F.concat(h.cast("string"), F.lit("H "))).otherwise(F.lit("")),
        F.when((d > 0) | (h > 0) | (m > 0), F.concat(m.cast("string"), F.lit("M "))).otherwise(F.lit("")),
        text, F.lit("S"))


def month_year(day: Column) -> Column:
    """English month and year, as in "Mar 2024"."""
    return F.date_format(day, "MMM yyyy")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Meters between two points in degrees."""
    a, b = F.radians(lat1), F.radians(lat2)
    x = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_M) * F.atan2(F.sqrt(x), F.sqrt(F.greatest(F.lit(0.0), 1 - x)))
