"""Percentile bands of a metric over athletes."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import clean
from ..params import frame, renamed
from ..schema import ATHLETE

PROBS = (0.05, 0.25, 0.5, 0.75, 0.95)


def percentile_name(p: float) -> str:
    """p05 for 0.05; p02_5 for 0.025."""
    whole = round(p * 100, 6)
    head = f"p{int(whole):02d}"
    return head if whole == int(whole) else head + "_" + f"{whole:.6f}".split(".")[1].rstrip("0")


def calculate_cohort_reference(
    data: DataFrame, metric: str = "acwr_smooth", by: Sequence[str] | str | None = ("sport",), probs: Sequence[float] = PROBS, min_athletes: int = 5, allow_unknown_athlete: bool = False, date_col: str = "date",
) -> DataFrame:
    """date, by…, n_athletes, percentile, value: exact percentiles (linear between neighbours) over one mean value per athlete.

    Athletes without a known value do not count; groups of fewer than min_athletes are left out.  Columns of `by` that are absent
    are left out with a warning.  Without athlete_id the call fails, unless each row is to stand for an athlete of its own group.
    """
    frame(data, "data")
    by = (by,) if isinstance(by, str) else tuple(by or ())
    for name in (date_col, metric):
        if name not in data.columns:
            raise ValueError(f"no column {name!r}")
    absent = [c for c in by if c not in data.columns]
    if absent:
        warnings.warn(f"no columns {', '.join(absent)}; grouping without", stacklevel=2)
    by = [c for c in by if c in data.columns]
    if ATHLETE not in data.columns:
        if not allow_unknown_athlete:
            raise ValueError(f"{ATHLETE} is needed to weigh athletes equally")
        warnings.warn("all rows count as one athlete", stacklevel=2)
        data = data.withColumn(ATHLETE, F.lit("unknown"))
    if not probs or not all(0 <= p <= 1 for p in probs):
        raise ValueError("probs must be between 0 and 1")
    groups = [date_col, *by]
    athletes = data.groupBy(*groups, ATHLETE).agg(clean(F.avg(F.col(metric).cast("double"))).alias("_value"))
    names = [percentile_name(p) for p in probs]
    bands = athletes.groupBy(*groups).agg(F.count("_value").alias("n_athletes"), F.percentile("_value", [float(p) for p in probs]).alias("_p"))
    bands = bands.filter(F.col("n_athletes") >= min_athletes).select(*groups, "n_athletes", *[F.col("_p")[i].alias(n) for i, n in enumerate(names)])
    return bands.unpivot([*groups, "n_athletes"], names, "percentile", "value")


def cohort_reference(data: DataFrame, **options) -> DataFrame:
    renamed("cohort_reference", "calculate_cohort_reference")
    return calculate_cohort_reference(data, **options)


def duplicate_bands(bands: DataFrame, date_col: str = "date") -> DataFrame:
    """Days and percentiles with more than one value: such bands cannot be drawn as one."""
    return bands.groupBy(date_col, "percentile").agg(F.count("*").alias("n")).filter("n > 1")


def wide_bands(bands: DataFrame, percentiles: Sequence[str] | None = None, date_col: str = "date", *, check: bool = True) -> DataFrame:
    """One row per day, one column per percentile."""
    if check and not duplicate_bands(bands, date_col).isEmpty():
        raise ValueError("several bands a day: filter the bands to one group first")
    names = list(percentiles) if percentiles else [percentile_name(p) for p in PROBS]
    return bands.groupBy(date_col).pivot("percentile", names).agg(F.first("value"))


def with_bands(individual: DataFrame, bands: DataFrame, metric: str = "acwr_smooth", date_col: str = "date") -> DataFrame:
    """An athlete's series beside the bands of each day."""
    return individual.select(date_col, metric, *([ATHLETE] if ATHLETE in individual.columns else [])).join(wide_bands(bands, date_col=date_col), date_col, "left")
