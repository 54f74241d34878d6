"""Checks that look at data: they run small jobs, so they are apart from the operators, which stay lazy."""

from __future__ import annotations

import datetime as dt
import inspect
import logging
import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from .operators.load import status_histogram, with_load
from .operators.spine import history_warnings, in_scope, with_athlete
from .params import Result

log = logging.getLogger("paceline")


def described(function: Callable[..., DataFrame], *args, **options) -> Result:
    """A call's lazy result with its kind and all of its plain arguments, defaults too: what charts label themselves with."""
    bound = inspect.signature(function).bind(*args, **options)
    bound.apply_defaults()
    params = {k: v for k, v in bound.arguments.items() if not isinstance(v, DataFrame)}
    if isinstance(params.get("activity_type"), str):
        params["activity_type"] = (params["activity_type"],)
    kind = function.__name__.removeprefix("calculate_")
    log.info("%s with %s", kind, params)
    return Result(function(*args, **options), kind, params)


def verbose(on: bool = True) -> None:
    """Whether calls through described() tell what they do, on the standard error output."""
    log.setLevel(logging.INFO if on else logging.WARNING)
    if on and not log.handlers:
        log.addHandler(logging.StreamHandler())


def require_rows(df: DataFrame, what: str, *, error: bool = True) -> DataFrame:
    """df, if it has rows; else an error or a warning."""
    if df.isEmpty():
        if error:
            raise ValueError(f"no {what}")
        warnings.warn(f"no {what}; the result is empty", stacklevel=2)
    return df


def check_history(
    activities: DataFrame, types: Sequence[str] | None, metric: str, *, start: dt.date, end: dt.date, history_days: int, baseline_days: int, missing_load: str = "zero", **thresholds,
) -> None:
    """Fails if no activity of the types is in the history and the analysis; warns of athletes whose first days rest on a short
    baseline, of unknown loads that count as zero (with their three most frequent reasons), and of few activities."""
    loads = with_load(with_athlete(activities), metric, **thresholds)
    fetch = start - dt.timedelta(days=history_days)
    scoped = in_scope(loads, types, end).filter(F.col("date") >= F.lit(fetch))
    n, unknown = scoped.agg(F.count("*"), F.count(F.when(F.col("load").isNull(), 1))).first()
    if not n:
        raise ValueError(f"no activities of {types or 'any type'} from {fetch} to {end}")
    if n < baseline_days:
        warnings.warn(f"{n} activities are few for a baseline of {baseline_days} days", stacklevel=2)
    if unknown and missing_load == "zero":
        reasons = ", ".join(f"{r.load_status} {r.n}" for r in status_histogram(scoped).collect())
        warnings.warn(f"{unknown} of {n} loads are unknown and count as zero: {reasons}", stacklevel=2)
    short = history_warnings(loads, types=types, fetch_start=fetch, start=start, end=end, baseline_days=baseline_days).filter("affected_days > 0")
    athletes, days = short.agg(F.count("*"), F.max("affected_days")).first()
    if athletes:
        warnings.warn(f"for {athletes} athletes up to {days} days of the analysis have a short baseline", stacklevel=2)
