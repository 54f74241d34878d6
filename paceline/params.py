"""Checks of arguments, and results with the arguments they were made with."""

from __future__ import annotations

import datetime as dt
import warnings
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from .schema import EF_METRICS, LOAD_METRICS


@dataclass(frozen=True)
class Result:
    """A lazy result and the arguments it was made with."""

    df: DataFrame
    kind: str
    params: dict = field(default_factory=dict)


def frame(df: object, name: str = "activities") -> DataFrame:
    if not isinstance(df, DataFrame):
        raise TypeError(f"{name} must be a DataFrame, not {type(df).__name__}")
    return df


def day(value: object, default: dt.date | None, name: str = "date") -> dt.date | None:
    """A date from a date, timestamp or ISO text; None gives the default, what cannot be read a warning and the default."""
    if value is None:
        return default
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    try:
        return dt.date.fromisoformat(str(value)[:10])
    except ValueError:
        warnings.warn(f"{name} {value!r} cannot be read as a date; using {default}", stacklevel=3)
        return default


def window(start: object, end: object, *, days_back: int | None = 365, check: bool = True) -> tuple[dt.date | None, dt.date]:
    """First and last day of an analysis: today and `days_back` days before it, where not given."""
    last = day(end, dt.date.today(), "end_date")
    first = day(start, last - dt.timedelta(days=days_back) if days_back is not None else None, "start_date")
    if check and first is not None and first >= last:
        raise ValueError(f"start_date {first} must be before end_date {last}")
    return first, last


def positive(**values: float) -> None:
    for name, v in values.items():
        if isinstance(v, bool) or not isinstance(v, (int, float)) or not v > 0:
            raise ValueError(f"{name} must be a positive number, not {v!r}")


def positive_ints(**values: int) -> None:
    for name, v in values.items():
        if isinstance(v, bool) or not isinstance(v, int) or v < 1:
            raise ValueError(f"{name} must be a whole number of 1 or more, not {v!r}")


def fractions(**values: float) -> None:
    for name, v in values.items():
        if not 0 < v <= 1:
            raise ValueError(f"{name} must be above 0 and at most 1, not {v!r}")


def not_negative(**values: float) -> None:
    for name, v in values.items():
        if v < 0:
            raise ValueError(f"{name} must not be negative: {v!r}")


def ordered_periods(acute: float, chronic: float, what: str = "period") -> None:
    positive(**{f"acute {what}": acute, f"chronic {what}": chronic})
    if acute >= chronic:
        raise ValueError(f"acute {what} {acute} must be below chronic {what} {chronic}")


def one_of(name: str, value: str, allowed: Iterable[str]) -> str:
    allowed = tuple(allowed)
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {value!r}")
    return value


def load_metric(metric: str, ftp: float | None, max_hr: float | None, rest_hr: float | None) -> str:
    one_of("load_metric", metric, LOAD_METRICS)
    if metric == "tss" and ftp is None:
        raise ValueError("user_ftp is needed for tss")
    if metric == "hrss" and (max_hr is None or rest_hr is None):
        raise ValueError("user_max_hr and user_resting_hr are needed for hrss")
    return metric


def output_metric(name: str, value: str, allowed: Iterable[str] = EF_METRICS) -> str:
    """A metric's name in lower case; the old name pace_hr gives a warning and speed_hr."""
    value = value.lower()
    if value == "pace_hr":
        warnings.warn(f"{name} 'pace_hr' is now 'speed_hr'", DeprecationWarning, stacklevel=3)
        value = "speed_hr"
    return one_of(name, value, allowed)


def types(value: str | Sequence[str] | None, *, required: bool = False) -> tuple[str, ...] | None:
    if value is None:
        if required:
            raise ValueError("activity_type must be given")
        return None
    out = (value,) if isinstance(value, str) else tuple(value)
    if not all(isinstance(x, str) for x in out) or required and not out:
        raise ValueError(f"activity_type must be text, not {value!r}")
    return out


def quality_control(value: str) -> str:
    return one_of("quality_control", value, ("filter", "flag", "off"))


def export_place(path: str) -> str:
    """A directory or a .zip file, by name; whether it exists is for the reader to find."""
    if not isinstance(path, str) or not path:
        raise ValueError("export_dir must be the path of a directory or a .zip file")
    return path


def renamed(old: str, new: str) -> None:
    warnings.warn(f"{old} is now {new}", DeprecationWarning, stacklevel=3)
