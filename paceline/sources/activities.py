"""The activities table of a bulk export: a CSV file, or a ZIP archive that holds it."""

from __future__ import annotations

import csv
import datetime as dt
import io
import re
import warnings
import zipfile
from collections.abc import Iterator, Sequence
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..params import day, types as as_types
from ..schema import ACTIVITY_SCHEMA

#: fixed values: headers of each column in the order in which they are looked for
HEADERS = {
    "id": ("Activity ID", "Activity.ID"),
    "name": ("Activity Name", "Activity.Name"),
    "type": ("Activity Type", "Activity.Type"),
    "start": ("Activity Date", "Activity.Date"),
    "distance": ("Distance.1", "Distance...18", "Distance"),
    "moving_time": ("Moving Time.1", "Moving.Time.1", "Moving.Time", "Moving Time"),
    "elapsed_time": ("Elapsed Time.1", "Elapsed.Time.1", "Elapsed Time...16", "Elapsed Time", "Elapsed.Time"),
    "average_heartrate": ("Average.Heart.Rate", "Average Heart Rate"),
    "max_heartrate": ("Max.Heart.Rate.1", "Max Heart Rate.1", "Max Heart Rate...31", "Max Heart Rate", "Max.Heart.Rate"),
    "average_watts": ("Average.Watts", "Average Watts"),
    "max_watts": ("Max.Watts", "Max Watts"),
    "weighted_average_watts": ("Weighted Average Power", "Weighted.Average.Power"),
    "elevation_gain": ("Elevation.Gain", "Elevation Gain"),
    "elevation_loss": ("Elevation.Loss", "Elevation Loss"),
    "average_speed": ("Average.Speed", "Average Speed"),
    "max_speed": ("Max.Speed", "Max Speed"),
    "average_gap": ("Average.Grade.Adjusted.Pace", "Average Grade Adjusted Pace"),
    "calories": ("Calories",),
    "relative_effort": ("Relative.Effort.1", "Relative Effort.1", "Relative Effort...38", "Relative Effort", "Relative.Effort"),
    "filename": ("Filename",),
}
REQUIRED = ("id", "start", "type", "distance", "moving_time", "elapsed_time")
_MEMBER = re.compile(r"activities\.csv$", re.IGNORECASE)


def unique_headers(names: Sequence[str | None]) -> list[str]:
    """Repeated headers get .1, .2 and so on, from the second one; empty ones a number."""
    seen: dict[str, int] = {}
    out: list[str] = []
    for i, raw in enumerate(names):
        name = (raw or "").strip().lstrip("﻿") or f"column{i + 1}"
        while name in out:
            seen[raw or ""] = seen.get(raw or "", 0) + 1
            name = f"{raw}.{seen[raw or '']}"
        out.append(name)
    return out


def parse_start(text: Column) -> Column:
    """A UTC timestamp from "Oct 01, 2024, 8:35:00 AM", "10/01/2024 08:35:00 AM" or "2024-10-01 08:35:00"; else null."""
    forms = ("MMM d, yyyy, h:mm:ss a", "M/d/yyyy h:mm:ss a", "M-d-yyyy h:mm:ss a", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
    return F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in forms])


def canonical(raw: DataFrame) -> DataFrame:
    """The 22 columns of ACTIVITY_SCHEMA from a table of texts under an export's headers.

    What cannot be read as a number or a time is null; whole numbers are cut, not rounded; absent optional columns are null.
    """
    found = {k: next((h for h in names if h in raw.columns), None) for k, names in HEADERS.items()}
    absent = [HEADERS[k][0] for k in REQUIRED if found[k] is None]
    if absent:
        raise ValueError(f"no columns {', '.join(absent)}; is the export in English? Found: {', '.join(raw.columns[:12])}")
    text = lambda k: F.lit(None).cast("string") if found[k] is None else F.col(f"`{found[k]}`").cast("string")
    number = lambda k: F.when(F.trim(text(k)) != "", F.trim(text(k))).try_cast("double")
    start = parse_start(text("start"))
    given = {"name": text("name"), "type": text("type"), "sport_type": text("type"), "start_date_local": start, "date": F.to_date(start), "filename": text("filename")}
    out = []
    for f in ACTIVITY_SCHEMA.fields:
        value = given.get(f.name)
        if value is None:
            value = number(f.name)
            if not isinstance(f.dataType, T.DoubleType):
                value = F.when(~F.isnan(value), F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))).try_cast(f.dataType)
        out.append(value.cast(f.dataType).alias(f.name))
    return raw.select(*out)


def _csv(spark: SparkSession, path: str) -> DataFrame:
    options = {"multiLine": True, "escape": '"', "inferSchema": False}
    head = spark.read.options(**options, header=False).csv(path).first()
    if head is None:
        raise ValueError(f"{path} is empty")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in unique_headers(list(head))])
    return spark.read.options(**options, header=True).schema(schema).csv(path)


def _zipped(spark: SparkSession, path: str) -> DataFrame:
    """The first activities.csv of an archive: its header is read alone, its rows once, in batches."""
    kind = "member string, row long, cells array<string>"
    archive = spark.read.format("binaryFile").load(path).select("content")

    def read(member: str | None):
        """Rows of a member; the first row of all members for None."""
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in parts:
                for content in part.content:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for name in filter(_MEMBER.search, z.namelist()):
                            if member not in (None, name):
                                continue
                            with z.open(name) as f:
                                rows = enumerate(csv.reader(io.TextIOWrapper(f, "utf-8-sig", newline="")))
                                while some := list(islice(rows, 1 if member is None else 10_000)):
                                    yield pd.DataFrame({"member": name, "row": [i for i, _ in some], "cells": [x for _, x in some]})
                                    if member is None:
                                        break

        return run

    heads = archive.mapInPandas(read(None), kind).select("member", "cells").collect()
    if not heads:
        raise ValueError(f"no activities.csv in {path}")
    if len(heads) > 1:
        warnings.warn(f"{len(heads)} files activities.csv in {path}; using {heads[0].member}", stacklevel=3)
    names = unique_headers(heads[0].cells)
    body = archive.mapInPandas(read(heads[0].member), kind).filter("row > 0")
    return body.select(*[F.try_element_at("cells", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])


def load_activities(spark: SparkSession, path: str, start_date: object = None, end_date: object = None, activity_types: str | Sequence[str] | None = None, *, ordered: bool = False) -> DataFrame:
    """The activities of an export, within dates (the last one whole) and types, in ACTIVITY_SCHEMA.

    Any place that Spark reads will do. Without rows the table is empty, with all columns. Rows come unsorted, or by start and
    id if `ordered`: what follows a load rarely needs the order, and a sort of all rows is a shuffle.
    """
    kinds = as_types(activity_types)
    raw = _zipped(spark, path) if path.lower().endswith(".zip") else _csv(spark, path)
    df = canonical(raw)
    first, last = day(start_date, None, "start_date"), day(end_date, None, "end_date")
    if first is not None:
        df = df.filter(F.col("start_date_local") >= F.lit(dt.datetime.combine(first, dt.time())))
    if last is not None:
        df = df.filter(F.col("start_date_local") <= F.lit(dt.datetime.combine(last, dt.time(23, 59, 59))))
    df = df if kinds is None else df.filter(F.col("type").isin(*kinds))
    return df.orderBy("start_date_local", "id") if ordered else df


load_local_activities = load_activities


def write_table(df: DataFrame, path: str, *, form: str = "parquet", partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """A result as Parquet, ORC, JSON or CSV (with a header)."""
    writer = df.write.mode(mode).partitionBy(*partition_by) if partition_by else df.write.mode(mode)
    writer = writer.option("header", True) if form == "csv" else writer
    writer.format(form).save(path)
