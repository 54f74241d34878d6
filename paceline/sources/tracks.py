"""Sensor files of activities: TCX, GPX and FIT, plain or gzipped, in a folder or inside a ZIP archive.

A file is parsed whole by one task, in which its derived channels are made too, so no
exchange is needed before the samples are grouped by activity.
"""

from __future__ import annotations

import datetime as dt
import gzip
import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.scalar import EARTH_RADIUS_M
from ..params import export_place
from ..schema import ACTIVITY, ATHLETE
from .fit import fit_records

CHANNELS = ("time_s", "latitude", "longitude", "elevation", "heartrate", "watts", "cadence", "speed", "distance")
SAMPLES = "file string, position long, format string, parse_status string, seq_no long, " + ", ".join(f"{c} double" for c in CHANNELS)
KINDS = ("fit", "tcx", "gpx")


def _local(tag: object) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _xml(content: bytes) -> ElementTree.Element:
    """The document, from its first "<" on: exports put blanks or a byte-order mark before it."""
    at = content.find(b"<")
    if at < 0:
        raise ValueError("no XML")
    return ElementTree.fromstring(content[at:])


def _number(text: str | None) -> float:
    try:
        return float(text)
    except (TypeError, ValueError):
        return float("nan")


def _seconds(text: str | None, zone: bool | None) -> float:
    """UTC seconds of an ISO time; zone: whether a final Z must be there, or may be (None)."""
    text = (text or "").strip()
    if zone and not text.endswith("Z"):
        return float("nan")
    try:
        return dt.datetime.fromisoformat(text.removesuffix("Z")).replace(tzinfo=dt.timezone.utc).timestamp()
    except ValueError:
        return float("nan")


def _first(node: ElementTree.Element, *names: str) -> str | None:
    """The text of the first node below with one of the local names."""
    return next((x.text for x in node.iter() if x is not node and _local(x.tag) in names), None)


def _child(node: ElementTree.Element | None, name: str) -> ElementTree.Element | None:
    return None if node is None else next((x for x in node if _local(x.tag) == name), None)


def _child_number(node: ElementTree.Element | None, name: str) -> float:
    child = _child(node, name)
    return _number(None if child is None else child.text)


def parse_tcx(content: bytes) -> dict[str, np.ndarray]:
    rows = []
    for point in (x for x in _xml(content).iter() if _local(x.tag) == "Trackpoint"):
        place, time = _child(point, "Position"), _child(point, "Time")
        beat = next((x for x in point.iter() if _local(x.tag) == "HeartRateBpm"), None)
        rows.append((_seconds(None if time is None else time.text, None), _child_number(place, "LatitudeDegrees"), _child_number(place, "LongitudeDegrees"), _child_number(point, "AltitudeMeters"),
                     _child_number(beat, "Value"), _number(_first(point, "Watts")), _child_number(point, "Cadence"), float("nan"), _child_number(point, "DistanceMeters")))
    out = _columns(rows)
    if len(out["time_s"]) > 1:
        with np.errstate(divide="ignore", invalid="ignore"):
            speed = np.diff(out["distance"]) / np.diff(out["time_s"])
        out["speed"][1:] = np.where(np.isfinite(speed), speed, np.nan)
    return out


def parse_gpx(content: bytes) -> dict[str, np.ndarray]:
    rows = []
    for point in (x for x in _xml(content).iter() if _local(x.tag) == "trkpt"):
        time = _child(point, "time")
        rows.append((_seconds(None if time is None else time.text, True), _number(point.get("lat")), _number(point.get("lon")), _child_number(point, "ele"),
                     _number(_first(point, "hr")), _number(_first(point, "power", "PowerInWatts", "Watts")), _number(_first(point, "cad")), float("nan"), float("nan")))
    out = _columns(rows)
    n = len(out["time_s"])
    if n > 1:
        leg = leg_meters(out["latitude"], out["longitude"])
        gap = np.diff(out["time_s"])
        with np.errstate(divide="ignore", invalid="ignore"):
            out["speed"][1:] = np.where(gap > 0, leg / gap, np.nan)
        out["distance"] = np.concatenate([[0.0], np.cumsum(leg)])
    return out


def leg_meters(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Great-circle meters from each point to the next, of differences in radians: as an engine's SQL has them, to the last digits."""
    lat, lon = np.radians(lat), np.radians(lon)
    a, b = lat[:-1], lat[1:]
    x = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.diff(lon) / 2) ** 2
    return 2 * EARTH_RADIUS_M * np.arctan2(np.sqrt(x), np.sqrt(np.maximum(0, 1 - x)))


def _columns(rows: list[tuple]) -> dict[str, np.ndarray]:
    table = np.array(rows, float).reshape(len(rows), len(CHANNELS))
    table = table[~np.isnan(table[:, 0])]
    return {c: table[:, i].copy() for i, c in enumerate(CHANNELS)}


def parse_fit(content: bytes) -> dict[str, np.ndarray]:
    return _columns([tuple(r.get(c, float("nan")) for c in CHANNELS) for r in fit_records(content)])


_PARSERS = {"tcx": parse_tcx, "gpx": parse_gpx, "fit": parse_fit}


def parse_file(name: str, content: bytes) -> tuple[str | None, str, dict[str, np.ndarray] | None]:
    """Format, status (ok, empty, unsupported, or failed with a reason) and channels of a file."""
    base = name.lower()
    try:
        if base.endswith(".gz"):
            base, content = base[:-3], gzip.decompress(content)
        kind = base.rpartition(".")[2]
        if kind not in _PARSERS:
            return None, "unsupported", None
        out = _PARSERS[kind](content)
        return kind, "ok" if len(out["time_s"]) else "empty", out
    except Exception as e:  # a file from anywhere: what is wrong with it is part of the result
        return None, f"failed: {type(e).__name__}: {e}"[:200], None


def _frames(name: str, position: int, content: bytes) -> pd.DataFrame:
    kind, status, channels = parse_file(name, content)
    if status != "ok":
        return pd.DataFrame({"file": [name], "position": [position], "format": [kind], "parse_status": [status], "seq_no": [None]} | {c: [np.nan] for c in CHANNELS})
    n = len(channels["time_s"])
    return pd.DataFrame({"file": name, "position": position, "format": kind, "parse_status": status, "seq_no": np.arange(n)} | channels)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """file, position (in an archive, else 0), content of the sensor files of a folder (any depth) or an archive, one row each."""
    def use(name: str) -> bool:
        return name.lower().removesuffix(".gz").rpartition(".")[2] in KINDS

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for place, content in zip(part.path, part.content):
                if place.lower().endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for i, name in enumerate(z.namelist()):
                            if use(name):
                                yield pd.DataFrame({"file": [name], "position": [i], "content": [z.read(name)]})
                elif use(place):
                    yield pd.DataFrame({"file": [place], "position": [0], "content": [content]})

    reader = spark.read.format("binaryFile")
    if not path.lower().endswith(".zip"):
        reader = reader.option("recursiveFileLookup", True)
    return reader.load(path).select("path", "content").mapInPandas(unpack, "file string, position long, content binary")


def read_tracks(spark: SparkSession, export_dir: str, *, only: DataFrame | None = None) -> DataFrame:
    """The samples of all sensor files of a folder (any depth) or an archive: file, position (in the archive, else 0), format,
    parse_status, seq_no and the channels.  A file that gives no samples has one row, with the reason.

    `only` (file) keeps files whose name without folders is among its names, whatever their number; others are not parsed.
    The members of an archive are rows before they are parsed, so a shuffle of them spreads the parsing.
    """
    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, position, content in zip(part.file, part.position, part.content):
                yield _frames(name, position, content)

    files = _files(spark, export_place(export_dir))
    if only is not None:
        names = only.select(_base(F.col("file")).alias("base")).distinct()
        files = files.withColumn("base", _base(F.col("file"))).join(names, "base", "left_semi").drop("base")
    out = files.select("file", "position", "content").mapInPandas(parse, SAMPLES)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in CHANNELS})


def _clean_path(x):
    """A file name of an activity: forward slashes, no leading one, nothing up to an archive's name."""
    x = F.regexp_replace(F.lower(x), r"\\", "/")
    return F.regexp_replace(F.regexp_replace(x, r"^.*\.zip/", ""), r"^/+", "")


def _base(x):
    return F.element_at(F.split(_clean_path(x), "/"), -1)


def match_files(activities: DataFrame, files: DataFrame) -> DataFrame:
    """athlete_id, activity_id, file: for each activity (with filename) one of the files (file, position).

    Names are compared without case: the same path before one that ends with it, before the same name in any folder; of
    equals the first of the archive.  All three have the name without folders in common, which is the join's key.
    """
    want = activities.filter(F.col("filename") != "").select(ATHLETE, ACTIVITY, _clean_path(F.col("filename")).alias("_want"), _base(F.col("filename")).alias("_base"))
    have = files.select("file", "position").distinct().select("file", "position", _clean_path(F.col("file")).alias("_have"), _base(F.col("file")).alias("_base"))
    tier = F.when(F.col("_have") == F.col("_want"), 0).when(F.col("_have").endswith(F.col("_want")), 1).otherwise(2)
    both = want.join(have, "_base").withColumn("_tier", tier)
    best = Window.partitionBy(ATHLETE, ACTIVITY).orderBy("_tier", "position", "file")
    return both.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(ATHLETE, ACTIVITY, "file")


def activity_streams(spark: SparkSession, activities: DataFrame, export_dir: str) -> DataFrame:
    """The samples of the activities' files, keyed by athlete_id and activity_id, with has_<channel> columns.

    TCX and GPX have all of their format's channels, known or not; of FIT those of which a file has a value.  Activities without
    a file that could be read have no rows.
    """
    acts = activities if ATHLETE in activities.columns else activities.withColumn(ATHLETE, F.lit("self"))
    acts = acts.select(ATHLETE, F.col("id").alias(ACTIVITY), "filename")
    samples = read_tracks(spark, export_dir, only=acts.select(F.col("filename").alias("file")))
    files = samples.filter("parse_status = 'ok' and seq_no = 0").select("file", "position")
    out = match_files(acts, files).join(samples.filter("parse_status = 'ok'"), "file")
    per_file = Window.partitionBy(ATHLETE, ACTIVITY)
    has = {f"has_{c}": (F.col("format") != "fit") | (F.count(c).over(per_file) > 0) for c in ("heartrate", "watts", "distance")}
    return out.withColumns(has).withColumn("has_time", F.lit(True)).drop("file", "position", "format", "parse_status")


def parse_activity_file(spark: SparkSession, file_path: str, export_dir: str | None = None) -> DataFrame:
    """The samples of one file, given by its path or by its name inside an export; its parse_status tells why there are none."""
    if export_dir is None:
        return read_tracks(spark, file_path)
    one = spark.createDataFrame([("self", 0, file_path)], f"{ATHLETE} string, {ACTIVITY} long, filename string")
    samples = read_tracks(spark, export_dir, only=one.select(F.col("filename").alias("file")))
    return samples.join(match_files(one, samples).select("file"), "file", "left_semi")
