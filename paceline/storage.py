"""The folder for intermediate tables that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session.  Unset, a session of one process gets a folder of its own, which goes when it ends;
    on a cluster there is no folder to guess that all machines see: an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="paceline-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        path = _OWN[app]
    if not path:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path.rstrip("/")


def new_place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else has."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def as_files(lines: DataFrame, name: str, extension: str, compression: str = "none") -> str:
    """Writes lines (key, place, line) as one text file for each key, lines by place, into the shared folder; its path.

    The files are in folders key=…; extension: three letters.  Rows are dealt by a hash of the key: a union whose sides are both
    partitioned by key is not dealt again by the key itself, and its sides may then write the same key in different tasks.
    """
    path = new_place(lines.sparkSession, name)
    rows = lines.repartition(F.xxhash64("key")).sortWithinPartitions("key", "place").select("key", "line")
    rows.write.options(header=False, sep="\x01", quote="", extension=extension, compression=compression).partitionBy("key").csv(path)
    return path


def as_text(df: DataFrame, name: str) -> str:
    """Writes a table as CSV with a header into the shared folder; its path."""
    path = new_place(df.sparkSession, name)
    df.write.option("header", True).option("escape", '"').csv(path)
    return path
