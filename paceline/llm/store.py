"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..storage import new_place

#: rows may hold packed arrays; small row groups keep a reader's batch small
_ROW_GROUP = 16 << 20
#: a table is written by one execution, so its shuffle files are of no use after that
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table of the shared folder, read again: it cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = new_place(spark, name)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("parquet.block.size", _ROW_GROUP).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes written() tables that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, df._written_path
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def unused(name: str, *tables: DataFrame) -> str:
    """A column name like `name` that none of the tables has, in any case of letters."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name
