"""Simulated results of one athlete, for examples and charts: the same rows in each session and on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .operators.pbs import progression

_START = "2024-01-01"


def _noise(name: str, spread: float, *more: Column) -> Column:
    """About normal numbers, by the row's id and a name: the sum of four hashes."""
    units = [F.pmod(F.xxhash64(F.lit(f"{name}{k}"), "id", *more), F.lit(1 << 20)) / float(1 << 20) for k in range(4)]
    return (sum(units[1:], units[0]) - 2) * (spread * 3**0.5)


def _days(spark: SparkSession, n: int, step: int = 1) -> DataFrame:
    return spark.range(n).withColumn("date", F.date_add(F.lit(_START).cast("date"), (F.col("id") * step).cast("int")))


def sample_acwr(spark: SparkSession, days: int = 365) -> DataFrame:
    """date, atl, ctl, acwr, acwr_smooth."""
    season = F.sin(F.col("id") / 365.0 * 6.283185307179586)
    ctl = 50 + 10 * season + _noise("c", 1.0)
    atl = ctl * (1 + 0.15 * F.sin(F.col("id") / 28.0 * 6.283185307179586) + _noise("a", 0.05))
    df = _days(spark, days).select("id", "date", atl.alias("atl"), ctl.alias("ctl"))
    df = df.withColumn("acwr", F.col("atl") / F.col("ctl"))
    return df.select("date", "atl", "ctl", "acwr", (F.col("acwr") * 0.8 + 0.2).alias("acwr_smooth"))


def sample_exposure(spark: SparkSession, days: int = 365) -> DataFrame:
    """date, daily_load, ctl, atl, acwr."""
    load = F.greatest(F.lit(0.0), F.when(F.col("id") % 7 == 6, 0.0).otherwise(60 + _noise("l", 25.0)))
    df = _days(spark, days).select("date", load.alias("daily_load"), (45 + 8 * F.sin(F.col("id") / 60.0) + _noise("c", 1.5)).alias("ctl"), (47 + 14 * F.sin(F.col("id") / 20.0) + _noise("a", 3.0)).alias("atl"))
    return df.withColumn("acwr", F.col("atl") / F.col("ctl"))


def sample_ef(spark: SparkSession, activities: int = 50) -> DataFrame:
    """date, activity_type, ef_value."""
    ride = F.col("id") % 3 == 0
    base = F.when(ride, 1.55).otherwise(0.0195) * (1 + F.col("id") * 0.001)
    return _days(spark, activities, 7).select("date", F.when(ride, "Ride").otherwise("Run").alias("activity_type"), (base * (1 + _noise("e", 0.03))).alias("ef_value"))


def sample_decoupling(spark: SparkSession, activities: int = 365) -> DataFrame:
    """date, decoupling."""
    return _days(spark, activities).select("date", (6 - F.col("id") * 0.005 + _noise("d", 2.0)).alias("decoupling"))


def sample_pbs(spark: SparkSession, dates: int = 20) -> DataFrame:
    """The columns of calculate_pbs() over four distances."""
    targets = F.explode(F.array(*[F.struct(F.lit(d).alias("distance"), F.lit(p).alias("pace")) for d, p in ((1000.0, 0.24), (5000.0, 0.27), (10000.0, 0.285), (21097.5, 0.31))])).alias("x")
    df = _days(spark, dates, 18).select("id", "date", targets).select("id", "date", "x.*")
    seconds = F.col("distance") * F.col("pace") * (1 - F.col("id") * 0.002) * (1 + _noise("p", 0.02, F.col("distance")))
    return progression(df.select(F.lit("self").alias("athlete_id"), F.col("id").alias("activity_id"), F.col("date").alias("activity_date"), "distance", F.round(seconds, 1).alias("time_seconds"))).drop("athlete_id")
