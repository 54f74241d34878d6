"""Steady blocks of a stream: rolling variation over a window that depends on the data, and runs of steady samples.

A centred window of k rows, k by activity, is the difference of two running sums: the rows are ordered by their number
divided by k, and the two frames end half a unit after and before the row.  Running sums cost one step a row, however long
the window.  Values are centred on the activity's mean first, so that sums of squares keep their digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .coverage import in_time, of_activity

MIN_BLOCK_ROWS = 100
WINDOW_SECONDS = 300


def window_rows(seconds: float, interval: Column, min_rows: Column, max_rows: Column) -> Column:
    """Rows of a window of so many seconds, between min_rows and max_rows; max_rows wins."""
    rows = F.ceil(F.lit(float(seconds)) / interval)
    return F.when(max_rows < min_rows, max_rows).otherwise(F.greatest(F.least(rows, max_rows), min_rows)).cast("long")


def rolling_variation(df: DataFrame, value: str, k: str, part: tuple[str, ...], *, skip_nulls: bool = False, out: str = "cv") -> DataFrame:
    """df with the coefficient of variation of `value` over centred windows of `k` rows within activity and `part`, in time order.

    Null where the window is not whole, and where a value of it is null, unless nulls are skipped.  An even window has one row
    more after the row than before it.
    """
    names = ", ".join(["athlete_id", "activity_id", *part])
    df = df.withColumn("_rn", F.row_number().over(in_time(*part))).withColumn("_n", F.count("*").over(of_activity(*part)))
    df = df.withColumn("_mid", F.avg(value).over(of_activity(*part))).withColumn("_x", F.col(value) - F.col("_mid")).withColumn("_pos", F.col("_rn") / F.col(k))

    def upto(what: str, bound: str) -> Column:
        return F.coalesce(F.expr(f"{what} over (partition by {names} order by _pos range between unbounded preceding and {bound})"), F.lit(0))

    ahead, behind = "0.500000001D following", "0.499999999D preceding"
    # rows up to half a unit back belong to the window; those before it end just beyond half a unit
    sums = {f"_{name}_{side}": upto(what, bound) for name, what in (("s", "sum(_x)"), ("q", "sum(_x * _x)"), ("c", "count(_x)")) for side, bound in (("hi", ahead), ("lo", behind))}
    df = df.withColumns(sums)
    s, q, c = (F.col(f"_{x}_hi") - F.col(f"_{x}_lo") for x in "sqc")
    first, last = F.col("_rn") - F.floor((F.col(k) - 1) / 2), F.col("_rn") + F.floor(F.col(k) / 2)
    whole = (first >= 1) & (last <= F.col("_n")) & (c >= 1 if skip_nulls else c == F.col(k))
    mean = F.col("_mid") + F.try_divide(s, c)
    variance = F.greatest(F.lit(0.0), F.try_divide(q - F.try_divide(s * s, c), c - 1))
    cv = F.when(whole & (c >= 2) & (mean != 0), F.try_divide(F.sqrt(variance), mean))
    return df.withColumn(out, cv).drop("_rn", "_n", "_mid", "_x", "_pos", *sums)


def with_blocks(df: DataFrame, steady: str, part: tuple[str, ...], out: str = "block") -> DataFrame:
    """df with the number of the run of equal `steady` values that a row is in, and that run's minutes and rows."""
    turn = F.coalesce((F.col(steady) != F.lag(steady).over(in_time(*part))).cast("int"), F.lit(1))
    df = df.withColumn("_turn", turn).withColumn(out, F.sum("_turn").over(in_time(*part).rowsBetween(-(2**63), 0))).drop("_turn")
    run = of_activity(*part, out)
    return df.withColumns({f"{out}_minutes": (F.max("time_s").over(run) - F.min("time_s").over(run)) / 60, f"{out}_rows": F.count("*").over(run)})


def qualifies(steady: Column, minutes: Column, rows: Column, min_minutes: float) -> Column:
    return steady & (minutes >= min_minutes) & (rows >= MIN_BLOCK_ROWS)
