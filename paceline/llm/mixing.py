"""Mixing sources to target weights, with DataFrame functions only.

Rows get hash-random keys.  The key space of a source is cut into equal ranges; sums of
words by range, added up over the ranges, tell the range in which the source's budget
ends; a running sum inside that one range finds the exact cut.  A budget is whole epochs
plus the words before the cut, so a row's share follows from its key and its source's cut:
no row is moved or sorted but those of the ranges with a cut.  Repeated rows have one key;
they are summed up before any window sees them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import dropped, written

WORDS = r"[^\x20\x09-\x0D]+"
_ROWS_PER_RANGE = 8192
_STEP = 1 << 16


def _keys(seed: int) -> list[Column]:
    """_src, _key and _twin of a row; _twin is the same for repeated rows, and orders others of one key."""
    text = F.coalesce("text", F.lit(""))
    return [
        F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source")).alias("_src"),  # nulls last
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", F.xxhash64(text)), 1).alias("_key"),  # 63 bits, not negative
        F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hash(text)).alias("_twin"),
    ]


def targets(sizes: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """_src, source_size, target: one row per source, from sums of words (_src, words).

    Weights repeat over the sources by code point, null last.  The sources share all words by weight; no target is above
    max_epochs times its source's size, and what is above is reshared by weight among the rest until none is above: sources
    in the order of size by weight, the first whose cap exceeds its share of what is left sets the words by weight for all after it.
    """
    by = sizes.groupBy("_src").agg(F.sum("words").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("_src")) - 1  # one row per source
    by = by.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("r", F.col("cap") / F.col("w"))
    line = Window.orderBy("r", "_src")
    upto = line.rowsBetween(Window.unboundedPreceding, -1)
    onward = line.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("level", (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) / F.sum("w").over(onward))
    by = by.withColumn("level", F.min(F.when(F.col("r") > F.col("level"), F.struct("r", "_src", "level"))).over(whole)["level"])
    return by.select("_src", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), F.col("cap")).alias("target"))


def _cuts(slim: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """One row per source: _src, source_size, target, whole (epochs), rest (words beyond them), and the rows at its cut: _at_key,
    _at_twin, doc_id, source, _one (words of a row), _n (repeated rows), _part (words before the cut); nulls if the cut is at an end."""
    n = slim.count()
    bits = max(0, (max(1, n // _ROWS_PER_RANGE) - 1).bit_length())
    ranged = slim.withColumn("_range", F.shiftright("_key", 63 - bits) if bits else F.lit(0).cast("long"))
    ranges = written(ranged.groupBy("_src", "_range").agg(F.sum("_size").alias("words")), "mix-ranges")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = targets(ranges, weights, max_epochs).withColumn("whole", whole)
    budget = budget.withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    before = Window.partitionBy("_src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    at = ranges.withColumn("_offset", F.coalesce(F.sum("words").over(before), F.lit(0))).join(budget.select("_src", "rest"), "_src")
    at = at.filter((F.col("_offset") < F.col("rest")) & (F.col("rest") <= F.col("_offset") + F.col("words"))).drop("words")
    at = written(at, "mix-at")  # a row for each source: as a table its size is known, so it is sent to the rows
    rows = ranged.join(at, ["_src", "_range"]).groupBy("_src", "_range", "_key", "_twin", "doc_id", "source", "_offset", "rest").agg(F.max("_size").alias("_one"), F.count("*").alias("_n"), F.sum("_size").alias("_all"))
    inside = Window.partitionBy("_src", "_range").orderBy("_key", "_twin").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_part", F.col("rest") - F.col("_offset") - F.coalesce(F.sum("_all").over(inside), F.lit(0)))
    rows = rows.filter((F.col("_part") > 0) & (F.col("_part") <= F.col("_all")))
    cut = rows.select("_src", F.col("_key").alias("_at_key"), F.col("_twin").alias("_at_twin"), "doc_id", "source", "_one", "_n", "_part")
    out = written(budget.join(cut, "_src", "left"), "mix-cuts")
    dropped(ranges, at)
    return out


def _at_cut() -> tuple[Column, Column]:
    """Whether a row is before its source's cut, and whether it is one of the rows at the cut."""
    at = F.coalesce((F.col("_key") == F.col("_at_key")) & (F.col("_twin") == F.col("_at_twin")), F.lit(False))
    first = (F.col("_key") < F.col("_at_key")) | ((F.col("_key") == F.col("_at_key")) & (F.col("_twin") < F.col("_at_twin")))
    return F.coalesce(first, F.col("rest") > 0), at


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 11) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: each source's taken words sum to its target, rounded.

    Every row is taken once per whole epoch; of the rest, the words before the exact cut, so that the row at the cut counts in part.
    Null texts and texts without words have size 0 and are taken 0 times; null sources are one source, the last; repeated rows are
    rows of their own, and those at a cut are taken one after the other; very long texts count whole; an empty table gives no rows.
    Other columns, whatever their names, are not read.  Reruns agree: keys depend on doc_id and text only.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS)).cast("long")
    slim = written(docs.select("doc_id", "source", size.alias("_size"), *_keys(seed)), "mix")
    cuts = _cuts(slim, weights, max_epochs)
    before, at = _at_cut()
    facts = ["_src", "source_size", "target", "whole", "rest"]
    rows = slim.join(cuts.select(*facts, "_at_key", "_at_twin"), "_src").filter(~at)
    rows = rows.select("doc_id", "source", F.col("_size").alias("size"), "source_size", "target", (F.col("_size") * (F.col("whole") + F.when(before, 1).otherwise(0))).alias("taken"))
    again = cuts.filter("_n > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {_STEP}"))))
    again = again.withColumn("i", F.explode(F.sequence(F.col("i") * _STEP, F.least(F.col("i") * _STEP + (_STEP - 1), F.col("_n") - 1))))
    taken = F.col("_one") * F.col("whole") + F.greatest(F.lit(0), F.least("_one", F.col("_part") - F.col("i") * F.col("_one")))
    out = written(rows.unionByName(again.select("doc_id", "source", F.col("_one").alias("size"), "source_size", "target", taken.alias("taken"))), "mix-taken")
    dropped(slim, cuts)
    return out


def mixed(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 11) -> DataFrame:
    """The rows of docs that make up the mix, with their own columns, whatever their names, repeated by epoch; whole texts only.

    The row at the cut is in if at least half of it is before the cut, so a source differs from its target by half a text at most.
    Of repeated rows at the cut each is in by a toss of hashes, in the share that is before the cut.
    Rows of size 0 stand for nothing and are left out.  An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    size = F.regexp_count(text, F.lit(WORDS)).cast("long")
    slim = written(docs.select("doc_id", "source", size.alias("_size"), *_keys(seed)), "mix")
    cuts = _cuts(slim, weights, max_epochs).drop("doc_id", "source", "source_size", "target")  # a row for each source; it stays
    dropped(slim)
    before, at = _at_cut()
    toss = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "_place"), 11) / F.lit(float(1 << 53))
    share = F.round(F.col("_part") / F.col("_one")) / F.col("_n")
    once = F.when(at, toss < share).otherwise(before)
    rows = docs.filter(text.rlike(WORDS)).select(F.struct("*").alias("_row"), *_keys(seed), F.monotonically_increasing_id().alias("_place")).join(cuts, "_src")
    rows = rows.withColumn("_copies", (F.col("whole") + F.when(once, 1).otherwise(0)).cast("int")).filter("_copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select("_row.*")
