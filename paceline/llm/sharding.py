"""Uniform shuffle into shards of exact sizes, with DataFrame functions only.

Rows fall into blocks by hash.  A communication matrix says how many rows of each block
go to each shard; its rows are hypergeometric draws that add up to the exact shard sizes.
Blocks permute their rows locally and cut them by the matrix; shards permute again.
The matrix is drawn down a tree of blocks, `_FAN` children to a node, so nodes of one
level are independent and no task sees more than its own node.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import dropped, written

_FAN_BITS = 6
_ROWS_PER_BLOCK = 4096
_SALTS = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def hypergeometric(population: Column, good: Column, drawn: Column, u: Column) -> Column:
    """The number of good ones among `drawn` of `population`, by inversion at u.

    Weights are relative to the mode's, by the ratio of neighbours, out to ten standard deviations and ten more, beyond
    which a double holds nothing of them.
    """
    def body(a: Column) -> Column:
        n_, k_, d_ = a["n"], a["k"], a["d"]
        low, high = F.greatest(F.lit(0.0), d_ + k_ - n_), F.least(d_, k_)
        mode = F.least(high, F.greatest(low, F.floor((d_ + 1) * (k_ + 1) / (n_ + 2)).cast("double")))
        spread = F.ceil(10 * F.sqrt(F.greatest(F.lit(0.0), d_ * k_ / F.greatest(n_, F.lit(1.0)) * (1 - k_ / F.greatest(n_, F.lit(1.0)))))).cast("double") + 10
        return _let(F.struct(a["n"].alias("n"), a["k"].alias("k"), a["d"].alias("d"), a["u"].alias("u"), mode.alias("m"), F.least(high, mode + spread).alias("hi"), F.greatest(low, mode - spread).alias("lo")), pick)

    def pick(b: Column) -> Column:
        n_, k_, d_, m = b["n"], b["k"], b["d"], b["m"]
        ups = F.when(b["hi"] > m, F.sequence((m + 1).cast("long"), b["hi"].cast("long"))).otherwise(F.array().cast("array<bigint>"))
        downs = F.when(b["lo"] < m, F.sequence((m - 1).cast("long"), b["lo"].cast("long"), F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        up = lambda w, x: w * (k_ - x + 1) * (d_ - x + 1) / (x * (n_ - k_ - d_ + x))
        down = lambda w, x: w * (x + 1) * (n_ - k_ - d_ + x + 1) / ((k_ - x) * (d_ - x))
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))
        total = lambda xs, step: F.aggregate(xs, start, lambda c, x: _let(step(c["w"], x), lambda w: F.struct(w.alias("w"), (c["s"] + w).alias("s"))))["s"]
        sums = F.struct((b["u"] * (1 + total(ups, up) + total(downs, down)) - 1).alias("left"))

        def walk(left: Column, found: Column, xs: Column, step: Callable) -> Column:
            begin = F.struct(F.lit(1.0).alias("w"), left.alias("left"), found.alias("at"))
            move = lambda c, x: F.when(c["left"] < 0, c).otherwise(_let(step(c["w"], x), lambda w: F.struct(w.alias("w"), (c["left"] - w).alias("left"), x.cast("double").alias("at"))))
            return F.aggregate(xs, begin, move)

        return _let(sums, lambda s: _let(walk(s["left"], m, ups, up), lambda c: walk(c["left"], c["at"], downs, down)))["at"].cast("long")

    args = F.struct(population.cast("double").alias("n"), good.cast("double").alias("k"), drawn.cast("double").alias("d"), u.alias("u"))
    return _let(args, body)


def _split(caps: Column, counts: Column, seed: int, node: Column) -> Column:
    """For each child count, in order, how many of each remaining capacity it gets: an array of arrays."""
    def child(state: Column, one: Column) -> Column:
        def shard(c: Column, s: Column) -> Column:
            good = state["caps"][(s - 1).cast("int")]
            u = _uniform(F.lit(seed), node, one["i"], s)
            return _let(hypergeometric(c["pop"], good, c["left"], u), lambda k: F.struct((c["pop"] - good).alias("pop"), (c["left"] - k).alias("left"), F.concat(c["out"], F.array(k)).alias("out")))

        pop = F.aggregate(state["caps"], F.lit(0).cast("long"), lambda a, x: a + x)
        begin = F.struct(pop.alias("pop"), one["n"].alias("left"), F.array().cast("array<bigint>").alias("out"))
        drawn = F.aggregate(F.sequence(F.lit(1).cast("long"), F.size("caps").cast("long")), begin, shard)["out"]
        return _let(drawn, lambda v: F.struct(F.zip_with(state["caps"], v, lambda a, b: a - b).alias("caps"), F.concat(state["out"], F.array(v)).alias("out")))

    begin = F.struct(caps.alias("caps"), F.array().cast("array<array<bigint>>").alias("out"))
    return F.aggregate(counts, begin, child)["out"]


def communication_matrix(counts: DataFrame, bits: int, total: int, n_shards: int, seed: int) -> DataFrame:
    """_block, caps: for each block of `counts` (_block, n), the rows it sends to each shard."""
    spark = counts.sparkSession
    caps = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    nodes = spark.range(1).select(F.col("id").alias("_block"), F.array(*[F.lit(c).cast("long") for c in caps]).alias("caps"))
    done = 0
    while done < bits or done == bits == 0:
        fan = min(_FAN_BITS, bits - done)
        rest = bits - done - fan
        sums = counts.groupBy(F.shiftright("_block", rest).alias("c")).agg(F.sum("n").alias("n"))
        at = F.col("c").bitwiseAND(F.lit((1 << fan) - 1).cast("long"))
        by = sums.groupBy(F.shiftright("c", fan).alias("_block")).agg(F.map_from_entries(F.collect_list(F.struct(at, "n"))).alias("by"))
        child = F.transform(F.sequence(F.lit(0).cast("long"), F.lit((1 << fan) - 1).cast("long")), lambda i: F.struct(i.alias("i"), F.coalesce(F.col("by")[i], F.lit(0).cast("long")).alias("n")))
        level = nodes.join(by, "_block").withColumn("children", _split(F.col("caps"), child, seed, F.concat_ws(":", F.lit(str(done)), "_block")))
        nodes = level.select(F.col("_block").alias("parent"), F.posexplode("children").alias("i", "caps")).select((F.shiftleft("parent", fan) + F.col("i")).alias("_block"), "caps")
        done += fan
        if not bits:
            break
    return nodes


def _copies(rows: DataFrame) -> DataFrame:
    """rows (written) with _copy: 1, 2 and so on over the rows of equal doc_id and _text, wherever they lie.

    Equal rows are numbered by _salt, so that many of them are no single window; each salt's numbers begin after those of the salts before.
    """
    same = ["doc_id", "_text"]
    copy = F.row_number().over(Window.partitionBy(*same, "_salt").orderBy(F.lit(1)))
    counts = rows.groupBy(*same, "_salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*same).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = counts.withColumn("_before", F.sum("n").over(before)).filter("_before > 0").select(F.col("doc_id").alias("d"), F.col("_text").alias("t"), F.col("_salt").alias("s"), "_before")
    found = rows.withColumn("_copy", copy).join(offset, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("_text") == F.col("t")) & (F.col("_salt") == F.col("s")), "left")
    return found.withColumn("_copy", F.col("_copy") + F.coalesce("_before", F.lit(0))).drop("d", "t", "s", "_before", "_salt")


def shards(docs: DataFrame, *, n_shards: int = 40, seed: int = 23, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns of `keep`, size, text_crc32, law ("rows"), shard, slot, grown_shard (null).

    Shard sizes differ by one row at most, the larger first; slots run from 0 without gaps; all assignments of rows to places
    are equally likely over seeds.  Null texts count as empty; repeated rows, ties and null ids are rows of their own; very long
    texts only count; an empty table gives no rows.  Other columns are not read; a column of `keep` that is named like one of the
    result is left out.
    """
    keep = tuple(c for c in keep if c.lower() not in ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))
    text = F.coalesce("text", F.lit(""))
    own = F.struct(*keep) if keep else F.lit(None).cast("int")
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(_SALTS)).cast("int")
    rows = docs.select(
        "doc_id", own.alias("_own"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("_text"), salt.alias("_salt"))
    read = written(rows, "shard-read")
    rows = _copies(read).withColumn("_key", F.xxhash64(F.lit(seed), "doc_id", "_text", "_copy")).drop("_text", "_copy")
    rows = first = written(rows, "shard-rows")
    dropped(read)
    n = rows.count()
    bits = max(0, (max(1, n // _ROWS_PER_BLOCK) - 1).bit_length())
    block = F.shiftrightunsigned("_key", 64 - bits) if bits else F.lit(0).cast("long")
    rows = rows.withColumn("_block", block)
    matrix = communication_matrix(rows.groupBy("_block").agg(F.count("*").alias("n")), bits, n, n_shards, seed)
    running = F.transform(F.sequence(F.lit(1), F.size("caps")), lambda i: F.aggregate(F.slice("caps", F.lit(1), i), F.lit(0).cast("long"), lambda a, x: a + x))
    local = Window.partitionBy("_block").orderBy(F.xxhash64(F.lit(seed + 1), "_key"), "doc_id", "size", "text_crc32")
    rows = rows.withColumn("_r", F.row_number().over(local)).join(matrix.withColumn("ends", running).drop("caps"), "_block")
    rows = rows.withColumn("shard", F.size(F.filter("ends", lambda x: x < F.col("_r")))).withColumn("_again", F.xxhash64(F.lit(seed + 2), "_key"))
    sub_bits = max(0, (max(1, n // n_shards // _ROWS_PER_BLOCK) - 1).bit_length())
    sub = F.shiftrightunsigned("_again", 64 - sub_bits) if sub_bits else F.lit(0).cast("long")
    rows = sent = written(rows.drop("ends", "_block", "_r").withColumn("_sub", sub), "shard-sent")
    dropped(first)
    before = Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    offset = rows.groupBy("shard", "_sub").agg(F.count("*").alias("n")).withColumn("_offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    again = Window.partitionBy("shard", "_sub").orderBy("_again", "doc_id", "size", "text_crc32")
    rows = rows.withColumn("_r", F.row_number().over(again)).join(offset, ["shard", "_sub"])
    own_columns = [F.col("_own")[c].alias(c) for c in keep]
    out = rows.select("doc_id", *own_columns, "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_offset") + F.col("_r") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    out = written(out, "shards")
    dropped(sent)
    return out
