import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.llm import mixing, sharding


def documents(n=400):
    rows = [(i, "w " * (i * 7 % 23), None if i % 11 == 0 else ["hot", "b", "a\U0001f600", "￿"][min(3, i % 9)], "x") for i in range(n)]
    return rows + [(n, None, "b", "x"), (n + 1, "", "empty", "x"), (n + 2, "z " * 5000, "hot", "x"), (5, rows[5][1], rows[5][2], "x"), (5, rows[5][1], rows[5][2], "x"), (None, "one two", "hot", "x"), (None, "one two", "hot", "x")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def fill(totals):
    """Targets by repeated resharing."""
    names = sorted((s for s in totals if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in totals else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(totals.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 3 * totals[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3 * totals[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_reaches_targets_exactly(spark, monkeypatch):
    rows = documents()
    totals = Counter()
    for _, t, s, _ in rows:
        totals[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = fill(totals)
    results = []
    for per in (8192, 16):
        monkeypatch.setattr(mixing, "_ROWS_PER_RANGE", per)
        got = mixing.mix(frame(spark, rows)).collect()
        assert len(got) == len(rows)
        taken = Counter()
        for r in got:
            assert r.source_size == totals[r.source] and abs(r.target - want[r.source]) < 1e-6
            assert 0 <= r.taken <= 3 * r["size"]
            taken[r.source] += r.taken
        assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in want)
        results.append(sorted((str(r.doc_id), r["size"], r.taken) for r in got))
    assert results[0] == results[1]
    assert mixing.mix(frame(spark, rows).limit(0)).count() == 0
    assert [r.taken for r in mixing.mix(frame(spark, rows[:0] + [(1, None, None, None)])).collect()] == [0]


def test_mix_against_a_walk_over_the_keys(spark, monkeypatch):
    """What each row is taken, by a plain walk in key order."""
    rows = documents(150) + [(900, "same words", "hot", "x")] * 400
    want_target = fill(Counter({s: sum(len((t or "").split()) for _, t, x, _ in rows if x == s) for s in {r[2] for r in rows}}))
    keyed = frame(spark, rows).select("doc_id", "source", F.col("text"), *mixing._keys(11)).collect()
    want = []
    for s, target in want_target.items():
        mine = sorted((r._key, r._twin, r.doc_id, len((r.text or "").split())) for r in keyed if r.source == s)
        total = sum(x[3] for x in mine)
        whole = int(target // total) if total else 0
        left = round(target - whole * total)
        for _, _, d, n in mine:
            want.append((str(d), n, whole * n + max(0, min(n, left))))
            left -= n
    for per in (8192, 16):
        monkeypatch.setattr(mixing, "_ROWS_PER_RANGE", per)
        monkeypatch.setattr(mixing, "_STEP", 64)
        got = [(str(r.doc_id), r["size"], r.taken) for r in mixing.mix(frame(spark, rows)).collect()]
        assert sorted(got) == sorted(want)


def test_repeated_rows_at_a_cut_are_shared_out(spark):
    rows = [(1, "two words", "a", "x")] * 3000 + [(i, "three words here", "b", "x") for i in range(2, 102)]
    df = frame(spark, rows)
    want = fill(Counter({"a": 6000, "b": 300}))
    taken = {r.source: r.n for r in mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
    assert taken == {s: round(x) for s, x in want.items()}
    kept = {r.source: r["count"] for r in mixing.mixed(df).groupBy("source").count().collect()}
    assert abs(kept["a"] * 2 - want["a"]) < 300 and abs(kept["b"] * 3 - want["b"]) <= 2


def test_columns_named_like_those_of_the_operators_stay(spark):
    names = ["target", "source_size", "rest", "whole", "_size", "_key", "_src", "_twin", "_row", "_copies", "_copy", "_place", "_range", "_part", "Taken"]
    df = frame(spark, documents(60))
    for n in names:
        df = df.withColumn(n, F.lit(n))
    out = mixing.mixed(df)
    assert out.columns == df.columns and out.count() > 0
    assert all(r[n] == n for r in out.collect() for n in names)
    assert mixing.mix(df).count() == df.count()
    more = sharding.shards(df, keep=("size", "target", "source", "Slot"))
    assert more.columns == ["doc_id", "target", "source", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    assert more.count() == df.count() and {r.target for r in more.collect()} == {"target"}


def test_mixed_repeats_whole_rows(spark):
    rows = documents()
    df = frame(spark, rows)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    size = F.regexp_count(F.col("text"), F.lit(mixing.WORDS))
    words = {r.source: r.n for r in out.groupBy("source").agg(F.sum(size).alias("n")).collect()}
    totals = Counter()
    for _, t, s, _ in rows:
        totals[s] += len((t or "").split())
    for s, target in fill(totals).items():
        assert abs(words.get(s, 0) - target) <= (2501 if s == "hot" else 12)
    assert {r.text for r in out.collect()} <= {t for _, t, _, _ in rows}


@pytest.mark.parametrize("rows_per_block, n_shards", [(4096, 40), (8, 7), (1, 3)])
def test_shards_are_exact_and_gapless(spark, monkeypatch, rows_per_block, n_shards):
    monkeypatch.setattr(sharding, "_ROWS_PER_BLOCK", rows_per_block)
    monkeypatch.setattr(sharding, "_FAN_BITS", 3)
    rows = documents(170)
    got = sharding.shards(frame(spark, rows), n_shards=n_shards).collect()
    assert len(got) == len(rows)
    sizes = Counter(r.shard for r in got)
    assert set(sizes) <= set(range(n_shards)) and max(sizes.values()) - min(sizes.get(s, 0) for s in range(n_shards)) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    key = lambda t: (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((d, *key(t)) for d, t, _, _ in rows)
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}
    assert sharding.shards(frame(spark, rows).limit(0)).count() == 0


def test_shards_against_a_plain_rebuilding(spark, monkeypatch):
    """The same blocks, matrix and orders by plain loops; reruns of other partitions agree."""
    monkeypatch.setattr(sharding, "_ROWS_PER_BLOCK", 16)
    rows = documents(300) + [(5, "again", "a", "x")] * 70
    df = frame(spark, rows)
    got = [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in sharding.shards(df, n_shards=6).collect()]
    copies, keyed = Counter(), []
    for d, t, _, _ in rows:
        copies[d, t or ""] += 1
        keyed.append((d, t or "", copies[d, t or ""]))
    h = lambda *c: F.xxhash64(*c)
    keys = spark.createDataFrame(keyed, "doc_id long, t string, c long").select("doc_id", "t", h(F.lit(23), "doc_id", h("t"), "c").alias("k"))
    keys = keys.select("*", h(F.lit(24), "k").alias("k1"), h(F.lit(25), "k").alias("k2")).collect()
    bits = (len(rows) // 16 - 1).bit_length()
    blocks = {}
    for r in keys:
        blocks.setdefault((r.k % 2**64) >> (64 - bits), []).append(r)
    counts = spark.createDataFrame([(b, len(x)) for b, x in blocks.items()], "_block long, n long")
    matrix = {r._block: r.caps for r in sharding.communication_matrix(counts, bits, len(rows), 6, 23).collect()}
    assert [sum(m[s] for m in matrix.values()) for s in range(6)] == [len(rows) // 6 + (s < len(rows) % 6) for s in range(6)]
    parts = [[] for _ in range(6)]
    for b, x in blocks.items():
        x.sort(key=lambda r: r.k1)
        assert sum(matrix[b]) == len(x)
        for s, n in enumerate(matrix[b]):
            parts[s] += x[:n]
            del x[:n]
    sub_bits = (max(1, len(rows) // 6 // 16) - 1).bit_length()
    place = lambda r: ((r.k2 % 2**64) >> (64 - sub_bits) if sub_bits else 0, r.k2)
    want = [(r.doc_id, len(r.t.encode()) + 16, zlib.crc32(r.t.encode()), s, i) for s, x in enumerate(parts) for i, r in enumerate(sorted(x, key=place))]
    assert sorted(got, key=str) == sorted(want, key=str)
    again = sharding.shards(df.repartition(7, "text"), n_shards=6).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
    assert sorted(map(tuple, again), key=str) == sorted(got, key=str)


def test_repeated_rows_spread_over_shards(spark):
    rows = [(1, "same text", "a", "x")] * 300 + [(i, f"t{i}", "a", "x") for i in range(2, 302)]
    got = sharding.shards(frame(spark, rows), n_shards=10).filter("doc_id = 1").groupBy("shard").count().collect()
    assert len(got) == 10 and max(r["count"] for r in got) < 60


def test_hypergeometric_has_its_moments(spark):
    for pop, good, drawn in ((50, 20, 12), (1000, 25, 500), (7, 7, 3), (9, 0, 4), (100000, 2500, 4096)):
        u = (F.col("id") + 0.5) / 2000
        k = [r.k for r in spark.range(2000).select(sharding.hypergeometric(F.lit(pop), F.lit(good), F.lit(drawn), u).alias("k")).collect()]
        p = good / pop
        assert max(0, drawn + good - pop) <= min(k) and max(k) <= min(good, drawn)
        assert abs(np.mean(k) - drawn * p) < 0.02 + 0.01 * drawn * p
        want = drawn * p * (1 - p) * (pop - drawn) / (pop - 1)
        assert abs(np.var(k) - want) < 0.05 + 0.05 * want
