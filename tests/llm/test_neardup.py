import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paceline.llm import neardup
from tests.llm.test_decontaminate import words


def multiset(text):
    w = words(text)
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else Counter()


def similarity(a, b):
    low = sum((a & b).values())
    return low / (sum(a.values()) + sum(b.values()) - low)


def brute(rows):
    sets = [multiset(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and similarity(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    rows = [text(rng.randrange(1, 120)) for _ in range(80)]
    for base in (text(100), text(300), text(60)):
        for _ in range(40):  # copies at 0.6 to 1 of the base, most not near each other
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(w)
    chain = text(200)
    for _ in range(12):
        chain = chain[:]
        at = rng.randrange(180)
        chain[at : at + 3] = text(3)
        rows.append(chain)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    rows += [(1000 + i, rows[5][1].upper()) for i in range(5)] + [(2000, None), (2001, ""), (2002, "?!"), (2003, "a b"), (2004, "A, b"), (2005, "a b c"), (7, rows[7][1]), (7, rows[7][1]), (None, rows[8][1]), (None, "only here with a null id")]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, node string").repartition(3)


@pytest.mark.parametrize("seed, block", [(1, 1024), (2, 4)])
def test_classes_against_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(neardup, "_BLOCK", block)
    monkeypatch.setattr(neardup, "_NODES", 30)
    monkeypatch.setattr(neardup, "_CELL_ROWS", 50)
    rows = corpus(seed)
    got = sorted(((r.doc_id, r.class_id) for r in neardup.report(frame(spark, rows)).collect()), key=str)
    assert got == brute(rows)


def test_one_row_of_each_class_stays(spark):
    rows = corpus(3)
    df = frame(spark, rows)
    out = neardup.deduplicated(df)
    assert out.columns == df.columns
    want = brute(rows)
    classes = {c for d, c in want if c is not None and d not in (2000, 2001, 2002)}
    got = [r.doc_id for r in out.collect()]
    assert sorted(x for x in got if x is not None and x < 2000 or x in (2003, 2005)) == sorted(classes)
    assert Counter(got)[None] == 1 and {2000, 2001, 2002} <= set(got)
    assert neardup.deduplicated(df.limit(0)).count() == 0 and neardup.report(df.limit(0)).count() == 0


def test_other_texts_under_null_or_repeated_ids_all_stay(spark):
    text = lambda i: " ".join(f"t{i}x{j}" for j in range(20))
    rows = [(None, text(i)) for i in range(6)] + [(7, text(10)), (7, text(11)), (8, text(11)), (None, text(2)), (None, text(10)), (9, None)]
    got = [(r.doc_id, r.text) for r in neardup.deduplicated(frame(spark, rows)).collect()]
    assert Counter(got) == Counter([(None, text(i)) for i in range(6)] + [(7, text(10)), (7, text(11)), (9, None)])


def test_hot_groups_are_split_and_columns_may_clash(spark, monkeypatch):
    """Thousands of repeated rows, exact and near copies; the caller's columns have the operator's names."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    near = lambda i: " ".join(base[:60] + [f"x{i}"] + base[61:])
    rows = [(i, near(i)) for i in range(300)] + [(1000 + i, " ".join(base)) for i in range(1500)] + [(9, near(9))] * 700 + [(None, None)] * 400 + [(4000, "alone with own words here")]
    monkeypatch.setattr(neardup, "_BLOCK", 64)
    monkeypatch.setattr(neardup, "_SALTS", 5)
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, node string").repartition(5)
    for n in ("_name", "_hash", "_n", "_most", "name", "Hash", "root", "class_id"):
        df = df.withColumn(n, F.lit(n))
    out = neardup.deduplicated(df)
    assert out.columns == df.columns
    got = out.collect()
    assert Counter(r.doc_id for r in got) == Counter({0: 1, 4000: 1, None: 400})
    assert all(r[n] == n for r in got for n in ("_name", "_hash", "_most", "Hash", "class_id"))
    assert {r.class_id for r in neardup.report(df.filter("doc_id < 4000")).collect()} == {0}


def test_long_chains_end_in_one_component(spark):
    """A path whose least node is at its end, and a star."""
    name = lambda i: i.to_bytes(4, "big")
    order = list(range(400))
    random.Random(2).shuffle(order)
    edges = [(name(a), name(b)) for a, b in zip(order, order[1:])] + [(name(5000), name(i)) for i in range(5001, 5600)]
    got = {r.node: r.root for r in neardup.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert {bytes(got[name(i)]) for i in order} == {name(0)} and {bytes(got[name(i)]) for i in range(5000, 5600)} == {name(5000)}


def test_every_pair_at_the_threshold_is_found_on_whole_tables(spark):
    """Recall at 0.8 on the given documents, against all pairs that share a shingle."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no tables here")
    docs = spark.read.parquet(path).select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets, where = [multiset(t) for _, t in rows], {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    near = {(a, b) for x in where.values() if len(x) < 60 for a in x for b in x if a < b}
    links = [(a, b) for a, b in near if similarity(sets[a], sets[b]) >= 0.8]
    of = {r.doc_id: r.class_id for r in neardup.report(docs).collect()}
    assert len(links) > 50 and all(of[rows[a][0]] == of[rows[b][0]] for a, b in links)
    linked = {rows[i][0] for pair in links for i in pair}
    assert all(of[d] == d for d, _ in rows if d not in linked)  # and nothing else is linked


def test_signatures_estimate_the_weighted_similarity():
    rng = np.random.default_rng(0)
    elements = rng.integers(0, 2**63, 40, dtype=np.uint64)
    a, b = rng.uniform(0, 3, 40), rng.uniform(0, 3, 40)
    a[:10] = 0
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    row = np.repeat([0, 1], 40)
    w = np.concatenate([a, b])
    on = w > 0
    sig = neardup.dart_signatures(row[on], np.tile(elements, 2)[on], w[on], 3, 4000)
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04
    assert (sig[2] == neardup._NOTHING).all() and (sig[:2] != neardup._NOTHING).all()
    alone = neardup.dart_signatures(np.zeros(40, int)[b > 0], elements[b > 0], b[b > 0], 1, 4000)
    assert (alone[0] == sig[1]).all()


def test_texts_of_megabytes(spark):
    rng = random.Random(4)
    words_ = [f"w{rng.randrange(10**6)}" for _ in range(500_000)]
    edited = list(words_)
    for _ in range(4000):  # a similarity of about 0.92
        edited[rng.randrange(len(edited))] = "edited"
    far = list(words_)
    for _ in range(60_000):
        far[rng.randrange(len(far))] = "far"
    rows = [(5, " ".join(words_)), (3, " ".join(edited)), (2, " ".join(far)), (9, " ".join(words_).upper())]
    got = {r.doc_id: r.class_id for r in neardup.report(frame(spark, rows)).collect()}
    assert got == {5: 3, 3: 3, 9: 3, 2: 2}
