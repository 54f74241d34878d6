import hashlib
import random
import re
from collections import Counter

import pytest

from paceline.llm import suffixdedup


def brute(rows, length):
    raw = [(t or "").encode() for _, t in rows]
    count = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for (doc, _), x in zip(rows, raw):
        gone = [False] * len(x)
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((doc, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, alphabet, longest):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    shared = [text(rng.randrange(5, longest)) for _ in range(6)]
    rows = []
    for i in range(70):
        parts = []
        for _ in range(rng.randrange(4)):
            parts += [text(rng.randrange(longest)), rng.choice(shared)]
        rows.append((i, "".join(parts)))
    base = text(3 * longest)
    for i in range(25):  # near copies
        at = rng.randrange(len(base))
        rows.append((100 + i, base[:at] + rng.choice(alphabet) + base[at + 1 :]))
    rows += [(200 + i, rows[3][1]) for i in range(4)] + [(3, rows[3][1]), (None, rows[5][1]), (None, rows[6][1]), (300, None), (301, ""), (302, "ab" * longest), (303, "x" * 2 * longest)]
    rng.shuffle(rows)
    return rows


def brute_passages(rows, length):
    split = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for _, t in rows]
    where = {}
    for k, w in enumerate(split):
        for i in range(len(w) - length + 1):
            where.setdefault(tuple(w[i : i + length]), set()).add(k)
    out = []
    for (doc, _), w in zip(rows, split):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if len(where[tuple(w[i : i + length])]) > 1:
                gone[i : i + length] = [True] * length
        out.append((doc, len(w), sum(gone), sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))))
    return sorted(out, key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, b"c") for r in rows], "doc_id long, text string, payload binary").repartition(3)
    return sorted((tuple(r) for r in suffixdedup.removed(df, **options).collect()), key=str)


@pytest.mark.parametrize("length, alphabet, longest", [(16, "abcd", 60), (40, "abcdefgé ", 120), (400, "abcdefgh ", 1300), (400, "ab", 900)])
def test_against_brute_force(spark, length, alphabet, longest):
    rows = corpus(length, alphabet, longest)
    assert run(spark, rows, length=length) == brute(rows, length)


def test_repeated_rows_come_out_as_often_as_they_went_in(spark):
    rng = random.Random(6)
    text = lambda: "".join(rng.choice("abcdefgh ") for _ in range(1500))
    near = lambda t: t[:700] + "#" + t[701:]
    one, other = text(), text()
    rows = [(1, one)] * 3 + [(None, other)] * 2 + [(2, near(one)), (None, near(other)), (3, text()), (3, "short"), (3, "short")]
    assert run(spark, rows) == brute(rows, 400)


def test_many_batches_and_no_rows(spark, monkeypatch):
    rows = corpus(9, "abcdefgh ", 900)
    monkeypatch.setattr(suffixdedup, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(suffixdedup, "_PACK_BYTES", 2000)
    monkeypatch.setattr(suffixdedup, "_PIECE", 700)  # all but the shortest texts are cut
    assert run(spark, rows) == brute(rows, 400)
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffixdedup.removed(df).collect() == []


def test_a_text_of_many_pieces(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    shared = text(900)
    rows = [(1, text(400_000) + shared + text(100_000)), (2, text(300) + shared), (3, text(50_000) * 2), (4, text(399))]
    monkeypatch.setattr(suffixdedup, "_PIECE", 30_000)
    assert run(spark, rows) == brute(rows, 400)


@pytest.mark.parametrize("length, vocabulary", [(50, 400), (50, 3), (12, 30), (5, 8)])
def test_passages_against_brute_force(spark, length, vocabulary):
    rng = random.Random(length)
    text = lambda n: "".join(f"{rng.choice('Ww')}{rng.randrange(vocabulary)}{rng.choice([' ', ', ', chr(10)])}" for _ in range(n))
    shared = [text(n) for n in (length - 1, length, length + 1, 2 * length, 4 * length)]
    rows = [(i, text(rng.randrange(2 * length)) + rng.choice(shared) + text(rng.randrange(2 * length))) for i in range(40)]
    rows += [(100, text(2 * length) * 3), (101, None), (102, ""), (103, rows[0][1]), (None, rows[1][1]), (None, None), (7, text(length - 1)), (104, rows[2][1].upper())]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, size string").repartition(3)
    assert sorted((tuple(r) for r in suffixdedup.passages(df, length=length).collect()), key=str) == brute_passages(rows, length)
    if vocabulary == 400:
        told = {(r.doc_id, r.n_bytes): r.n_passage_words for r in suffixdedup.report(df).collect()}
        words = {(d, len((t or "").encode())): w[2] for (d, t), w in zip(sorted(rows, key=lambda r: str(r[0])), sorted(brute_passages(rows, length), key=lambda r: str(r[0])))}
        assert {k: v for k, v in told.items() if k[0] is not None} == {k: v for k, v in words.items() if k[0] is not None}


def test_buckets_follow_the_identifiers_not_the_partitions(spark, monkeypatch):
    from paceline.llm import repeats

    rows = corpus(11, "abcdefgh ", 900)
    monkeypatch.setattr(repeats, "_PER_BUCKET", 64)
    table = spark.createDataFrame([(1, 5000, b"")], repeats.BATCH)
    assert repeats.buckets_of(table) == 157  # 5000 identifiers, each as a span and as a core
    assert run(spark, rows) == brute(rows, 400)


def test_equal_identifiers_with_other_checks_are_no_match():
    import numpy as np

    from paceline.llm import repeats

    same = np.array([5, 5, 9], np.uint64)
    one = {"span": same, "check": np.array([1, 2, 3], np.uint64), "core": same}
    spans, checks, *_, cores, _, several = repeats._entries(one)
    assert len(spans) == 3 and cores.tolist() == [5, 9]
    sent = [repeats._packed([np.array([7], np.uint64), np.array([c], np.uint64), np.array([1]), *([np.zeros(0)] * 3)]) for c in (1, 2, 1)]
    flags = [x[0][0] for x in repeats._judged(sent)]
    assert [f & 3 for f in flags] == [3, 0, 1] and [f >> 2 for f in flags] == [2, 0, 2]  # twice: two half steps of the logarithm
