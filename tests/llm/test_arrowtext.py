import random

import numpy as np
import pyarrow as pa
import pytest

from paceline.llm import arrowtext as at
from tests.llm.test_decontaminate import words

ALPHABET = "aB9 \né#_ßZ\t漢."


def column(texts, kind=pa.string()):
    return at.column_bytes(pa.array(texts, kind))


@pytest.mark.parametrize("block", [4, 64, 4 << 20])
def test_words_and_their_hashes(monkeypatch, block):
    monkeypatch.setattr(at, "_BLOCK", block)
    rng = random.Random(block)
    texts = [None, "", "a", "漢字漢字漢字"] + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(200)] + ["b" * 300]
    data, off = column(texts)
    s, e, h, row = at.words(data, off)
    raw = data.tobytes()
    by_hash = {}
    for i, t in enumerate(texts):
        got = [raw[a:b].decode() for a, b in zip(s[row[i] : row[i + 1]], e[row[i] : row[i + 1]])]
        assert ["".join(c.lower() if c.isascii() else c for c in w) for w in got] == words(t)
        for w, x in zip(words(t), h[row[i] : row[i + 1]].tolist()):
            assert by_hash.setdefault(w, x) == x
    assert len(set(by_hash.values())) == len(by_hash)


@pytest.mark.parametrize("k", [1, 2, 5, 8])
def test_shingles_of_rows(k):
    rng = random.Random(k)
    texts = [" ".join(rng.choice("abc") for _ in range(n)) for n in [0, 1, 2, 4, 5, 6, 0, 9, 30, 0]]
    data, off = column(texts)
    _, _, h, row = at.words(data, off)
    s, o = at.shingles(h, row, k)
    seen = {}
    for i, t in enumerate(texts):
        w = t.split()
        want = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)] or ([tuple(w)] if w else [])
        got = s[o[i] : o[i + 1]].tolist()
        assert len(got) == len(want)
        for a, b in zip(want, got):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def test_columns_and_runs():
    for kind in (pa.string(), pa.large_string()):
        data, off = at.column_bytes(pa.array(["x", None, "yz", ""], kind).slice(1))
        assert data.tobytes() == b"yz" and off.tolist() == [0, 0, 2, 2]
    assert at.column_bytes(pa.array([], pa.string()))[1].tolist() == [0]
    assert at.column_bytes(pa.chunked_array([["ab"], ["c", None]]))[1].tolist() == [0, 2, 3, 3]
    assert list(at.runs(np.array([0, 5, 9, 30, 31, 31]), 10)) == [(0, 2), (2, 3), (3, 5)]
    batch = pa.record_batch({"text": ["aa", "b" * 50, "c"]})
    assert [(p.num_rows, d.tobytes()[:2], o.tolist()) for p, d, o in at.text_runs(iter([batch]), limit=10)] == [(1, b"aa", [0, 2]), (1, b"bb", [0, 50]), (1, b"c", [0, 1])]


def test_written_tables_can_be_dropped(spark):
    from paceline.llm.store import dropped, written
    from paceline.storage import shared_dir

    df = written(spark.range(5), "t")
    assert df.count() == 5 and df._written_path.startswith(shared_dir(spark))
    dropped(df)
    with pytest.raises(Exception):
        df.count()
