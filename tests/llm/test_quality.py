import random

import numpy as np
from pyspark.sql import functions as F

from paceline.llm import quality


def plain(text):
    """A few statistics the long way."""
    raw = text.encode()

    lines = [x for x in text.split("\n") if x]
    return {
        "upper": sum(65 <= b <= 90 for b in raw) / max(1, len(raw)), "digit": sum(48 <= b <= 57 for b in raw) / max(1, len(raw)),
        "bang": raw.count(b"!") / max(1, len(raw)), "other": sum(b >= 128 for b in raw) / max(1, len(raw)),
        "distinct_lines": len(set(x.lower() if x.isascii() else x for x in lines)) / max(1, len(lines)), "log_bytes": np.log1p(len(raw)),
    }


def test_statistics_against_plain_counts():
    rng = random.Random(4)
    texts = ["", "a", "a a a b", "AB!!\nAB!!\nx9 é", "\n\n", "one two\n" * 50] + ["".join(rng.choice("aB9 !\né#") for _ in range(rng.randrange(80))) for _ in range(60)]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    x = quality.statistics(data, off)
    at = {n: i for i, n in enumerate(quality.STATISTICS)}
    for t, row in zip(texts, x):
        want = plain(t)
        for name in ("upper", "digit", "bang", "other", "log_bytes"):
            assert abs(row[at[name]] - want[name]) < 1e-12, (t, name)
    assert x[2][at["repeated_word"]] == 2 / 4 and x[2][at["distinct_words"]] == 0.5 and x[5][at["distinct_lines"]] == 1 / 50
    assert not x[0].any()


def test_isotonic_is_the_least_squares_fit():
    assert np.allclose(quality.isotonic(np.ones(5), np.array([1, 0, 2, 3, 2.0])), [0.5, 0.5, 2, 2.5, 2.5])
    assert np.allclose(quality.isotonic(np.array([3, 1.0]), np.array([1, 0.0])), [0.75, 0.75])


def test_held_out_scores_and_edge_cases(spark):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        w = [rng.choice(["tree", "river", "house", "of", "the", "stone"]) for _ in range(rng.randrange(5, 80))]
        docs.append((i, " ".join(w) + "." if good else "!! ".join(w).upper() + " ###", "c"))
        if i % 3:
            labels.append((i, int(good)))
    docs += [(1000, None, "c"), (1001, "", "c"), (None, "the tree", "c"), (1002, "the " * 50000, "c"), (7, docs[7][1], "c")]
    labels += [(5000, 1), (4, None), (None, 0)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    got = quality.report(d, lab).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    held = [(r.score, y) for i, y in labels if y is not None and i in by and (r := by[i]).held_out]
    assert len(held) > 40 and np.mean([(s >= 0.3) == y for s, y in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert not by[None].held_out and {r.score for r in got if r.doc_id == 7} == {by[7].score}
    assert quality.report(d.limit(0), lab).count() == 0
    assert all(r.predicted == 1 for r in quality.report(d, lab.filter("quality = 1")).collect())


def test_the_fit_against_one_in_memory(spark):
    """Features, ridge and calibration from all rows at once, against partition sums and binned counts."""
    rng = np.random.default_rng(3)
    k = len(quality.STATISTICS)
    x = rng.normal(0, 1, (900, k)) * np.arange(1, k + 1)
    y = (x[:, 0] + 0.3 * x[:, 1] + rng.normal(0, 0.1, 900) > 0).astype(float)
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]], float(y[i])) for i in range(900)], "doc_id long, statistics array<double>, y double").repartition(5)
    model = quality.fit(rows, F.col("doc_id") % 5 == 0)
    apart = np.arange(900) % 5 == 0
    learn, held = x[~apart], x[apart]
    assert np.allclose(model.mean, learn.mean(0)) and np.allclose(model.scale, learn.std(0))
    kernel = lambda a: np.sqrt(2 / quality._FEATURES) * np.cos(np.clip((a - learn.mean(0)) / learn.std(0), -5, 5) @ model.directions + model.phases)
    a, b = learn[:80] / learn.std(0) - learn.mean(0) / learn.std(0), kernel(learn[:80])
    exact = np.exp(-((a[:, None] - a[None]) ** 2).sum(2) / (2 * 4.0**2))
    assert np.abs(b @ b.T - exact).max() < 0.3  # the features' products are a Gaussian kernel, nearly
    design = np.hstack([kernel(learn), np.ones((len(learn), 1))])
    penalty = np.diag([1.0] * quality._FEATURES + [1e-6])
    want = np.linalg.lstsq(design.T @ design + penalty, design.T @ y[~apart], rcond=None)[0]
    assert np.allclose(design @ model.ridge, design @ want, atol=1e-6)
    got = {r.doc_id: r.score for r in quality.score(rows, model).collect()}
    raw = np.hstack([kernel(held), np.ones((len(held), 1))]) @ want
    order = np.argsort(raw)
    ranked = np.array([got[i] for i in np.arange(900)[apart]])[order]
    assert (np.diff(ranked) >= 0).all() and ((ranked >= 0.5) == y[apart][order]).mean() > 0.85
