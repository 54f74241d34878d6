import random

import numpy as np

from paceline.llm import licenses as lic
from tests.llm.test_decontaminate import words


def grams(text):
    w = words(text)
    return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]


def stands(text, template):
    """Whether all words of a short template follow each other."""
    w, want = words(text), words(template)
    return any(w[i : i + len(want)] == want for i in range(len(w)))


def brute(text):
    """Templates of which a stretch of one and a half lengths holds 0.8 of the shingles."""
    g, out = grams(text), set()
    for t, (_, template) in enumerate(lic.TEMPLATES):
        if len(words(template)) < 5:
            if stands(text, template):
                out.add(t)
            continue
        want, n = set(grams(template)), len(grams(template))
        at = [i for i, x in enumerate(g) if x in want]
        for i in at:
            if len({g[j] for j in at if i <= j < i + n + n // 2}) / len(want) >= 0.8 - 1e-9:
                out.add(t)
                break
    return out


def corpus(seed):
    rng = random.Random(seed)
    noise = lambda n: [rng.choice("alpha beta gamma the license software of under a".split()) for _ in range(n)]
    docs = []
    for i in range(250):
        w = noise(rng.randrange(0, 150))
        for _ in range(rng.randrange(0, 3)):
            t = rng.choice(lic.TEMPLATES)[1].split()
            for _ in range(rng.randrange(0, 3)):  # edits
                at = rng.randrange(len(t))
                t[at : at + rng.randrange(2)] = noise(rng.randrange(2))
            at = rng.randrange(len(w) + 1)
            w[at:at] = t
        docs.append((i, " ".join(w)))
    return docs + [(900, None), (901, ""), (902, "MIT"), (903, " ".join(noise(20000)) + " released under the MIT license")]


def test_against_all_stretches(spark):
    docs = corpus(1)
    df = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, licenses string")
    got = {r.doc_id: {m.template for m in r.licenses} for r in lic.scan(df).collect()}
    assert len(got) == len(docs)
    want = {d: brute(t or "") for d, t in docs}
    missed = sum(len(want[d] - got[d]) for d in want)
    assert sum(map(len, want.values())) > 100 and missed == 0
    assert all(got[d] <= want[d] for d in want)
    assert lic.scan(df.limit(0)).count() == 0


def test_report_names_and_places(spark):
    text = "x y\nReleased under the MIT License.\nmore Licensed under CC BY-NC 4.0. z"
    df = spark.createDataFrame([(1, text), (None, "no license here at all"), (1, text)], "doc_id long, text string")
    rows = sorted(lic.report(df).collect(), key=lambda r: str(r.doc_id))
    assert [tuple(r) for r in rows] == [(1, "CC-BY-NC-4.0,MIT", 2, 1.0)] * 2 + [(None, "", 0, None)]
    (first, second) = lic.scan(df).filter("doc_id = 1").first().licenses
    assert (first.first_word, first.last_word, second.first_word) == (2, 6, 8)


def test_retrieval_meets_its_promise():
    index = lic.Index(lic.TEMPLATES)
    rng = np.random.default_rng(1)
    t = int(np.argmax(index.sizes))
    want = lic._template_shingles(lic.TEMPLATES[t][1])
    for _ in range(40):
        s = rng.integers(0, 2**63, 900, dtype=np.uint64)
        at = int(rng.integers(0, 700))
        keep = rng.permutation(len(want))[: int(np.ceil(0.8 * len(want)))]
        s[at + keep] = want[keep]
        assert any(x[1] == t for x in index.matches(s, np.array([0, len(s)])))


def test_each_of_repeated_notices_is_a_match(spark):
    notice = "Released under the MIT License."
    long = next(t for n, t in lic.TEMPLATES if n == "ISC" and len(t) > 200)
    rows = [(1, " ".join([notice] * 7)), (2, " ".join([long] * 3)), (3, f"{long} {notice} SPDX-License-Identifier: MIT {long}"), (4, "spdx license\nIDENTIFIER isc"), (5, "SPDX-License-Identifier:"), (6, "x " * 50_000 + (notice + " ") * 4000)]
    got = {r.doc_id: (r.licenses, r.n_matches) for r in lic.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", 7), 2: ("ISC", 3), 3: ("ISC,MIT", 4), 4: ("ISC", 1), 5: ("", 0), 6: ("MIT", 4000)}
    places = lic.scan(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id = 3").first().licenses
    assert [m.license for m in places] == ["ISC", "MIT", "MIT", "ISC"] and all(a.last_word < b.first_word for a, b in zip(places, places[1:]))


def test_a_text_of_megabytes(spark):
    rng = random.Random(2)
    noise = lambda n: " ".join(f"{rng.choice('abc')}{rng.randrange(9999)}" for _ in range(n))
    long = next(t for n, t in lic.TEMPLATES if n == "BSD-3-Clause")
    df = spark.createDataFrame([(1, f"{noise(400_000)} {long} {noise(300_000)} {long}"), (2, noise(10))], "doc_id long, text string")
    assert {r.doc_id: (r.licenses, r.n_matches) for r in lic.report(df).collect()} == {1: ("BSD-3-Clause", 2), 2: ("", 0)}
