import hashlib
import random
import re

from paceline.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, n=8):
    windows = {}
    for key, text in items:
        w = words(text)
        m = min(n, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add("" if key is None else str(key))
    out = {}
    for key, text in docs:
        w, hit, ids = words(text), set(), set()  # a null id counts, and has no name
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in windows:
                    hit |= set(range(i, i + m))
                    ids |= windows[tuple(w[i : i + m])]
        out[key] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids - {""})).encode()).hexdigest(), len(ids) >= 2)
    return out


def fixture(seed, vocab):
    rng = random.Random(seed)
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 7, 8, 9, 30]) if i else 40)) for i in range(25)] + [(25, None), (26, "..."), (3, "Straße 9x"), (None, text(9)), (None, text(20)), (None, None)]
    docs = []
    for i in range(120):
        parts = [text(rng.randrange(0, 90))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(items)[1] or "", text(rng.randrange(0, 5))]
        docs.append((i, "!!".join(parts).upper() if i % 3 else ", ".join(parts)))
    return docs + [(200, None), (201, ""), (202, "STRASSE straße 9X"), (203, text(30000)), (204, docs[0][1]), (None, docs[1][1])], items


def got(spark, docs, items, **options):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, contamination string")
    b = spark.createDataFrame([(*r, "y") for r in items], "item_id long, text string, k string")
    return {r.doc_id: tuple(r[1:]) for r in dc.report(d, b, **options).collect()}


def test_against_brute_force(spark):
    for seed, vocab in ((1, [f"w{i}" for i in range(400)]), (2, ["a", "b", "c1", "é"])):
        docs, items = fixture(seed, vocab)
        want = brute(docs, items)
        assert got(spark, docs, items) == want
        assert got(spark, docs, items, block_bytes=600) == want  # several passes
    assert any(x[4] for x in want.values())


def test_suffix_block_without_an_occurrence(spark):
    assert got(spark, [(1, "x x x x x six seven eight")], [(1, "one two three four five six seven eight")]) == {1: (8, 0, 0, hashlib.sha256(b"").hexdigest(), False)}


def test_clean_documents_stay_with_their_columns(spark):
    docs, items = fixture(3, [f"w{i}" for i in range(300)])
    d = spark.createDataFrame([(*r, i, "own", "too") for i, r in enumerate(docs)], "doc_id long, text string, item_id int, _contamination string, Contamination string")
    b = spark.createDataFrame(items, "item_id long, text string")
    long = [x for x in items if len(words(x[1])) >= 5]  # shorter items are no passages
    for min_items in (1, 2):
        kept = dc.decontaminated(d, b, min_items=min_items).collect()
        want = brute(docs, long)
        assert sorted(str(r.doc_id) for r in kept) == sorted(str(k) for k, v in want.items() if v[2] < min_items)
        assert list(kept[0].asDict()) == d.columns and {r["_contamination"] for r in kept} == {"own"}
    assert dc.report(d, b.limit(0)).filter("n_hit > 0 or contaminated").count() == 0
    assert dc.report(d.limit(0), b).count() == 0


def test_a_text_full_of_occurrences(spark):
    item = " ".join(f"w{i}" for i in range(8))
    docs = [(1, " ".join([item] * 20000) + " Tail"), (2, "w0 w1 w2"), (3, ("x" * 3_000_000) + " " + item)]
    assert got(spark, docs, [(7, item), (8, "Tail " + item)]) == brute(docs, [(7, item), (8, "Tail " + item)])
