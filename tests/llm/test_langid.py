import random
import re

import numpy as np

from paceline.llm import langid

FIXED = {"aa": ["kato", "miru", "tan", "suké"], "bb": ["thorn", "wulf", "grund", "ßar"], "cc": ["oxy", "zeph", "qir"]}


def documents(n=240, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(FIXED))
        rows.append((i, " ".join(rng.choice(FIXED[lang]) + rng.choice(["", ",", "!"]) for _ in range(rng.randrange(2, 60))), lang))
    return rows


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(0)
    model = langid._new_model(["a", "b", "c"], 3, 1)
    w = {k: v.astype(np.float64) for k, v in model.weights.items()}
    length = np.array([6, 4, 4, 1])
    codes = rng.integers(0, 30, (4, 6))
    label = np.array([0, 2, 1, 1])
    _, g = langid._gradients(w, codes, length, label)
    for k in w:
        for at in [tuple(rng.integers(0, s) for s in w[k].shape) for _ in range(4)]:
            at = (int(codes[0, 1]), *at[1:]) if k[0] == "x" else at
            old, vals = w[k][at], []
            for step in (1e-3, -1e-3):
                w[k][at] = old + step
                vals.append(langid._gradients(w, codes, length, label)[0])
            w[k][at] = old
            assert abs((vals[0] - vals[1]) / 2e-3 - g[k][at]) < 1e-4, k


def test_positions_equal_a_plain_forward_pass():
    model = langid._new_model(["a", "b"], 4, 2)
    data = np.frombuffer(b"heisenbergxy" + "é".encode() * 60, np.uint8)
    sums = langid._piece_sums(model, data, np.array([0, 10, 12]), np.array([10, 12, len(data)]))
    w = model.weights

    def plain(piece):
        codes = [int(langid.CODE[x]) for x in piece]
        out = np.tile(w["o"], (len(codes), 1))
        for d in "fb":
            h = np.zeros((1, 4), np.float32)
            for t in range(len(codes)) if d == "f" else range(len(codes) - 1, -1, -1):
                h = langid._step(w["x" + d][codes[t]][None], h, w["u" + d], w["c" + d])[0]
                out[t] += (h @ w["o" + d])[0]
        p = np.exp(out) / np.exp(out).sum(1, keepdims=True)
        return np.concatenate([np.log(p).sum(0), p.sum(0), [len(codes)]])

    raw = data.tobytes()
    long = [raw[12 + i : 12 + i + langid.PIECE] for i in range(0, len(raw) - 12, langid.PIECE)]
    for got, want in zip(sums, (plain(raw[:10]), plain(raw[10:12]), sum(map(plain, long)))):
        assert np.allclose(got, want, atol=1e-4)


def test_held_out_accuracy_and_edge_cases(spark):
    rows = documents()
    more = [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 €€ !", "cc"), (1003, "kato " * 30000, None), (None, "thorn wulf", None), (1004, "x" * 5000, None), (1005, "KATO MIRU", None)]
    df = spark.createDataFrame([(*r, "s") for r in rows + more], "doc_id long, text string, lang string, language string")
    got = {r.doc_id: r for r in langid.report(df).collect()}
    assert len(got) == len(rows) + len(more)
    held = [(got[i].lang_pred, lang) for i, _, lang in rows if got[i].held_out]
    assert len(held) > 30 and sum(a == b for a, b in held) / len(held) >= 0.97
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert got[1003].lang_pred == "aa" and got[None].lang_pred == "bb" and not got[None].held_out and got[1005].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.identified(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} >= {r[0] for r in rows} - {1000, 1001, 1002}
    assert kept.filter("doc_id in (1000, 1001, 1002)").count() == 0
    assert langid.report(df.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, "kato")], "doc_id long, text string").selectExpr("*", "cast(null as string) lang")
    assert [(r.lang_pred, r.score) for r in langid.report(nothing).collect()] == [("und", 0.0)]


def plain_prediction(model, text):
    """Language and score by loops over bytes: the network as its definition reads."""
    w, k = model.weights, model.hidden
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    total, share, n = np.zeros(len(model.languages)), np.zeros(len(model.languages)), 0
    for run in re.findall(rb"[a-z\x80-\xff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()):
        for at in range(0, len(run), langid.PIECE):
            codes = [langid.CODE[b] for b in run[at : at + langid.PIECE]]
            logits = np.zeros((len(codes), len(model.languages))) + w["o"]
            for d in "fb":
                h = np.zeros(k)
                for t in range(len(codes)) if d == "f" else reversed(range(len(codes))):
                    x, a = w["x" + d][codes[t]], h @ w["u" + d]
                    r, z = sigmoid(x[:k] + a[:k]), sigmoid(x[k : 2 * k] + a[k : 2 * k])
                    new = np.tanh(x[2 * k :] + r * (a[2 * k :] + w["c" + d]))
                    h = (1 - z) * new + z * h
                    logits[t] += h @ w["o" + d]
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            total, share, n = total + np.log(p).sum(0), share + p.sum(0), n + len(codes)
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    best = int(total.argmax())
    return model.languages[best], share[best] / n


def test_predictions_against_plain_loops(spark):
    rows = documents(60, seed=9)
    docs = spark.createDataFrame([*((i, t, lang, "s") for i, t, lang in rows), (900, None, None, "s"), (901, "€ 12", None, "s"), (902, "Éa" + "b" * 95 + " KATO 9", None, "s")], "doc_id long, text string, lang string, language string")
    model = langid.train(docs, steps=60)
    for r in langid.predict(docs, model).collect():
        lang, score = plain_prediction(model, r.text)
        assert r.language.lang == lang and abs(r.language.score - score) < 1e-4, r


def test_columns_named_like_the_operators_stay(spark):
    df = spark.createDataFrame([(i, "kato miru", "aa", "own") for i in range(8)] + [(9, None, "aa", "own")], "doc_id long, text string, lang string, _language string").selectExpr("*", "1 as Language", "2 as language_")
    out = langid.identified(df)
    assert out.columns == df.columns and {(r["_language"], r["Language"], r["language_"]) for r in out.collect()} == {("own", 1, 2)} and out.count() == 8


def test_every_label_is_learned(spark):
    rows = [(i, f"kato {'abcdefghijklmnopqrst'[i % 20] * 3}", f"l{i % 400:03}") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    model = langid.train(df, steps=2)
    assert model.languages == sorted({r[2] for r in rows})
    assert {r.language.lang for r in langid.predict(df, model).collect()} <= set(model.languages)


def test_a_low_score_drops_no_document(spark):
    rows = [(i, "kato miru tan", f"l{i % 6}") for i in range(120)]
    more = [(500, None, "l1"), (501, "12 !", "l1")]
    df = spark.createDataFrame(rows + more, "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in langid.identified(df).collect()) == list(range(120))


def test_every_letter_position_has_a_label():
    model = langid._new_model(["a", "b"], 4, 2)
    text = "heisenberg, " + "é" * 45 + " 12 x"
    spans = langid.label_positions(text, model)
    covered = sorted(i for a, b, _ in spans for i in range(a, b))
    raw = text.encode()
    assert covered == [i for i, x in enumerate(raw) if langid.LETTER_BYTE[x]] and {k for *_, k in spans} <= {"a", "b"}
    assert langid.label_positions("12 !", model) == []
