"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a piece, a run of letter bytes of at most PIECE bytes, in both directions
and gives each of its positions a distribution over languages; a document pools the
positions of all its pieces.  State starts anew with each piece, so a piece's result depends
on its bytes alone: each distinct piece of a run of rows is computed once, and whole texts
are read at the cost of their distinct pieces.  Trained in numpy by backpropagation through time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrowtext import WORD_BYTE, text_runs, words
from .store import unused

UNKNOWN = "und"
PIECE = 40
_RUN_BYTES = 3 << 20
_CACHE = 400_000

LETTER_BYTE = WORD_BYTE.copy()
LETTER_BYTE[0x30:0x3A] = 0
#: network input code of a lower-cased letter byte: a-z, then the bytes of non-ASCII characters
CODE = np.zeros(256, np.int64)
CODE[0x61:0x7B] = np.arange(26)
CODE[0x80:] = np.arange(26, 154)
N_CODES = 154


@dataclass
class Model:
    """languages in the order of the outputs; weights by name. x*: a row of gate inputs for each byte code; gates: reset, update, new."""

    languages: list[str]
    weights: dict[str, np.ndarray]

    @property
    def hidden(self) -> int:
        return self.weights["uf"].shape[0]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _step(x: np.ndarray, h: np.ndarray, u: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of the gated unit: new state and what the way back needs."""
    k = h.shape[1]
    a = h @ u
    rz = _sigmoid(x[:, : 2 * k] + a[:, : 2 * k])
    r, z = rz[:, :k], rz[:, k:]
    q = a[:, 2 * k :] + c
    n = np.tanh(x[:, 2 * k :] + r * q)
    return n + z * (h - n), r, z, q, n


def _new_model(languages: list[str], hidden: int, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    w = {}
    for d in "fb":
        w["x" + d] = rng.normal(0, 0.3, (N_CODES, 3 * hidden))
        w["u" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        w["c" + d] = np.zeros(hidden)
        w["o" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, len(languages)))
    w["o"] = np.zeros(len(languages))
    return Model(languages, {k: v.astype(np.float32) for k, v in w.items()})


def _gradients(w: dict[str, np.ndarray], codes: np.ndarray, length: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss and its gradients for padded pieces (rows by length, descending), through time in both directions."""
    n, t_max = codes.shape
    k = w["uf"].shape[0]
    live = np.array([(length > t).sum() for t in range(t_max)])
    back = np.take_along_axis(codes, np.maximum(length[:, None] - 1 - np.arange(t_max), 0), 1)
    logits = np.zeros((n, t_max, len(w["o"])), np.float32) + w["o"]
    tape = {}
    position = length[:, None] - 1 - np.arange(t_max)
    for d, order in (("f", codes), ("b", back)):
        h, tape[d] = np.zeros((n, k), np.float32), []
        for t in range(t_max):
            m = live[t]
            new, *rest = _step(w["x" + d][order[:m, t]], h[:m], w["u" + d], w["c" + d])
            tape[d].append((h[:m].copy(), new, *rest))
            h[:m] = new
            at = t if d == "f" else position[:m, t]
            logits[np.arange(m), at] += new @ w["o" + d]
    mask = np.arange(t_max) < length[:, None]
    p = np.exp(logits - logits.max(2, keepdims=True))
    p /= p.sum(2, keepdims=True)
    total = mask.sum()
    right = np.take_along_axis(p, label[:, None, None].repeat(t_max, 1), 2)[..., 0]
    loss = float(-(np.log(right + 1e-9) * mask).sum() / total)
    p[np.arange(n)[:, None], np.arange(t_max), label[:, None]] -= 1
    p *= mask[..., None] / total
    g = {key: np.zeros_like(v) for key, v in w.items()}
    g["o"] = p.sum((0, 1))
    for d, order in (("f", codes), ("b", back)):
        dh = np.zeros((n, k), np.float32)
        for t in range(t_max - 1, -1, -1):
            m = live[t]
            h, new, r, z, q, cand = tape[d][t]
            out = p[np.arange(m), t if d == "f" else position[:m, t]]
            g["o" + d] += new.T @ out
            dnew = dh[:m] + out @ w["o" + d].T
            dn = dnew * (1 - z) * (1 - cand * cand)
            dz = dnew * (h - cand) * z * (1 - z)
            dr = dn * q * r * (1 - r)
            da = np.concatenate([dr, dz, dn * r], 1)
            np.add.at(g["x" + d], order[:m, t], np.concatenate([dr, dz, dn], 1))
            g["u" + d] += h.T @ da
            g["c" + d] += (dn * r).sum(0)
            dh[:m] = dnew * z + da @ w["u" + d].T
    return loss, g


def _padded(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(x) for x in pieces])
    out = np.zeros((len(pieces), length.max()), np.int64)
    for i, x in enumerate(pieces):
        out[i, : len(x)] = CODE[np.frombuffer(x, np.uint8)]
    return out, length


def fit(pieces: list[bytes], label: np.ndarray, languages: list[str], *, hidden: int = 12, steps: int = 500, batch: int = 384, rate: float = 0.02, seed: int = 5) -> Model:
    """A network trained by Adam on pieces of lower-cased letter bytes and their languages' numbers, languages drawn evenly."""
    model, rng = _new_model(languages, hidden, seed), np.random.default_rng(seed + 1)
    w = model.weights
    if len(languages) < 2 or not pieces:
        return model
    by = [np.flatnonzero(label == i) for i in range(len(languages))]
    by = [x for x in by if len(x)]
    m1, m2 = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        now = by if len(by) <= batch else [by[i] for i in rng.choice(len(by), batch, replace=False)]
        pick = np.concatenate([rng.choice(x, max(1, batch // len(by))) for x in now])
        pick = pick[np.argsort([-len(pieces[i]) for i in pick], kind="stable")]
        codes, length = _padded([pieces[i] for i in pick])
        _, g = _gradients(w, codes, length, label[pick])
        lr = rate * min(1.0, step / 20) * (1 - 0.95 * step / steps)
        for k in w:
            m1[k] += 0.1 * (g[k] - m1[k])
            m2[k] += 0.01 * (g[k] * g[k] - m2[k])
            w[k] = (w[k] - lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def positions(model: Model, codes: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of all positions of pieces (start, length into codes; by length, descending), and each piece's first row in them."""
    w, k, t_max = model.weights, model.hidden, int(length[0])
    base = np.concatenate([[0], np.cumsum(length)])
    logits = np.zeros((base[-1], len(model.languages)), np.float32) + w["o"]
    live = np.searchsorted(-length, -np.arange(t_max), "left")  # pieces longer than t
    for d in "fb":
        h = np.zeros((len(start), k), np.float32)
        for t in range(t_max):
            m = live[t]
            at = np.full(m, t) if d == "f" else length[:m] - 1 - t
            h[:m] = _step(w["x" + d][codes[start[:m] + at]], h[:m], w["u" + d], w["c" + d])[0]
            logits[base[:m] + at] += h[:m] @ w["o" + d]
    logits -= logits.max(1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(1, keepdims=True)), base[:-1]


def _piece_sums(model: Model, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Per run of letters: summed log probabilities and summed probabilities of its positions, and their number."""
    n_cut = -(-(e - s) // PIECE)
    of = np.repeat(np.arange(len(s)), n_cut)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n_cut) - n_cut, n_cut)
    start = s[of] + k * PIECE
    length = np.minimum(PIECE, e[of] - start)
    order = np.argsort(-length, kind="stable")
    codes = CODE[LETTER_BYTE[data]]
    n_lang = len(model.languages)
    out = np.zeros((len(s), 2 * n_lang + 1))
    block = min(16384, max(256, (1 << 18) // n_lang))
    for at in range(0, len(order), block):
        part = order[at : at + block]
        logp, base = positions(model, codes, start[part], length[part])
        sums = np.concatenate([np.add.reduceat(logp, base, axis=0), np.add.reduceat(np.exp(logp), base, axis=0), length[part][:, None]], 1)
        np.add.at(out, of[part], sums)
    return out


def _few(limit: int, n_lang: int) -> int:
    """The limit for up to 16 languages; for more, so much less that results of as many numbers stay."""
    return limit * 16 // max(16, n_lang)


class _Pool:
    """Pooled sums of rows; results of pieces already seen stay, up to _CACHE of them (fewer for over 16 languages, so memory does not follow their number)."""

    def __init__(self, model: Model):
        self.model, self.keys, self.values = model, np.zeros(0, np.uint64), np.zeros((0, 2 * len(model.languages) + 1))

    def rows(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        s, e, h, row = words(data, off, LETTER_BYTE)
        out = np.zeros((len(off) - 1, self.values.shape[1]))
        if not len(h):
            return out
        keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        values = np.empty((len(keys), out.shape[1]))
        values[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            values[new] = _piece_sums(self.model, data, s[first[new]], e[first[new]])
            short = new[(e - s)[first[new]] <= PIECE]
            if len(self.keys) + len(short) > _few(_CACHE, len(self.model.languages)):
                self.keys, self.values = keys, values
            else:
                at = np.searchsorted(self.keys, keys[short])
                self.keys, self.values = np.insert(self.keys, at, keys[short]), np.insert(self.values, at, values[short], axis=0)
        full = np.flatnonzero(np.diff(row))
        out[full] = np.add.reduceat(values[inverse], row[:-1][full], axis=0)
        return out


def _letters(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = 400, sample_pieces: int = 60, **options) -> Model:
    """A model of all languages in `lang` (rows with null there are not learned from).

    Learns from a bounded sample: about sample_docs rows of each language, by hash of `key`, and of each row sample_pieces runs of
    letters at even distances over the whole text.  The sample is what the driver gets: under 4 KB a row.
    """
    docs = docs.filter(F.col(lang).isNotNull()).select(F.col(key).alias("k"), F.col(lang).alias("l"), F.col(text).alias("t"))
    counts = docs.groupBy("l").count().orderBy(F.desc("count"), "l").collect()
    languages = sorted(r.l for r in counts)
    if not languages:
        return _new_model([], 1, 0)
    share = F.create_map(*[x for r in counts for x in (F.lit(r.l), F.lit(min(1.0, sample_docs / r["count"])))])
    place = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "k"), 11) / F.lit(float(1 << 53))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in text_runs(batches, "t", _RUN_BYTES):
            s, e, _, row = words(data, off, LETTER_BYTE)
            low = LETTER_BYTE[data].tobytes()
            out = []
            for a, b in zip(row[:-1].tolist(), row[1:].tolist()):
                at = range(a, b) if b - a <= sample_pieces else [a + (b - a) * i // sample_pieces for i in range(sample_pieces)]
                out.append([low[s[i] : min(e[i], s[i] + PIECE)] for i in at])
            yield pa.RecordBatch.from_arrays([part.column("l"), pa.array(out, pa.list_(pa.binary()))], names=["l", "pieces"])

    rows = docs.filter(place < share[F.col("l")]).select("l", "t").mapInArrow(pick, "l string, pieces array<binary>").collect()
    rows = sorted((r.l, [bytes(x) for x in r.pieces]) for r in rows)
    pieces = [x for _, xs in rows for x in xs]
    index = {x: i for i, x in enumerate(languages)}
    label = np.array([index[x] for x, xs in rows for _ in xs], np.int64)
    return fit(pieces, label, languages, **options)


def predict(docs: DataFrame, model: Model, *, text: str = "text", out: str = "language") -> DataFrame:
    """docs with a struct column `out`: lang (a language of the model), score (its mean probability over the letter positions).

    The language is the one of the largest mean log probability.  Texts that are null or have no letter get "und" and 0, as do all
    if the model has no language.  Of languages that tie, the first by name.  Repeated rows are rows of their own; very long texts
    are read whole; an empty table gives no rows.  Other columns pass through, except one named `out`, which is replaced.
    """
    df = docs.select(*[c for c in docs.columns if c != out]).withColumn(out, F.lit(None).cast("struct<lang:string,score:double>"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    n_lang = len(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = _Pool(shared.value)
        for part, data, off in text_runs(batches, text, _few(_RUN_BYTES, n_lang)):
            sums = pool.rows(data, off) if n_lang else np.zeros((part.num_rows, 1))
            ascii_letter = np.concatenate([[0], np.cumsum((LETTER_BYTE[data] != 0) & (data < 0x80))])
            some = ascii_letter[off[1:]] > ascii_letter[off[:-1]]
            texts = part.column(text)
            langs, scores = [], []
            for i, x in enumerate(sums):
                if not n_lang or not x[-1] or not (some[i] or _letters(texts[i].as_py())):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    best = int(x[:n_lang].argmax())
                    langs.append(shared.value.languages[best])
                    scores.append(round(min(1.0, x[n_lang + best] / x[-1]), 6))
            kind = part.schema.field(part.num_columns - 1).type
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], fields=list(kind))], schema=part.schema)

    return df.mapInArrow(run, df.schema)


def held_out(key: str, of: int, rest: int):
    """Whether the CRC-32 of the key as text leaves this rest; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % of == rest, F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; rows that are held out are not learned from."""
    out = held_out("doc_id", 4, 2)
    model = train(docs.filter(~out))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def identified(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is found, whatever its score, with their own columns, whatever their names; "und" goes: null texts
    and texts without a letter."""
    out = unused("language", docs)
    found = predict(docs, train(docs.filter(~held_out("doc_id", 4, 2))), out=out)
    return found.filter(F.col(out)["lang"] != UNKNOWN).drop(out)


def label_positions(text: str, model: Model) -> list[tuple[int, int, str]]:
    """(first byte, past the last byte, language) of maximal runs of positions with one label; bytes outside letters have none."""
    data = np.frombuffer(text.encode(), np.uint8)
    s, e, _, _ = words(data, np.array([0, len(data)]), LETTER_BYTE)
    if not len(s) or not model.languages:
        return []
    start = np.concatenate([np.arange(a, b, PIECE) for a, b in zip(s, e)])
    length = np.minimum(PIECE, np.repeat(e, -(-(e - s) // PIECE)) - start)
    order = np.argsort(-length, kind="stable")
    logp, base = positions(model, CODE[LETTER_BYTE[data]], start[order], length[order])
    label = np.full(len(data), -1)
    for a, n, b in zip(start[order], length[order], base):
        label[a : a + n] = logp[b : b + n].argmax(1)
    edge = np.flatnonzero(np.diff(label, prepend=-2, append=-2))
    return [(int(a), int(b), model.languages[label[a]]) for a, b in zip(edge, edge[1:]) if label[a] >= 0]
