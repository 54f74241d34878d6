"""Quality scores: ridge regression on random Fourier features of document statistics, isotonic calibration.

The cosine features approximate a Gaussian kernel over standardised statistics.  Each
partition sums its part of the normal equations; partial sums meet in a few tasks and one
small system is solved.  Rows kept apart calibrate the scores by pooling adjacent violators.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .arrowtext import text_runs, words
from .langid import held_out
from .store import dropped, written

STATISTICS = (
    "log_bytes", "log_words", "upper", "lower", "digit", "blank", "newline", "bang", "mark", "symbol", "other",
    "word_bytes", "distinct_words", "repeated_word", "log_line_words", "distinct_lines", "line_bytes", "shouted", "symbols_per_word", "bangs_per_word", "digits_per_word",
)
_CLASSES = ("upper", "lower", "digit", "blank", "newline", "bang", "mark", "symbol")
_FEATURES, _BINS, _FOLDS = 256, 1000, 8


def _class_of(byte: int) -> str | None:
    c = chr(byte)
    if byte >= 0x80:
        return None
    if c.isupper():
        return "upper"
    if c.islower():
        return "lower"
    if c.isdigit():
        return "digit"
    if c in " \t":
        return "blank"
    if c in "\r\n":
        return "newline"
    return "bang" if c == "!" else "mark" if c in ".,;:?'\"-()" else "symbol"


_PAIR = [np.array([sum(1 << 32 * j for j in (0, 1) if _class_of(b) == _CLASSES[2 * i + j]) for b in range(256)], np.uint64) for i in range(4)]
_LINE = np.arange(256, dtype=np.uint8)
_LINE[0], _LINE[10] = 1, 0


def _distinct(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The number of distinct hashes of each row."""
    n = len(row) - 1
    at = np.repeat(np.arange(n, dtype=np.uint64), np.diff(row))
    key = np.sort(at << np.uint64(40) | h >> np.uint64(24))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    count = np.concatenate([[0], np.cumsum(first)])
    return np.diff(count[row])


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of STATISTICS for each text; all 0 for an empty one."""
    size = np.diff(off).astype(float)
    by = {}
    for i, table in enumerate(_PAIR):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[data])])
        part = total[off[1:]] - total[off[:-1]]
        by[_CLASSES[2 * i]], by[_CLASSES[2 * i + 1]] = (part & np.uint64(0xFFFFFFFF)).astype(float), (part >> np.uint64(32)).astype(float)
    s, e, h, row = words(data, off)
    ls, le, lh, lrow = words(data, off, _LINE)
    n, lines = np.diff(row).astype(float), np.diff(lrow).astype(float)
    length = np.concatenate([[0], np.cumsum(e - s)])
    same = np.concatenate([[0], np.cumsum(h[1:] == h[:-1]), [0]]) if len(h) else np.zeros(1, int)
    repeated = np.where(n > 1, same[np.maximum(row[1:] - 1, 0)] - same[np.minimum(row[:-1], max(0, len(same) - 1))], 0)
    one, word, line = np.maximum(size, 1), np.maximum(n, 1), np.maximum(lines, 1)
    known = sum(by[c] for c in _CLASSES)
    cols = [
        np.log1p(size), np.log1p(n), *(by[c] / one for c in _CLASSES), (size - known) / one,
        (length[row[1:]] - length[row[:-1]]) / word, _distinct(h, row) / word, repeated / word, np.log1p(n / line), _distinct(lh, lrow) / line, np.log1p(size / line),
        by["upper"] / np.maximum(by["upper"] + by["lower"], 1), by["symbol"] / word, by["bang"] / word, by["digit"] / word,
    ]
    return np.where(size[:, None] > 0, np.stack(cols, 1), 0.0)


def with_statistics(docs: DataFrame, *, text: str = "text", out: str = "statistics") -> DataFrame:
    """docs with the array column `out` of STATISTICS instead of the column `text`; null is an empty text."""
    df = docs.select(*[c for c in docs.columns if c not in (out, text)], text).withColumn(out, F.lit(None).cast("array<double>"))
    keep = df.columns.index(text)
    schema = df.drop(text).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in text_runs(batches, text):
            x = statistics(data, off)
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*part.columns[:keep], values], names=[*part.schema.names[:keep], out])

    return df.mapInArrow(run, schema)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    ridge: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -5, 5) @ self.directions + self.phases
        return np.concatenate([np.cos(z) * np.sqrt(2 / z.shape[1]), np.ones((len(x), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.ridge

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of label 1; a small share of the raw score keeps the order inside a pooled block."""
        raw = self.raw(x)
        return np.round(0.995 * np.interp(raw, self.edges, self.levels) + 0.005 / (1 + np.exp(-4 * (raw - 0.5))), 9)


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    values = batch.column(name).flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, len(STATISTICS))


def isotonic(weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence of least weighted squared error, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for w, v in zip(weight, value):
        blocks.append([w, v, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            b = blocks.pop()
            a = blocks[-1]
            a[1] = (a[0] * a[1] + b[0] * b[1]) / (a[0] + b[0])
            a[0] += b[0]
            a[2] += b[2]
    return np.concatenate([np.full(int(n), v) for _, v, n in blocks]) if blocks else np.zeros(0)


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums of f f' and f y over all rows (statistics, y): by partition, then in _FOLDS tasks, then here."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    d = _FEATURES + 1

    def pack(total: np.ndarray, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["n", "sums"])

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((d, d + 1)), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                f = shared.value.features(_column(piece, "statistics"))
                total += f.T @ np.concatenate([f, piece.column("y").to_numpy(zero_copy_only=False)[:, None]], 1)
                n += piece.num_rows
        if n:
            yield pack(total, n)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((d, d + 1)), 0
        for batch in batches:
            for k, raw in zip(batch.column("n").to_pylist(), batch.column("sums").to_pylist()):
                total += np.frombuffer(raw).reshape(d, d + 1)
                n += k
        if n:
            yield pack(total, n)

    sums = rows.mapInArrow(part, "n long, sums binary").repartition(_FOLDS, F.xxhash64("sums")).mapInArrow(add, "n long, sums binary").collect()
    total = sum((np.frombuffer(r.sums).reshape(d, d + 1) for r in sorted(sums, key=lambda r: bytes(r.sums))), np.zeros((d, d + 1)))
    return total[:, :d], total[:, d]


def fit(rows: DataFrame, calibrate: Column, *, width: float = 4.0, penalty: float = 1.0, seed: int = 9) -> Model:
    """A model from rows (statistics, y of 0 or 1): those where `calibrate` holds set the calibration, the others the ridge.

    All rows count.  The driver gets means and variances, _FOLDS sums of a fixed size, and counts of _BINS bins of raw scores.
    Without rows of both labels the score is the share of label 1 (0.5 without any row).
    """
    k = len(STATISTICS)
    rng = np.random.default_rng(seed)
    learn = rows.filter(~calibrate)
    cells = [F.col("statistics")[i] for i in range(k)]
    m = learn.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cells)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cells)]).first()
    mean = np.array([m[f"m{i}"] or 0.0 for i in range(k)])
    scale = np.array([m[f"s{i}"] or 0.0 for i in range(k)])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 1 / width, (k, _FEATURES)), rng.uniform(0, 2 * np.pi, _FEATURES), np.zeros(_FEATURES + 1), np.array([0.0, 1.0]), np.zeros(2))
    share = 0.5 if m.y is None else float(m.y)
    if share in (0.0, 1.0) or m.y is None:
        model.levels = np.full(2, share)
        return model
    a, b = _normal_equations(learn, model)
    model.ridge = np.linalg.solve(a + penalty * np.diag([*np.ones(_FEATURES), 1e-6]), b)
    raw = score(rows.filter(calibrate), model, out="raw", calibrated=False)
    low, high = -0.5, 1.5
    bins = raw.groupBy(F.least(F.lit(_BINS - 1), F.greatest(F.lit(0), F.floor((F.col("raw") - low) / (high - low) * _BINS))).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum("y").alias("y")).orderBy("bin").collect()
    if bins:
        at = np.array([low + (r.bin + 0.5) * (high - low) / _BINS for r in bins])
        n = np.array([r.n for r in bins], float)
        level = isotonic(n, np.array([r.y for r in bins]) / n)
        prior = 2.0  # a pooled block counts as two rows more, of the mean label
        size = np.array([n[level == v].sum() for v in level])
        model.edges, model.levels = at, (level * size + prior * share) / (size + prior)
        model.levels = isotonic(n, model.levels)
    else:
        model.edges, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def score(rows: DataFrame, model: Model, *, out: str = "score", calibrated: bool = True) -> DataFrame:
    """rows with the column `out` instead of `statistics`: the calibrated score, or the raw one."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    df = rows.select(*[c for c in rows.columns if c not in ("statistics", out)], "statistics").withColumn(out, F.lit(0.0))
    keep = df.columns.index("statistics")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = _column(part, "statistics")
                yield pa.RecordBatch.from_arrays([*part.columns[:keep], pa.array(m.score(x) if calibrated else m.raw(x))], names=[*part.schema.names[:keep], out])

    return df.mapInArrow(run, df.drop("statistics").schema)


def report(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; of labels (doc_id, quality), those of held-out ids are not read.

    Null texts are empty texts; null labels and labels without a document teach nothing; repeated labels count as often, and
    repeated rows are rows of their own, of equal scores.  Very long texts are read whole; an empty table gives no rows.
    Other columns are not read.
    """
    table = written(with_statistics(docs.select("doc_id", "text")), "statistics")
    y = labels.filter(F.col("quality").isNotNull() & ~held_out("doc_id", 5, 0)).select("doc_id", F.col("quality").cast("double").alias("y"))
    labelled = written(table.join(y, "doc_id"), "labelled")
    scored = score(table, fit(labelled, held_out("doc_id", 5, 1)))
    out = written(scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")), "scored")
    dropped(table, labelled)
    return out
