"""Which identifiers of a table of packed batches occur twice, without a row for each identifier.

A batch is a row (batch_id, n, payload); its payload is a pickled dict of numpy arrays, of n entries.  Each entry has a
`span` identifier and, where wanted, a second one (`check`) so that equality is one of 128 bits, and a `core` identifier;
absent ones are None.  With `apart` true, an identifier is there twice only if two rows (`row`) have it.

The number of buckets follows the number of identifiers, so a bucket holds about _PER_BUCKET of them at any input.  A batch
sends an identifier once: one that all batches have adds its 34 bytes a batch, that is about 17 MB for each TB of text.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

BATCH = "batch_id long, n long, payload binary"
_PER_BUCKET = 1 << 20
_KINDS = (np.uint64, np.uint64, np.uint8, np.uint64, np.uint64, np.uint8)


def number(counter: int) -> int:
    context = TaskContext.get()
    return ((context.partitionId() if context else 0) << 32) + counter


def batch_of(ident: int, payload: dict) -> pa.RecordBatch:
    """A batch as a row."""
    return pa.RecordBatch.from_arrays([pa.array([ident], pa.int64()), pa.array([len(payload["span"])], pa.int64()), pa.array([pickle.dumps(payload, 5)], pa.binary())], names=["batch_id", "n", "payload"])


def _slices(sorted_ids: np.ndarray, buckets: int) -> np.ndarray:
    """Offsets of the buckets' slices of sorted identifiers: equal ranges of their values."""
    bucket = (sorted_ids >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    return np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))


def _groups(span: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by (span, check, place), the first place of each group in that order, and the group of each entry."""
    order = np.lexsort((check, span))
    a, b = span[order], check[order]
    first = np.ones(len(a), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    back = np.empty(len(a), np.int64)
    back[order] = np.cumsum(first) - 1
    return order, np.flatnonzero(first), back


def _entries(payload: dict) -> tuple[np.ndarray, ...]:
    """Distinct spans and checks, the first entry of each, the group of each entry, how often it is there (to 255); distinct cores
    with their least span and whether they have several."""
    span, core, check = payload["span"], payload["core"], payload.get("check")
    check = np.zeros(len(span), np.uint64) if check is None else check
    order, head, back = _groups(span, check)
    first = order[head]
    if payload.get("apart") and len(span):
        row = payload["row"][order]
        times = 1 + (np.minimum.reduceat(row, head) != np.maximum.reduceat(row, head))
    else:
        times = np.minimum(np.diff(np.append(head, len(span))), 255)
    if core is None or not len(core):
        none = span[:0]
        return span[first], check[first], first, back, times, none, none, none.astype(bool)
    order = np.argsort(core, kind="stable")
    cores, at = np.unique(core[order], return_index=True)
    low, high = np.minimum.reduceat(span[order], at), np.maximum.reduceat(span[order], at)
    return span[first], check[first], first, back, times, cores, low, low != high


def _packed(columns: list[np.ndarray]) -> bytes:
    return np.array([len(columns[0]), len(columns[3])], np.int32).tobytes() + b"".join(c.astype(k, copy=False).tobytes() for c, k in zip(columns, _KINDS))


def _unpacked(raw: bytes) -> list[np.ndarray]:
    n = np.frombuffer(raw, np.int32, 2)
    out, at = [], 8
    for i, kind in enumerate(_KINDS):
        size = int(n[int(i > 2)])
        out.append(np.frombuffer(raw, kind, size, at))
        at += size * np.dtype(kind).itemsize
    return out


def _judged(sent: list[bytes]) -> list[tuple[bytes, bytes]]:
    """For what each batch sent, in order: flags of its spans (1: there twice, 2: also the first of them, from 4: half steps of
    the logarithm of how often) and of its cores (1: in several spans)."""
    parts = [_unpacked(x) for x in sent]
    span, check, times, core, low, several = (np.concatenate(c) for c in zip(*parts))
    order, head, back = _groups(span, check)
    total = np.bincount(back, times, len(head))
    flag = ((total > 1) * (1 + 4 * np.minimum(63, 2 * np.log2(np.maximum(total, 1))).astype(np.uint8))).astype(np.uint8)[back]
    first = order[head]
    flag[first] |= 2 * (flag[first] & 1)
    _, of = np.unique(core, return_inverse=True)
    many = np.zeros(len(core), bool)
    least, most = np.full(len(core), 2**64 - 1, np.uint64), np.zeros(len(core), np.uint64)
    np.minimum.at(least, of, low)
    np.maximum.at(most, of, low)
    np.logical_or.at(many, of, several != 0)
    in_several = ((least != most) | many)[of].astype(np.uint8)
    s, c = np.cumsum([0, *(len(x[0]) for x in parts)]), np.cumsum([0, *(len(x[3]) for x in parts)])
    return [(flag[a:b].tobytes(), in_several[x:y].tobytes()) for a, b, x, y in zip(s, s[1:], c, c[1:])]


def buckets_of(table: DataFrame) -> int:
    """As many buckets as hold _PER_BUCKET identifiers each, and at least the session's shuffle partitions."""
    n = table.agg(F.sum("n")).first()[0] or 0
    return max(1, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * n // _PER_BUCKET))


def verdicts(table: DataFrame, buckets: int) -> DataFrame:
    """table with, for each range of its payloads: 1 its span is there twice; 2 it goes on (its core is in several spans,
    and its own span is alone, or it is the partner that stands for the equal ones).

    Batches send distinct identifiers by value, so neither a hot string nor a hot core meets in one task more than once a batch.
    """
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, raw in zip(batch.column(0).to_pylist(), batch.column(2)):
                spans, checks, _, _, times, cores, low, several = _entries(pickle.loads(raw.as_py()))
                s, c = _slices(spans, buckets), _slices(cores, buckets)
                some = np.flatnonzero((np.diff(s) > 0) | (np.diff(c) > 0)).tolist()
                if some:
                    cut = [_packed([*(x[s[b] : s[b + 1]] for x in (spans, checks, times)), *(x[c[b] : c[b + 1]] for x in (cores, low, several))]) for b in some]
                    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([ident] * len(some), pa.int64()), pa.array(cut, pa.binary())], names=["bucket", "batch_id", "sent"])

    def judge(part):
        part = part.sort_values("batch_id", ignore_index=True)
        told = _judged(list(part.pop("sent")))
        part["of_spans"], part["of_cores"] = [x for x, _ in told], [x for _, x in told]
        return part[[any(x) or any(y) for x, y in told]][["batch_id", "bucket", "of_spans", "of_cores"]]

    sent = table.mapInArrow(send, "bucket long, batch_id long, sent binary")
    told = sent.groupBy("bucket").applyInPandas(judge, "batch_id long, bucket long, of_spans binary, of_cores binary")
    told = told.groupBy("batch_id").agg(F.collect_list(F.struct("bucket", "of_spans", "of_cores")).alias("told"))
    return table.join(told, "batch_id", "left")


def states(payload: dict, told: list[dict] | None, buckets: int) -> np.ndarray:
    """The verdicts of the payload's entries; without cores, the flags of their spans."""
    spans, _, first, back, _, cores, _, _ = _entries(payload)
    of_spans, of_cores = np.zeros(len(spans), np.uint8), np.zeros(len(cores), np.uint8)
    s, c = _slices(spans, buckets), _slices(cores, buckets)
    for x in told or ():
        b = x["bucket"]
        of_spans[s[b] : s[b + 1]] = np.frombuffer(x["of_spans"], np.uint8)
        of_cores[c[b] : c[b + 1]] = np.frombuffer(x["of_cores"], np.uint8)
    flag = of_spans[back]
    partner = np.zeros(len(flag), bool)
    partner[first] = of_spans & 2 != 0
    if payload["core"] is None:
        return flag
    on = (of_cores[np.searchsorted(cores, payload["core"])] == 1) & ((flag == 0) | partner) if len(cores) else np.zeros(len(flag), bool)
    return (flag & 1) + 2 * on.astype(np.uint8)


def each(table: DataFrame, run: Callable, schema: str) -> DataFrame:
    """run(batch number, payload, states) gives record batches for each row of a written table of batches."""
    buckets = buckets_of(table)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, raw, told in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                payload = pickle.loads(raw.as_py())
                yield from run(ident, payload, states(payload, told.as_py(), buckets))

    return verdicts(table, buckets).mapInArrow(apply, schema)
