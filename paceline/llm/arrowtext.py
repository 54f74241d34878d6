"""Vectorised text kernels over Arrow string columns.

A string column arrives as one UTF-8 buffer with row offsets.  Rows are taken in
runs of at most CHUNK_BYTES (a longer row is a run of its own), so the working set
is bounded by the run, not by the Arrow batch.  Nulls are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
_BLOCK = 1 << 20

_rng = np.random.default_rng(20240607)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_SLOT_CODE = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[str, np.ndarray] = {}

#: lower-cased byte for word bytes (a-z, 0-9, any byte of a non-ASCII character), else 0
WORD_BYTE = np.zeros(256, np.uint8)
WORD_BYTE[0x30:0x3A] = np.arange(0x30, 0x3A)
WORD_BYTE[0x41:0x5B] = np.arange(0x61, 0x7B)
WORD_BYTE[0x61:0x7B] = np.arange(0x61, 0x7B)
WORD_BYTE[0x80:] = np.arange(0x80, 0x100)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def column_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its n + 1 row offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):  # several chunks of over 2 GB in sum
        col = pa.concat_arrays([c.cast(pa.large_string()) for c in col.chunks])
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def runs(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `limit` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_runs(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES):
    """(batch slice, bytes, offsets) of each run of each batch."""
    for batch in batches:
        if batch.num_rows:
            data, off = column_bytes(batch.column(column))
            for i, j in runs(off, limit):
                yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2**64."""
    if len(_POWERS.get("p", ())) < n:
        with np.errstate(over="ignore"):
            for key, base in (("p", _P), ("q", _P_INV)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                _POWERS[key] = np.cumprod(x)
    return _POWERS["p"][:n], _POWERS["q"][:n]


def _block_words(data: np.ndarray, breaks: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = table[data]
    inside = low != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    breaks = breaks[(breaks > 0) & (breaks < len(data))]
    first[breaks] = inside[breaks]
    last[breaks - 1] = inside[breaks - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    p, q = powers(max(len(data) + 1, 1 << 16))
    with np.errstate(over="ignore"):
        acc = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODE[low] * p[: len(data)] * inside, out=acc[1:])
        h = mix64((acc[e] - acc[s]) * q[s] + (e - s).astype(np.uint64))
    return s, e, h


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of all words, and n + 1 offsets of rows into them.

    A word is a maximal run of word bytes of one row, ASCII letters lower-cased; `table` has
    the byte that stands for each byte, 0 for those outside words.  A long row is cut into blocks at bytes that no word holds, so temporary arrays stay small.
    """
    parts, at = [], 0
    while at < len(data):
        to = min(len(data), at + _BLOCK)
        if to < len(data):
            stop = np.flatnonzero(table[data[at:to]] == 0)
            if len(stop):
                to = at + int(stop[-1]) + 1
            else:  # one word fills the block: go on to its end
                rest = np.flatnonzero(table[data[to:]] == 0)
                to = to + int(rest[0]) + 1 if len(rest) else len(data)
        s, e, h = _block_words(data[at:to], offsets - at, table)
        parts.append((s + at, e + at, h))
        at = to
    s, e, h = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    return s, e, h, np.searchsorted(s, offsets)


def shingles(h: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words of a row, and n + 1 row offsets into them.

    A row of fewer than k words, but not none, has one shingle of all its words.
    """
    count = np.diff(row)
    size = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    off = np.zeros(len(row), np.int64)
    np.cumsum(size, out=off[1:])
    out = np.empty(off[-1], np.uint64)
    with np.errstate(over="ignore"):
        n = len(h) - k + 1
        if n > 0:
            full = np.zeros(n, np.uint64)
            for j in range(k):
                full += h[j : j + n] * _SLOT_CODE[j]
            full = mix64(full)
            ok = np.ones(n, bool)
            for back in range(1, k):
                x = row[1:] - back
                ok[x[(x >= 0) & (x < n)]] = False
            long = np.repeat(count >= k, size)
            out[long] = full[ok]
    for r in np.flatnonzero((count > 0) & (count < k)):
        out[off[r]] = short_keys(h[row[r] : row[r + 1]], count[r])[0]
    return out, off


def short_keys(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive words: of n words alone, the shingle of a text that has no more of them."""
    with np.errstate(over="ignore"):
        total = np.full(len(h) - n + 1, n, np.uint64)
        for j in range(n):
            total += h[j : j + len(total)] * _SLOT_CODE[j]
        return mix64(total)
