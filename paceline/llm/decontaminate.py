"""Benchmark decontamination by Wu-Manber multi-pattern search over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

from .arrowtext import WORD_BYTE, column_bytes, mix64, text_runs, words
from .store import dropped, unused, written

_LANE = 64
_TABLE_BITS = 18
_COMPARE = 8192
_CHAIN = 4
#: a word, before or after lower-casing A-Z
WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
DETAIL = "n_words long, n_hit long, item_ids array<string>, hit_spans array<int>"


class PatternSet:
    """Shift and suffix tables for patterns of one length, counted in words."""

    def __init__(self, m: int, codes: np.ndarray, texts: list[list[bytes]], items: list[list[int]]):
        self.m, self.block = m, 3 if m >= 5 else min(m, 2)
        b = self.block
        self.shift = np.full(1 << _TABLE_BITS, m - b + 1, np.uint8 if m < 250 else np.int32)
        for end in range(b - 1, m):  # a block that ends at word `end` of a pattern lets the window move m - 1 - end
            np.minimum.at(self.shift, self._slot(codes, end), m - 1 - end)
        suffix = self._block(codes, m - 1)
        order = np.argsort(suffix, kind="stable")
        self.suffix, self.codes = suffix[order], codes[order]
        self.lengths = np.array([[len(w) for w in texts[i]] for i in order], np.int64).reshape(-1, m)
        self.bytes = np.frombuffer(b"".join(w for i in order for w in texts[i]), np.uint8)
        self.byte_off = np.concatenate([[0], np.cumsum(self.lengths.sum(1))])
        lens = np.array([len(items[i]) for i in order], np.int64)
        self.item_off = np.concatenate([[0], np.cumsum(lens)])
        self.items = np.array([x for i in order for x in items[i]], np.int64)

    def _block(self, codes: np.ndarray, end: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = codes[:, end].copy()
            for j in range(1, self.block):
                out = out * np.uint64(0xD6E8FEB86659FD93) + codes[:, end - j]
            return mix64(out)

    def _slot(self, codes: np.ndarray, end: int) -> np.ndarray:
        return (self._block(codes, end) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def _text_block(self, h: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = h[end]
            for j in range(1, self.block):
                out = out * np.uint64(0xD6E8FEB86659FD93) + h[end - j]
            return mix64(out)

    def search(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last word, pattern) of occurrences by word hash inside a row; equal bytes are for the caller to confirm.

        The texts are cut into lanes of _LANE window ends; all lanes move by their own shift in each step.
        """
        m, n = self.m, len(h)
        lo = np.arange(m - 1, n, _LANE)
        hi = np.minimum(lo + _LANE, n)
        found = []
        while len(lo):
            block = self._text_block(h, lo)
            step = self.shift[(block >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)].astype(np.int64)
            at = step == 0
            if at.any():
                found.append((lo[at], block[at]))
            lo = lo + np.maximum(step, 1)
            on = lo < hi
            lo, hi = lo[on], hi[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        end, block = (np.concatenate(x) for x in zip(*found))
        left, right = np.searchsorted(self.suffix, block, "left"), np.searchsorted(self.suffix, block, "right")
        out_end, out_pat = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        k = 0
        live = left < right
        while live.any():  # the k-th test string of each suffix bucket
            end, left, right = end[live], left[live], right[live]
            pat = left + k
            same = np.ones(len(end), bool)
            for j in range(m):
                same &= h[end - j] == self.codes[pat, m - 1 - j]
            out_end.append(end[same])
            out_pat.append(pat[same])
            k += 1
            live = left + k < right
        end, pat = np.concatenate(out_end), np.concatenate(out_pat)
        begin = end - m + 1
        inside = np.searchsorted(row, begin, "right") == np.searchsorted(row, end, "right")
        return end[inside], pat[inside]


def pattern_sets(items: list[tuple[object, str | None]], n: int) -> tuple[list[PatternSet], list[str | None]]:
    """The search tables of all windows of n words of the items' texts, and the items' names (null, if there, the last)."""
    keys = {None if k is None else str(k) for k, _ in items}
    names: list[str | None] = sorted(keys - {None}) + ([None] if None in keys else [])
    index = {k: i for i, k in enumerate(names)}
    by: dict[int, dict[tuple[bytes, ...], list]] = {}
    for key, text in items:
        data, off = column_bytes(pa.array([text], pa.large_string()))
        s, e, h, _ = words(data, off)
        low = data.tobytes().lower()  # bytes.lower() changes A-Z only
        got = [low[a:b] for a, b in zip(s, e)]
        m = min(n, len(got))
        for i in range(len(got) - m + 1 if m else 0):
            entry = by.setdefault(m, {}).setdefault(tuple(got[i : i + m]), [h[i : i + m], set()])
            entry[1].add(index[None if key is None else str(key)])
    sets = []
    for m, found in sorted(by.items()):
        sets.append(PatternSet(m, np.array([x[0] for x in found.values()], np.uint64).reshape(-1, m), list(found), [sorted(x[1]) for x in found.values()]))
    return sets, names


def _counting(n: np.ndarray) -> np.ndarray:
    """0 .. n[0] - 1, 0 .. n[1] - 1 and so on."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _same_bytes(p: PatternSet, low: np.ndarray, s: np.ndarray, e: np.ndarray, end: np.ndarray, pat: np.ndarray) -> np.ndarray:
    """Direct comparison: whether the m words up to each `end` are the words of the pattern, byte by byte."""
    ok = np.ones(len(end), bool)
    for j in range(p.m):
        at = end - p.m + 1 + j
        ok &= e[at] - s[at] == p.lengths[pat, j]
    for part in np.array_split(np.flatnonzero(ok), max(1, -(-len(end) // _COMPARE))):
        size = p.lengths[pat[part]].ravel()
        first = (end[part, None] - p.m + 1 + np.arange(p.m)).ravel()
        theirs = np.repeat(p.byte_off[pat[part]], p.lengths[pat[part]].sum(1)) + _counting(p.lengths[pat[part]].sum(1))
        differ = low[np.repeat(s[first], size) + _counting(size)] != p.bytes[theirs]
        of = np.repeat(np.repeat(part, p.m), size)
        ok[of[differ]] = False
    return ok


def _scan(data: np.ndarray, off: np.ndarray, sets: list[PatternSet], n_items: int):
    """Row offsets into words, hit word flags, and row * n_items + item without repeats."""
    s, e, h, row = words(data, off)
    edge = np.zeros(len(h) + 1, np.int64)
    pairs = []
    low = WORD_BYTE[data]
    for p in sets:
        end, pat = p.search(h, row)
        ok = _same_bytes(p, low, s, e, end, pat)
        end, pat = end[ok], pat[ok]
        np.add.at(edge, end - p.m + 1, 1)
        np.add.at(edge, end + 1, -1)
        at = np.unique(np.stack([np.searchsorted(row, end, "right") - 1, pat]), axis=1)
        count = p.item_off[at[1] + 1] - p.item_off[at[1]]
        pairs.append(np.unique(np.repeat(at[0], count) * n_items + p.items[np.repeat(p.item_off[at[1]], count) + _counting(count)]))
    pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return row, np.cumsum(edge[:-1]) > 0, pairs


def _lists(of: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """A list array of n rows from values and the ascending rows they belong to."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()), values)


def _earlier(before: pa.StructArray, row: np.ndarray, hit: np.ndarray) -> dict[int, list]:
    """Sets the words that earlier blocks hit; their items by row."""
    out = {}
    spans, ids = before.field("hit_spans"), before.field("item_ids")
    for i in np.flatnonzero(pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False) > 0).tolist():
        out[i] = ids[i].as_py()
        flat = spans[i].as_py()
        for x, y in zip(flat[::2], flat[1::2]):
            hit[row[i] + x : row[i] + y] = True
    return out


def _verdicts(row: np.ndarray, hit: np.ndarray, pairs: np.ndarray, names: list, before: pa.StructArray | None, kind: pa.DataType) -> pa.Array:
    """The struct column of a run of rows."""
    n = len(row) - 1
    old = _earlier(before, row, hit) if before is not None else {}
    of, items = pairs // max(1, len(names)), np.array([*names, None], object)[pairs % max(1, len(names))] if len(pairs) else np.zeros(0, object)
    if old:
        by = {int(i): set(x) for i, x in old.items()}
        for i, x in zip(of.tolist(), items):
            by.setdefault(i, set()).add(x)
        flat = [(i, x) for i in sorted(by) for x in sorted(by[i], key=lambda x: (x is None, x or ""))]
        of, items = np.array([i for i, _ in flat], np.int64), [x for _, x in flat]
    begins = hit.copy()
    begins[1:] &= ~hit[:-1]
    begins[row[:-1][row[:-1] < len(hit)]] = hit[row[:-1][row[:-1] < len(hit)]]
    ends = hit.copy()
    ends[:-1] &= ~hit[1:]
    last = row[1:][row[1:] > 0] - 1
    ends[last] = hit[last]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    at = np.searchsorted(row, begin, "right") - 1
    spans = np.stack([begin - row[at], end - row[at]], 1).ravel()
    total = np.concatenate([[0], np.cumsum(hit)])
    cols = [pa.array(np.diff(row), pa.int64()), pa.array(np.diff(total[row]), pa.int64()), _lists(of, n, pa.array(list(items), pa.string())), _lists(np.repeat(at, 2), n, pa.array(spans, pa.int32()))]
    return pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(cols, kind)], fields=list(kind))


def detect(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 8, block_bytes: int = 4 << 20, out: str = "contamination") -> DataFrame:
    """docs with a struct column `out`: n_words, n_hit, item_ids (as strings, sorted, of items with an occurring window),
    hit_spans (begin, end word numbers of maximal runs of hit words, flat).

    The test strings are all windows of n consecutive words of the items (an item of fewer words is one window). They are
    cut into blocks of about `block_bytes` of text, the proven bound of what one pass sends to the executors; each block is one
    streaming pass over the rows, and a later pass adds to the struct of the earlier one, so there is no join.  After each
    _CHAIN passes the rows are written, so a task has that many workers at most, whatever the number of items.

    An item text longer than a block is a block alone.  Null or empty texts have no words and no hits; items without words
    match nothing; repeated items, and several texts of one id, count once.  Items without an id have no name: together they
    are one item, a null at the end of item_ids.  An empty table of either kind gives no rows, or no hits.  Repeated rows are
    rows of their own; very long texts are searched whole.  Other columns pass through, except one named `out`, which is replaced.
    """
    keep = [c for c in docs.columns if c != out]
    size = F.coalesce(F.octet_length(item_text), F.lit(0)) + 64
    total = items.agg(F.sum(size.cast("long"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    base = items.select(F.col(item_id).alias("k"), F.col(item_text).alias("t"))
    block = F.pmod(F.xxhash64(F.col("k").cast("string"), "t"), F.lit(n_blocks))
    df = docs.select(*keep).withColumn(out, F.lit(None).cast(f"struct<{DETAIL.replace(' long', ':bigint').replace(' array', ':array')}>"))
    schema = df.schema
    spark = docs.sparkSession
    step = None
    for b in range(n_blocks):
        rows = [(r.k, r.t) for r in base.filter(block == b).toLocalIterator()]
        tables = spark.sparkContext.broadcast(pattern_sets(rows, n))

        def run(batches: Iterator[pa.RecordBatch], tables=tables, first=b == 0) -> Iterator[pa.RecordBatch]:
            sets, names = tables.value
            for part, data, off in text_runs(batches, text):
                row, hit, pairs = _scan(data, off, sets, max(1, len(names)))
                last = part.num_columns - 1
                found = _verdicts(row, hit, pairs, names, None if first else part.column(last), part.schema.field(last).type)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], found], schema=part.schema)

        if b and b % _CHAIN == 0:
            df, last = written(df, "decontaminate"), step
            step = df
            if last is not None:
                dropped(last)
        df = df.mapInArrow(run, schema)
    return df


def decontaminated(docs: DataFrame, items: DataFrame, *, min_items: int = 1, min_words: int = 5, item_text: str = "text", **options) -> DataFrame:
    """The rows of docs in which windows of fewer than `min_items` benchmark items occur, with their own columns, whatever their names.

    One passage of one item is enough for a row to go.  Items of fewer than `min_words` words are no passages: they occur in any text, and are not searched.
    """
    out = unused("contamination", docs)
    items = items.filter(F.regexp_count(item_text, F.lit(WORDS)) >= min_words)
    options["item_text"] = item_text
    found = detect(docs, items, out=out, **options)
    return found.filter(F.size(F.col(out)["item_ids"]) < min_items).drop(out)


def report(docs: DataFrame, items: DataFrame, *, min_items: int = 2, **options) -> DataFrame:
    """One row per document: counts, the digest of the item ids, and the verdict."""
    found = detect(docs.select("doc_id", "text"), items, **options)
    ids = F.col("contamination.item_ids")
    return found.select(
        "doc_id", F.col("contamination.n_words").alias("n_words"), F.col("contamination.n_hit").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", ids).cast("binary"), 256).alias("items_sha256"),
        (F.size(ids) >= min_items).alias("contaminated"),
    )
