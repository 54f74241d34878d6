"""Removal of long repeated strings by bucket-pointer refinement of a sparse suffix array.

Suffixes start in q-gram buckets; a bucket is refined by the bucket identifiers of later
offsets, and refined identifiers are used again for the next refinement.  Identifiers are
fingerprints made by that recursion from the symbols alone, so equal strings get equal
identifiers in every task.  Only suffixes at anchors are sorted: of each string of LENGTH
symbols, the q-gram with the least identifier.  Equal strings have their anchors at the same
offset, so a string repeats only if its anchor's bucket has two members.  Strings are equal if
their identifier and a second, independent fingerprint are: 128 bits.

Three refinements settle strings by anchor and offset range: the symbols that all strings of
the range share (`core`) and those that any of them covers (`span`).  A range whose span
occurs twice repeats; one whose core is alone, or in one span only, is done; the rest go on
in smaller ranges, down to single strings.  Of equal decided ranges one goes on, as partner.

Symbols are bytes, or words for passages that texts of different wording around them share.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrowtext import BYTE_CODE, CHUNK_BYTES, mix64, powers, text_runs, words
from .repeats import BATCH, batch_of, each, number
from .store import dropped, written

_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: symbols in work at once: longer texts are cut into pieces that overlap by all but one symbol of a string
_PIECE = 1 << 19
_PLACE = np.uint64((1 << 28) - 1)
_RANGES = 16
_PACK_BYTES = 384 << 10


def _gram(length: int, unit: str) -> int:
    """Symbols of the initial buckets' q-grams."""
    if unit == "word":
        return 1 << max(0, (length // 6).bit_length() - 1)
    if length < 16:
        raise ValueError("strings must have 16 bytes or more")
    return 64 if length >= 160 else 16 if length >= 32 else 8


def _sequence(data: np.ndarray, off: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of a run of texts (bytes, or hashes of words) and the rows' offsets into them."""
    if unit == "byte":
        return data, off
    _, _, h, row = words(data, off)
    return h, row


def _refined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * _C1 + b * _C2
        x ^= x >> np.uint64(32)
        return x


def identifiers(symbols: np.ndarray, q: int) -> np.ndarray:
    """Bucket identifiers of all q-grams: of 8 bytes, or one word, first, then doubled by the identifiers of later offsets."""
    if len(symbols) < q:
        return np.zeros(0, np.uint64)
    width = 1
    if symbols.dtype == np.uint8:
        x = symbols.astype(np.uint64)
        for step in (1, 2, 4):
            x = x[:-step] | x[step:] << np.uint64(8 * step)
        x, width = mix64(x), 8
    else:
        x = symbols
    while width < q:
        x = _refined(x[:-width], x[width:])
        width *= 2
    return x


class Strings:
    """Fingerprints of any strings of q symbols or more in a piece."""

    def __init__(self, symbols: np.ndarray, q: int):
        self.q, self.grams = q, identifiers(symbols, q)
        power, self.inverse = powers(len(symbols) + 1)
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        with np.errstate(over="ignore"):
            code = BYTE_CODE[symbols] if symbols.dtype == np.uint8 else mix64(symbols + _C1)
            np.cumsum(code * power[:-1], out=self.sums[1:])

    def fingerprints(self, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Identifiers, refined by those of the strings' q-grams at each q-th offset and at the end, and independent sums of powers."""
        with np.errstate(over="ignore"):
            out = length.astype(np.uint64) * _C2
            check = mix64((self.sums[start + length] - self.sums[start]) * self.inverse[start] + length.astype(np.uint64))
        for at in range(0, int(length.max(initial=0)), self.q):
            on = at < length
            place = start + np.minimum(at, length - self.q)
            out = np.where(on, _refined(out, self.grams[np.where(on, place, 0)]), out)
        return mix64(out), check


def fingerprints(symbols: np.ndarray, q: int, start: np.ndarray, length: np.ndarray, size: int = _PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Strings.fingerprints of a sequence of any length, a piece at a time."""
    out, check = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    order = np.argsort(start, kind="stable")
    begin, i = start[order], 0
    while i < len(order):
        j = int(np.searchsorted(begin, begin[i] + size))
        part = order[i:j]
        piece = Strings(symbols[begin[i] : (start[part] + length[part]).max()], q)
        out[part], check[part] = piece.fingerprints(start[part] - begin[i], length[part])
        i = j
    return out, check


def _anchors(grams: np.ndarray, off: np.ndarray, length: int, q: int) -> tuple[np.ndarray, ...]:
    """Row, anchor place, least and largest offset of the strings of `length` symbols with that anchor, in a piece."""
    none = np.zeros(0, np.int64)
    width = length - q + 1
    count = np.maximum(np.diff(off) - length + 1, 0)
    if len(grams) < width or not count.any():
        return none, none, none, none
    low = grams & ~_PLACE | np.arange(len(grams), dtype=np.uint64)  # the leftmost of equal identifiers
    size = 1
    while 2 * size <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < width:
        low = np.minimum(low[: size - width], low[width - size :])
    row = np.repeat(np.arange(len(count)), count)
    begin = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + off[:-1][row]
    place = (low[begin] & _PLACE).astype(np.int64)
    first = np.ones(len(row), bool)
    first[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(first)
    tail = np.concatenate([head[1:], [len(row)]]) - 1
    return row[head], place[head], place[head] - begin[tail], place[head] - begin[head]


def anchored(symbols: np.ndarray, off: np.ndarray, length: int, q: int, size: int = _PIECE) -> tuple[np.ndarray, ...]:
    """Row, anchor place, least and largest offset, core, span and check of all ranges of a run of rows.

    A run longer than a piece is taken in pieces, each with the strings that start in it; an anchor's range ends where its piece does.
    """
    found = []
    for at in range(0, max(1, len(symbols) - length + 1), size):
        part = symbols[at : at + size + length - 1]
        first = min(int(np.searchsorted(off, at, "right")) - 1, len(off) - 2)
        edge = off[first : max(first + 1, int(np.searchsorted(off, at + len(part)))) + 1]
        piece = Strings(part, q)
        row, place, lo, hi = _anchors(piece.grams, np.clip(edge, at, at + len(part)) - at, length, q)
        span, check = piece.fingerprints(place - hi, hi - lo + length)
        span = _refined(span, (lo * (length - q + 1) + hi).astype(np.uint64))
        found.append((row + first, place + at, lo, hi, mix64(piece.grams[place]), span, check))
    return tuple(np.concatenate(x) for x in zip(*found))


def _merged(begin: np.ndarray, end: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of the maximal runs that ranges [begin, end) of the rows cover."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order]) if len(end) else end
    row = np.searchsorted(off, begin, "right") - 1
    new = np.ones(len(begin), bool)
    new[1:] = (begin[1:] > end[:-1]) | (row[1:] != row[:-1])
    head = np.flatnonzero(new)
    return row[head], begin[head], end[np.append(head[1:], len(begin)) - 1] if len(head) else end


def _repeated(docs: DataFrame, length: int, unit: str, apart: bool) -> DataFrame:
    """doc_id, size, n_repeated, n_spans, kept_sha256 (bytes only), sha of each row of docs (doc_id, text), as a written table:
    its symbols, those covered by a string of `length` symbols which also starts anywhere else (if `apart`, in another row), the
    maximal runs of them, digests of the rest and of the text.
    """
    q = _gram(length, unit)
    width = length - q + 1
    sub = -(-width // _RANGES)
    chunk, pack, size = CHUNK_BYTES, _PACK_BYTES, _PIECE
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {kind}, size long, n_repeated long, n_spans long, kept_sha256 string, sha binary"
    small = np.int16 if width < 32000 else np.int32
    names = [x.split()[0] for x in result.split(", ")]

    def result_columns(doc: list, size: np.ndarray, n: np.ndarray, spans: np.ndarray, kept: list, sha: list) -> list[pa.Array]:
        return [pa.array(doc, pa.int64() if kind == "bigint" else None), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.binary())]

    def digests(data: np.ndarray, off: np.ndarray) -> list[bytes]:
        raw = memoryview(data)
        return [hashlib.sha256(raw[a:b]).digest() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (part, data, off) in enumerate(text_runs(batches, limit=chunk)):
            symbols, at = _sequence(data, off, unit)
            row, place, lo, hi, core, span, check = anchored(symbols, at, length, q, size)
            yield batch_of(number(k), {
                "doc": part.column(0).to_pylist(), "size": np.diff(at), "sha": digests(data, off), "apart": apart,
                "row": row.astype(np.int32), "place": (place - at[row]).astype(np.int32), "lo": lo.astype(small), "hi": hi.astype(small), "core": core, "span": span, "check": check,
            })

    def settle(_: int, p: dict, state: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = len(p["doc"])
        some = np.bincount(p["row"][state > 0], minlength=n) > 0
        open_ = np.bincount(p["row"][state != 1], minlength=n) > 0
        repeated, spans, kept, info = np.zeros(n, np.int64), np.zeros(n, np.int64), [x.hex() if unit == "byte" else None for x in p["sha"]], [None] * n
        head = np.searchsorted(p["row"], np.arange(n + 1))
        for i in np.flatnonzero(some).tolist():
            if not open_[i]:  # every string repeats
                repeated[i], spans[i], kept[i] = p["size"][i], 1, kept[i] and hashlib.sha256(b"").hexdigest()
                continue
            at = np.arange(head[i], head[i + 1])[state[head[i] : head[i + 1]] > 0]
            info[i] = pickle.dumps((p["place"][at], p["lo"][at], p["hi"][at], state[at]), 5)
        on = np.bincount(p["row"][state >= 2], minlength=n)
        yield pa.RecordBatch.from_arrays([*result_columns(p["doc"], p["size"], repeated, spans, kept, p["sha"]), pa.array(on.astype(np.int64)), pa.array(info, pa.binary())], names=[*names, "going_on", "info"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, (part, data, off) in enumerate(text_runs(batches, limit=pack)):
            symbols, at = _sequence(data, off, unit)
            known = [pickle.loads(x.as_py()) for x in part.column(2)]
            row = np.repeat(np.arange(len(known)), [len(x[0]) for x in known])
            place, lo, hi, state = (np.concatenate([x[j] for x in known]).astype(np.int64) for j in range(4))
            place += at[row]
            sure = state & 1 == 1
            on = state >= 2
            row, place, lo, hi, begin, end = row[on], place[on], lo[on], hi[on], (place - hi)[sure], (place - lo)[sure]
            first, last = lo // sub, hi // sub
            n = last - first + 1
            of = np.repeat(np.arange(len(row)), n)
            block = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]
            place, least, most = place[of], np.maximum(lo[of], block * sub), np.minimum(hi[of], block * sub + sub - 1)
            grid = np.minimum(block * sub + sub - 1, width - 1)
            core, _ = fingerprints(symbols, q, place - block * sub, length - (grid - block * sub), size)
            span, check = fingerprints(symbols, q, place - most, most - least + length, size)
            yield batch_of(number(k), {
                "doc": part.column(0).to_pylist(), "sha": digests(data, off), "text": data.tobytes(), "off": off, "begin": begin, "end": end, "place": place, "least": least, "most": most, "row": row[of], "apart": apart,
                "core": _refined(core, block.astype(np.uint64)), "span": _refined(span, (least * width + most).astype(np.uint64)), "check": check,
            })

    def narrow(ident: int, p: dict, state: np.ndarray) -> Iterator[pa.RecordBatch]:
        sure, on = state & 1 == 1, state >= 2
        place, least, most, row = p.pop("place"), p.pop("least"), p.pop("most"), p.pop("row")
        p["begin"], p["end"] = np.concatenate([p["begin"], (place - most)[sure]]), np.concatenate([p["end"], (place - least)[sure]])
        n = (most - least + 1)[on]
        start = np.repeat((place - most)[on], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        symbols, _ = _sequence(np.frombuffer(p["text"], np.uint8), p["off"], unit)
        ids, check = fingerprints(symbols, q, start, np.full(len(start), length), size)
        yield batch_of(ident, p | {"start": start, "row": np.repeat(row[on], n), "core": ids, "span": ids, "check": check})

    def finish(_: int, p: dict, state: np.ndarray) -> Iterator[pa.RecordBatch]:
        sure = state & 1 == 1
        begin, end = np.concatenate([p["begin"], p["start"][sure]]), np.concatenate([p["end"], p["start"][sure]])
        data, off = np.frombuffer(p["text"], np.uint8), p["off"]
        _, at = _sequence(data, off, unit)
        n = len(at) - 1
        row, a, b = _merged(begin, end + length, at)
        kept: list[str | None] = [None] * n
        if unit == "byte":
            raw, head = memoryview(data), np.searchsorted(row, np.arange(n + 1))
            for i in range(n):
                digest, last = hashlib.sha256(), int(off[i])
                for x, y in zip(a[head[i] : head[i + 1]].tolist(), b[head[i] : head[i + 1]].tolist()):
                    digest.update(raw[last:x])
                    last = y
                digest.update(raw[last : int(off[i + 1])])
                kept[i] = digest.hexdigest()
        yield pa.RecordBatch.from_arrays(result_columns(p["doc"], np.diff(at), np.bincount(row, b - a, n).astype(np.int64), np.bincount(row, minlength=n), kept, p["sha"]), names=names)

    first = written(docs.mapInArrow(scan, BATCH), "suffix-anchors")
    settled = written(each(first, settle, f"{result}, going_on long, info binary"), "suffix-settled")
    dropped(first)
    key = lambda sha: F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("/"), sha)
    going = settled.filter(F.col("info").isNotNull()).withColumn("key", key(F.lower(F.hex("sha"))))
    open_ = going.groupBy("key").agg(F.max_by("info", F.col("going_on")).alias("info"))
    texts = docs.withColumn("key", key(F.sha2(F.col("text").cast("binary"), 256))).join(open_, "key").select("doc_id", "text", "info")
    second = written(texts.mapInArrow(gather, BATCH), "suffix-open")
    third = written(each(second, narrow, BATCH), "suffix-strings")
    dropped(second)
    rest = each(third, finish, result)
    done = settled.filter(F.col("info").isNull()).withColumn("key", key(F.lower(F.hex("sha")))).join(going.select("key"), "key", "left_anti")  # copies of open rows are in `rest`
    out = written(done.select(*names).unionByName(rest), "suffix-rows")
    dropped(settled, third)
    return out


def _texts(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def removed(docs: DataFrame, *, length: int = 400, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row, after removal of every byte that a string of `length` bytes
    covers which also starts anywhere else in the texts as given.  Strings do not cross rows; null texts are empty.

    Rows are known by doc_id and text, so null and repeated ids are in order; repeated rows repeat each other's strings.
    Whole texts count; nothing is capped, and arrays in work hold a piece of a text, however long it is.  Texts shorter than
    `length` stay as they are; an empty table gives no rows.  Other columns are not read.
    """
    found = _repeated(_texts(docs, text, doc_id), length, "byte", False)
    return found.select("doc_id", F.col("size").alias("n_bytes"), F.col("n_repeated").alias("n_removed"), "n_spans", "kept_sha256")


def passages(docs: DataFrame, *, length: int = 50, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_repeated, n_spans of each row: its words, those in a passage of `length` words or more that another row
    has too, and the maximal runs of them.  Words are runs of letters and digits, in any case; what is between them is free.

    A text that repeats only itself has none.  Rows, nulls, repeated rows and short texts are as in removed().
    """
    found = _repeated(_texts(docs, text, doc_id), length, "word", True)
    return found.select("doc_id", F.col("size").alias("n_words"), "n_repeated", "n_spans")


def report(docs: DataFrame, *, length: int = 400, words: int = 50) -> DataFrame:
    """removed(), and n_passage_words: the words of the row in passages of `words` words or more that another row has too.

    Passages are words, so that one of 50 short words, of fewer bytes than `length`, is told too; they remove nothing.
    """
    rows = _texts(docs, "text", "doc_id")
    strings, found = _repeated(rows, length, "byte", False), _repeated(rows, words, "word", True)
    per = found.filter("n_repeated > 0").groupBy(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias("k"), "sha").agg(F.max("n_repeated").alias("n_passage_words"))
    out = strings.withColumn("k", F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).join(per, ["k", "sha"], "left")
    return out.select("doc_id", F.col("size").alias("n_bytes"), F.col("n_repeated").alias("n_removed"), "n_spans", "kept_sha256", F.coalesce("n_passage_words", F.lit(0)).alias("n_passage_words"))
