"""Near duplicates: DartMinHash signatures, banded retrieval, exact verification, components.

A text is the multiset of its shingles of five words.  Hashed darts fall into the region of
each element, as wide as its weight, in the order of their ranks; each signature coordinate
keeps its earliest dart, so two signatures agree in a coordinate with the probability of the
weighted Jaccard similarity.  Few darts beyond those needed are thrown, whatever the text's length.

Texts with equal shingle multisets are one node.  Nodes that share a band are compared with
one hub first; only nodes still in another component than their bucket's largest are then
compared with all of the bucket, in blocks.  So no link between components is missed, and
a group of n copies costs about n comparisons.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrowtext import mix64, shingles, text_runs, words
from .repeats import BATCH, batch_of, each, number
from .store import dropped, unused, written

BANDS, BAND_ROWS, SHINGLE = 25, 5, 5
_NODES = 1500
_BLOCK = 1024
_CELL_ROWS = 2000
_SALTS = 64
_SHARES = 16
#: a byte of a word
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_BITS = 44
_NOTHING = np.uint64(2**64 - 1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] from hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53


def dart_signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """n_rows x k signatures of weighted sets given as (row, element, weight) without repeats; a row of no weight is all ones.

    An element's region is cut into strips of unit width, the last as wide as what remains, and those into cells of unit rank.
    In each cell darts come with exponential gaps of rank; a dart outside a narrower strip does not count.  A row throws all
    darts up to the rank at which k ln k + 2 k are expected, and anew up to twice that rank while a coordinate is empty.
    """
    weight = np.asarray(weight, float)
    n_strips = np.ceil(weight).astype(np.int64)
    total = np.bincount(row, weight, n_rows)
    with np.errstate(divide="ignore"):
        limit = (k * np.log(max(k, 2)) + 2 * k) / total
    out = np.full(n_rows * k, _NOTHING, np.uint64)
    todo = np.arange(len(row))
    while len(todo):
        n_cells = np.ceil(limit[row[todo]]).astype(np.int64)
        n = n_strips[todo] * n_cells
        of = np.repeat(todo, n)
        number = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        cells = np.repeat(n_cells, n)
        strip, cell = number // cells, number % cells
        width, rows = weight[of] - strip, row[of]
        with np.errstate(over="ignore"):
            seed = mix64(element[of] + strip.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + cell.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
        rank, end = cell.astype(float), np.minimum(cell + 1.0, limit[rows])
        while len(seed):
            seed = mix64(seed + np.uint64(1))
            rank = rank - np.log(_unit(seed))
            hit = rank <= end
            seed, rank, end, rows, width = seed[hit], rank[hit], end[hit], rows[hit], width[hit]
            dart = mix64(seed ^ np.uint64(0x8EBC6AF09C88C6E3))
            place = rows * k + ((dart >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
            value = rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | dart & np.uint64(0xFFFFFFFF)
            inside = width >= 1
            if not inside.all():
                inside |= _unit(mix64(dart + np.uint64(7))) <= width
                place, value = place[inside], value[inside]
            np.minimum.at(out, place, value)
        empty = (out.reshape(n_rows, k) == _NOTHING).any(1) & (total > 0)
        limit = limit * 2
        todo = np.flatnonzero(empty[row])
    return out.reshape(n_rows, k)


def weighted_shingles(data: np.ndarray, off: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) without repeats, by row and shingle; shingles are hashes of _BITS bits."""
    _, _, h, row = words(data, off)
    s, at = shingles(h, row, k)
    s >>= np.uint64(64 - _BITS)
    of = np.repeat(np.arange(len(off) - 1, dtype=np.uint64), np.diff(at))
    if len(off) <= 1 << 64 - _BITS:
        key = np.sort(of << np.uint64(_BITS) | s)
        of, s = key >> np.uint64(_BITS), key & np.uint64((1 << _BITS) - 1)
    else:  # very many rows in a run: nearly all are empty
        order = np.lexsort((s, of))
        s, of = s[order], of[order]
    first = np.ones(len(s), bool)
    first[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    head = np.flatnonzero(first)
    return of[head].astype(np.int64), s[head], np.diff(np.append(head, len(s)))


def _nodes_of(of: np.ndarray, s: np.ndarray, count: np.ndarray, n: int) -> list[bytes | None]:
    """A 16-byte name of each row's multiset; None for an empty one."""
    out = np.zeros((n, 2), np.uint64)
    with np.errstate(over="ignore"):
        for j in (0, 1):
            x = mix64(s * np.uint64(2 * j + 3) + count.astype(np.uint64) * np.uint64(0x589965CC75374CC3) + np.uint64(j))
            np.add.at(out[:, j], of, x)
    some = np.bincount(of, minlength=n) > 0
    return [out[i].tobytes() if some[i] else None for i in range(n)]


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A hash of each band's rows, n x BANDS."""
    x = signature.reshape(len(signature), BANDS, BAND_ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.zeros((len(x), 1), np.uint64)
    for j in range(BAND_ROWS):
        out = mix64(out ^ x[:, :, j])
    return out


def similarities(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...], n: int) -> np.ndarray:
    """Weighted Jaccard similarity of row i of left and of right, each as from weighted_shingles()."""
    of, s, count = (np.concatenate([x, y]) for x, y in zip(left, right))
    order = np.lexsort((s, of)) if n > 1 << 64 - _BITS else np.argsort(of.astype(np.uint64) << np.uint64(_BITS) | s, kind="stable")
    of, s, count = of[order], s[order], count[order]
    twice = np.flatnonzero((s[1:] == s[:-1]) & (of[1:] == of[:-1]))
    least = np.bincount(of[twice], np.minimum(count[twice], count[twice + 1]), n)
    total = np.bincount(of, count, n)
    return np.where(total > 0, least / np.maximum(total - least, 1), 0.0)


def _rows(docs: DataFrame, text: str) -> DataFrame:
    """doc, hash, text: a row is known by its id (null last) and a hash of its text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col("doc_id").alias("doc"), F.xxhash64(body).alias("hash"), body.alias("text"))


def _signed(rows: DataFrame) -> DataFrame:
    """doc, hash, node (null without words), bands (packed) of every row."""
    kind = rows.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in text_runs(batches):
            of, s, count = weighted_shingles(data, off)
            n = len(off) - 1
            keys = band_keys(dart_signatures(of, s, count, n, BANDS * BAND_ROWS))
            nodes = _nodes_of(of, s, count, n)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.binary()), pa.array([k.tobytes() if x else None for k, x in zip(keys, nodes)], pa.binary())], names=["doc", "hash", "node", "bands"])

    return written(rows.mapInArrow(run, f"doc {kind}, hash long, node binary, bands binary"), "dup-signed")


def _told(rows: DataFrame, facts: DataFrame, on: str, by: str) -> DataFrame:
    """rows joined with facts, which has one row for each value of `on`.  The rows of a frequent value meet in up to _SALTS tasks,
    by the hash of `by`; a value of few rows is looked up as often as it has rows, at most."""
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(_SALTS)).cast("int"))
    return rows.join(rows.select(on, "_salt").distinct().join(facts, on), [on, "_salt"]).drop("_salt")


def _buckets(nodes: DataFrame) -> DataFrame:
    """key, node, score: the nodes of each band key that more than one node has; a node's score is the sum of the sizes of its buckets, nearly."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = 0
        for batch in batches:
            for at in range(0, batch.num_rows, _NODES):
                part = batch.slice(at, _NODES)
                names, bands = part.column(0).to_pylist(), part.column(1).to_pylist()
                yield batch_of(number(counter), {"names": names, "span": np.frombuffer(b"".join(bands), np.uint64), "core": None})
                counter += 1

    def unpack(_: int, payload: dict, state: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(state & 1)
        if len(at):
            names = pa.array(payload["names"], pa.binary())
            score = np.bincount(at // BANDS, 2.0 ** ((state[at] >> 2) / 2), len(names))
            yield pa.RecordBatch.from_arrays([pa.array(payload["span"][at].view(np.int64)), names.take(pa.array(at // BANDS)), pa.array(score[at // BANDS])], names=["key", "node", "score"])

    packed = written(nodes.select("node", "bands").mapInArrow(pack, BATCH), "dup-bands")
    out = written(each(packed, unpack, "key long, node binary, score double"), "dup-buckets")
    dropped(packed)
    return out


def _alike(of: np.ndarray, s: np.ndarray, count: np.ndarray, n: int, hub: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Weighted Jaccard similarity of each of n rows, given as from weighted_shingles(), with one multiset."""
    known, times = hub
    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
    both = np.bincount(of, np.where(known[at] == s, np.minimum(count, times[at]), 0), n)
    return both / np.maximum(np.bincount(of, count, n) + times.sum() - both, 1)


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Those of the pairs (a, its hub b) whose texts have the similarity, exactly.

    The rows of a hub are dealt to blocks of about _BLOCK rows; the hub's text goes once to each block, before its rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for part, data, off in text_runs(batches, "text"):
            of, s, count = weighted_shingles(data, off)
            at = np.searchsorted(of, np.arange(part.num_rows + 1))
            heads = [*np.flatnonzero(part.column("a").is_null().to_numpy(zero_copy_only=False)).tolist(), part.num_rows]
            ok = np.zeros(part.num_rows, bool)
            for i, j in zip([-1, *heads], heads):  # rows i + 1 to j - 1 are of the hub in row i, or of the last one
                if i >= 0:
                    hub = s[at[i] : at[i + 1]], count[at[i] : at[i + 1]]
                if j > i + 1:
                    x = slice(at[i + 1], at[j])
                    ok[i + 1 : j] = _alike(of[x] - (i + 1), s[x], count[x], j - i - 1, hub) >= threshold
            if ok.any():
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(ok))

    blocks = pairs.groupBy("b").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("blocks"))
    rows = _told(pairs, blocks, "b", "a").withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")).drop("blocks")
    rows = rows.join(texts.withColumnRenamed("node", "a"), "a").select("b", "block", "a", "text")
    hubs = blocks.join(texts.withColumnRenamed("node", "b"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("binary").alias("a"), "text")
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), pairs.count() // _CELL_ROWS)
    dealt = rows.unionByName(hubs).repartition(parts, "b", "block").sortWithinPartitions("b", "block", F.asc_nulls_first("a"))
    return dealt.mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node reached from each node of the edges (a, b); by least neighbours and shortcuts, to a fixed point.

    Roots only fall, so it ends; there is no other bound on the rounds.  A node of many edges, or a root of many nodes, is looked
    up from _SHARES tasks: each node's root is there once for each of them.
    """
    share = lambda by: F.pmod(F.xxhash64(by), F.lit(_SHARES)).cast("int")
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct().withColumn("share", share("a")), "dup-edges")
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "dup-roots")
    while True:
        shared = roots.select("node", "root", F.explode(F.sequence(F.lit(0), F.lit(_SHARES - 1))).alias("share"))
        near = both.join(shared.select(F.col("node").alias("b"), "root", "share"), ["b", "share"]).groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        least = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid")).withColumn("share", share("node"))
        jump = shared.select(F.col("node").alias("mid"), F.col("root").alias("far"), "share")
        fresh = written(least.join(jump, ["mid", "share"]).select("node", F.least("mid", "far").alias("root"), "old"), "dup-roots")
        dropped(roots)
        roots = fresh.drop("old")
        roots._written_path = fresh._written_path
        if fresh.filter("root != old").isEmpty():
            dropped(both)
            return roots


def _open(buckets: DataFrame, roots: DataFrame) -> DataFrame:
    """key, node, root, left, n_left, n_all: the buckets whose nodes are in several components, what is outside the largest of
    them (left), and the numbers of blocks of those nodes and of all."""
    rows = buckets.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
    main = by.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("roots"), F.max("n").alias("most")).filter("roots > 1")
    blocks = lambda n: F.ceil(n / _BLOCK).cast("int")
    rows = _told(rows.drop("score"), main, "key", "node").withColumn("left", F.col("root") != F.col("main"))
    return written(rows.select("key", "node", "root", "left", blocks(F.col("n") - F.col("most")).alias("n_left"), blocks(F.col("n")).alias("n_all")), "dup-open")


def _signatures(open_: DataFrame, texts: DataFrame) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in text_runs(batches):
            sig = dart_signatures(*weighted_shingles(data, off), len(off) - 1, BANDS * BAND_ROWS)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in sig], pa.binary())], names=["node", "text", "sig"])

    wanted = texts.join(open_.select("node").distinct(), "node", "left_semi").select("node", "text")
    return written(wanted.mapInArrow(sign, "node binary, text string, sig binary"), "dup-signatures")


def _cells(open_: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of open buckets dealt to cells (key, i, j): block i of the left nodes (side 0) and block j of all nodes (side 1)."""
    rows = open_.join(nodes, "node")
    slot = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    lefts = rows.filter("left").withColumn("i", slot(F.col("n_left"))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_all") - 1))).withColumn("side", F.lit(0))
    alls = rows.withColumn("j", slot(F.col("n_all"))).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n_left") - 1))).withColumn("side", F.lit(1))
    return lefts.unionByName(alls).drop("n_left", "n_all")


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each cell, from batches in which the rows of a cell follow each other."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        cell = np.stack([table.column(c).to_numpy() for c in ("key", "i", "j")])
        turn = [0, *(np.flatnonzero((cell[:, 1:] != cell[:, :-1]).any(0)) + 1).tolist()]
        for a, b in zip(turn, turn[1:]):
            yield table.slice(a, b - a)
        held = table.slice(turn[-1])
    if held is not None and held.num_rows:
        yield held


def _promising(threshold: float) -> float:
    """The share of equal coordinates under which the similarity is out of the question: four standard deviations below it."""
    return threshold - 4 * (threshold * (1 - threshold) / (BANDS * BAND_ROWS)) ** 0.5


def _cell_links(cell: pa.Table, threshold: float) -> list[tuple[bytes, bytes]]:
    """Links of a cell, the most alike pairs first; components that the cell has joined are not compared again."""
    side = cell.column("side").to_numpy()
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    sig = np.frombuffer(b"".join(cell.column("sig").to_pylist()), np.uint64).reshape(-1, BANDS * BAND_ROWS)
    bands = band_keys(sig)
    band = int(np.flatnonzero((bands == np.int64(cell.column("key")[0].as_py()).view(np.uint64)).any(0))[0])
    names, roots, left = (cell.column(c).to_pylist() for c in ("node", "root", "left"))
    least, out, joined, sets = _promising(threshold), [], {}, {}

    def top(r: bytes) -> bytes:
        while r in joined:
            r = joined[r]
        return r

    def shingle_set(at: int) -> tuple[np.ndarray, ...]:
        if at not in sets:
            raw = np.frombuffer(cell.column("text")[at].as_py().encode(), np.uint8)
            sets[at] = weighted_shingles(raw, np.array([0, len(raw)]))
        return sets[at]

    for i in one.tolist():
        share = (sig[i] == sig[two]).mean(1)
        ok = (share >= least) & ~(bands[i, :band] == bands[two, :band]).any(1)
        for at in sorted(np.flatnonzero(ok).tolist(), key=lambda x: -share[x]):
            q = int(two[at])
            if left[q] and names[i] >= names[q] or top(roots[i]) == top(roots[q]):
                continue
            if similarities(shingle_set(i), shingle_set(q), 1)[0] >= threshold:
                out.append((names[i], names[q]))
                joined[top(roots[i])] = top(roots[q])
    return out


def _links(open_: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """a, b: verified links that join the components of each bucket.

    Left nodes meet all nodes of their bucket, in blocks; a pair that shares several bands belongs to the first.  What signatures
    leave open is verified exactly.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _by_cell(batches):
            if found := _cell_links(cell, threshold):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*found)], names=["a", "b"])

    cells = _cells(open_, signed)
    n = open_.agg(F.sum(F.col("n_left") + F.when(F.col("left"), F.col("n_all")).otherwise(0))).first()[0]
    parts = max(int(signed.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // _CELL_ROWS)
    return cells.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side", "node").mapInArrow(run, "a binary, b binary")


def _linked(buckets: DataFrame, first: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Verified links by which all nodes of a bucket that are linked at all are in one component: those to hubs, then _links()."""
    hubs = written(_verified(first, texts, threshold), "dup-linked")
    roots = components(hubs)
    open_ = _open(buckets, roots)
    dropped(roots)
    if open_.isEmpty():
        dropped(open_)
        return hubs
    signed = _signatures(open_, texts)
    linked = written(hubs.union(_links(open_, signed, threshold)), "dup-linked")
    dropped(hubs, open_, signed)
    return linked


def classes(docs: DataFrame, *, threshold: float = 0.8, text: str = "text") -> DataFrame:
    """doc, hash, node, root, class_id of every row: class_id is the least doc_id of the rows linked to it, directly or through others.

    Rows are linked if the multisets of their shingles of five words (of all words, if there are fewer) have a weighted Jaccard
    similarity of `threshold` or more.  Rows without words, null texts among them, are alone.  The least of no but null ids is
    null.  Retrieval finds a pair of similarity 0.8 with probability 0.9999; what it finds is verified exactly.
    Ids may be null or repeated, so class_id does not tell classes apart; root, the least node of the class, does (null without words).
    Repeated rows and ties are in the class of their text; an empty table gives no rows; other columns are not read.
    """
    rows = _rows(docs, text)
    signed = _signed(rows)
    last = F.struct(F.col("doc").isNull().alias("none"), "doc", "hash")
    nodes = written(signed.filter(F.col("node").isNotNull()).groupBy("node").agg(F.min(last).alias("first"), F.max("bands").alias("bands")), "dup-nodes")
    buckets = _buckets(nodes)
    hubs = buckets.groupBy("key").agg(F.max_by("node", F.struct("score", "node")).alias("hub"))
    pairs = _told(buckets.select("key", "node"), hubs, "key", "node").filter("node != hub").groupBy("node", "hub").agg(F.count("*").alias("shared"))
    first = written(pairs.groupBy(F.col("node").alias("a")).agg(F.max_by("hub", F.struct("shared", "hub")).alias("b")), "dup-first")
    wanted = buckets.select("node").distinct().join(nodes.select("node", "first"), "node")
    named = lambda d: F.coalesce(d.cast("string"), F.lit("-"))
    wanted = wanted.select("node", F.col("first.hash").alias("hash"), named(F.col("first.doc")).alias("name"))
    texts = written(rows.withColumn("name", named(F.col("doc"))).dropDuplicates(["hash", "name"]).join(wanted, ["hash", "name"]).select("node", "text"), "dup-texts")
    linked = _linked(buckets, first, texts, threshold)
    dropped(buckets, first, texts)
    roots = components(linked)
    dropped(linked)
    of = nodes.select("node", F.col("first.doc").alias("doc")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = of.groupBy("root").agg(F.min("doc").alias("class_id"))
    member = _told(of, least, "root", "node").select("node", "root", "class_id")
    rows = signed.select("doc", "hash", "node")
    of_rows = _told(rows.filter("node is not null"), member, "node", "doc").select("doc", "hash", "node", "root", "class_id")
    none = rows.filter("node is null").select("doc", "hash", "node", F.lit(None).cast("binary").alias("root"), F.col("doc").alias("class_id"))
    out = written(of_rows.unionByName(none), "dup-classes")
    dropped(signed, nodes, roots)
    return out


def report(docs: DataFrame, *, threshold: float = 0.8) -> DataFrame:
    """doc_id, class_id of every row."""
    return classes(docs, threshold=threshold).select(F.col("doc").alias("doc_id"), "class_id")


def deduplicated(docs: DataFrame, *, threshold: float = 0.8, text: str = "text") -> DataFrame:
    """One row of each class, the one with the least id (nulls last), with its own columns, whatever their names; rows without
    words all stay, repeated rows with words are one class."""
    found = classes(docs, threshold=threshold, text=text)
    best = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "hash")).alias("k")
    name, hashed = unused("name", docs), unused("hash", docs)
    named = lambda d: F.coalesce(d.cast("string"), F.lit("-"))
    keep = found.filter("root is not null").groupBy("root").agg(best).select(named(F.col("k.doc")).alias(name), F.col("k.hash").alias(hashed))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.filter(body.rlike(_WORD)).withColumns({name: named(F.col("doc_id")), hashed: F.xxhash64(body)})
    chosen = rows.dropDuplicates([name, hashed]).join(keep.hint("merge"), [name, hashed], "left_semi")
    return chosen.select(*docs.columns).unionByName(docs.filter(~body.rlike(_WORD)))
