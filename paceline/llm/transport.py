"""Media columns: MPEG transport streams (ISO/IEC 13818-1).

pack() stores bytes as the private data stream of a program: access units in PES packets
with timestamps, clock references and random-access points, tables repeated before each
random-access point.  demux() reads any transport stream: program tables with their CRC,
continuity counters, elementary packets, timestamps and random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrowtext import text_runs

PACKET, SYNC = 188, 0x47
PMT_PID, DATA_PID, PRIVATE_DATA = 0x1000, 0x0100, 0x06
UNIT_BYTES, UNITS_BETWEEN_POINTS, TICKS = 32768, 8, 3600
UNITS = "array<struct<pts:bigint,dts:bigint,offset:bigint,bytes:bigint,packet:bigint,random_access:boolean>>"


@lru_cache(maxsize=4096)
def crc32_mpeg(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + ident.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes, counter: int) -> bytes:
    out = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10 | counter & 15, 0]) + section
    return out.ljust(PACKET, b"\xff")


_PAT = _section(0x00, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(0x02, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")


def _pes(unit: bytes, pts: int) -> bytes:
    stamp = bytes([0x21 | (pts >> 30 & 7) << 1]) + ((pts >> 15 & 0x7FFF) << 1 | 1).to_bytes(2, "big") + ((pts & 0x7FFF) << 1 | 1).to_bytes(2, "big")
    return b"\x00\x00\x01\xbd" + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + stamp + unit


def pack(payload: bytes) -> bytes:
    """A transport stream that holds the payload; equal payloads give equal streams."""
    out, counter, tables = [], 0, 0
    for k, at in enumerate(range(0, max(1, len(payload)), UNIT_BYTES)):
        point = k % UNITS_BETWEEN_POINTS == 0
        if point:
            out += [_table_packet(0, _PAT, tables), _table_packet(PMT_PID, _PMT, tables)]
            tables += 1
        pts = k * TICKS & 0x1FFFFFFFF
        pes = np.frombuffer(_pes(payload[at : at + UNIT_BYTES], pts), np.uint8)
        first = min(len(pes), 176)
        body = -(-(len(pes) - first) // 184)
        packets = np.full((1 + body, PACKET), 0xFF, np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (counter + np.arange(1 + body)) & 15
        packets[0, 3] |= 0x20  # the first packet of a unit has an adaptation field: flags, clock reference, stuffing
        packets[0, 4] = 183 - first
        packets[0, 5] = 0x10 | (0x40 if point else 0)
        packets[0, 6:12] = np.frombuffer((pts << 15 | 0x7E00).to_bytes(6, "big"), np.uint8)
        packets[0, PACKET - first :] = pes[:first]
        if body:
            rest = pes[first:]
            full = len(rest) // 184
            packets[1 : 1 + full, 4:] = rest[: full * 184].reshape(full, 184)
            if full < body:
                left = len(rest) - full * 184
                packets[-1, 3] |= 0x20
                packets[-1, 4] = 183 - left
                if left < 183:
                    packets[-1, 5] = 0
                packets[-1, PACKET - left :] = rest[full * 184 :]
        counter = counter + 1 + body & 15
        out.append(packets.tobytes())
    return b"".join(out)


def _sections(rows: np.ndarray, start: np.ndarray, begin: np.ndarray) -> list[bytes]:
    """The sections of the packets of one PID whose CRC is right."""
    out, buf = [], b""

    def take(buf: bytes) -> bytes:
        while len(buf) >= 3 and buf[0] != 0xFF:
            size = 3 + (int.from_bytes(buf[1:3], "big") & 0xFFF)
            if len(buf) < size:
                return buf
            if size >= 12 and crc32_mpeg(buf[: size - 4]) == int.from_bytes(buf[size - 4 : size], "big"):
                out.append(buf[:size])
            buf = buf[size:]
        return b""

    for row, pusi, at in zip(rows, start.tolist(), begin.tolist()):
        data = row[at:].tobytes()
        if pusi and data:
            pointer = data[0]
            if buf:
                take(buf + data[1 : 1 + pointer])
            buf = take(data[1 + pointer :])
        elif buf:
            buf = take(buf + data)
    return out


def _stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | (b[1] << 8 | b[2]) >> 1 << 15 | (b[3] << 8 | b[4]) >> 1


def demux(data: bytes) -> dict:
    """{"programs": {number: {pid: stream type}}, "streams": {pid: {...}}, "lost_sync": packets without a sync byte}.

    Of each stream: type, payload (the elementary packets' data joined), units (pts, dts or None, offset and bytes in the
    payload, packet number, random_access), packets, counter_errors, duplicates (a repeated packet is dropped), broken
    (elementary packets without a start code).  An incomplete packet at the end is ignored.
    """
    n = len(data) // PACKET
    rows = np.frombuffer(data, np.uint8, n * PACKET).reshape(n, PACKET)
    good = (rows[:, 0] == SYNC) & (rows[:, 1] & 0x80 == 0)
    number = np.flatnonzero(good)
    rows = rows[good]
    pid = (rows[:, 1].astype(np.int64) & 0x1F) << 8 | rows[:, 2]
    control = rows[:, 3] >> 4 & 3
    begin = np.where(control & 2, 5 + rows[:, 4].astype(np.int64), 4)
    begin = np.minimum(np.where(control & 1, begin, PACKET), PACKET)
    pusi = rows[:, 1] & 0x40 != 0
    flags = np.where((control & 2 != 0) & (rows[:, 4] > 0), rows[:, 5], 0)
    programs: dict[int, dict[int, int]] = {}
    at = pid == 0
    for s in _sections(rows[at], pusi[at], begin[at]):
        for x in range(8, len(s) - 4, 4):
            program, table = int.from_bytes(s[x : x + 2], "big"), int.from_bytes(s[x + 2 : x + 4], "big") & 0x1FFF
            if program and program not in programs:
                programs[program] = {}
                of = pid == table
                for t in _sections(rows[of], pusi[of], begin[of]):
                    y = 12 + (int.from_bytes(t[10:12], "big") & 0xFFF)
                    while t[0] == 2 and int.from_bytes(t[3:5], "big") == program and y + 5 <= len(t) - 4:
                        programs[program][int.from_bytes(t[y + 1 : y + 3], "big") & 0x1FFF] = t[y]
                        y += 5 + (int.from_bytes(t[y + 3 : y + 5], "big") & 0xFFF)
    streams = {}
    for p, kind in {p: k for by in programs.values() for p, k in by.items()}.items():
        mine = np.flatnonzero(pid == p)
        counter, has = rows[mine, 3] & 15, control[mine] & 1 != 0
        step = np.diff(counter.astype(np.int64), prepend=counter[:1]) & 15
        again = np.zeros(len(mine), bool)
        if len(mine) > 1:
            maybe = np.flatnonzero(has[1:] & has[:-1] & (step[1:] == 0)) + 1
            again[maybe] = (rows[mine[maybe]][:, 12:] == rows[mine[maybe - 1]][:, 12:]).all(axis=1)
        errors = int((((step != has) & ~again & (flags[mine] & 0x80 == 0))[1:]).sum())
        mine = mine[~again]
        data_rows, b = rows[mine], begin[mine]
        flat = data_rows[np.arange(PACKET) >= b[:, None]].tobytes()
        off = np.concatenate([[0], np.cumsum(PACKET - b)])
        heads = np.flatnonzero(pusi[mine])
        units, parts, size, broken = [], [], 0, 0
        for h, nxt in zip(heads.tolist(), [*heads[1:].tolist(), len(mine)]):
            lo, hi = int(off[h]), int(off[nxt])
            if hi - lo < 9 or flat[lo : lo + 3] != b"\x00\x00\x01":
                broken += 1
                continue
            length, marks, extra = int.from_bytes(flat[lo + 4 : lo + 6], "big"), flat[lo + 7], flat[lo + 8]
            stop = min(hi, lo + 6 + length) if length else hi
            pts = _stamp(flat[lo + 9 : lo + 14]) if marks & 0x80 else None
            dts = _stamp(flat[lo + 14 : lo + 19]) if marks & 0xC0 == 0xC0 else None
            body = flat[lo + 9 + extra : stop]
            units.append({"pts": pts, "dts": dts, "offset": size, "bytes": len(body), "packet": int(number[mine[h]]), "random_access": bool(flags[mine[h]] & 0x40)})
            parts.append(body)
            size += len(body)
        streams[p] = {"type": kind, "payload": b"".join(parts), "units": units, "packets": len(mine), "counter_errors": errors, "duplicates": int(again.sum()), "broken": broken}
    return {"programs": programs, "streams": streams, "lost_sync": n - int(good.sum())}


def padded(data: bytes, unit: int = 64) -> bytes:
    """data with bytes 0 up to a positive multiple of `unit`."""
    return data.ljust(max(unit, -(-len(data) // unit) * unit), b"\0")


def packed(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, media: each whole text as UTF-8, padded, in a transport stream.

    Null texts are empty; equal texts give equal media; repeated rows and null ids are rows of their own; an empty table gives no
    rows.  A very long text is one row with its media and takes about three times its size in the worker.  Other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in text_runs(batches, text):
            raw = data.tobytes()
            media = [pack(padded(raw[a:b])) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
            yield pa.RecordBatch.from_arrays([part.column(doc_id), pa.array(off[1:] - off[:-1]), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def unpacked(media: DataFrame, *, payloads: bool = False) -> DataFrame:
    """What demux() finds in the column `media`, beside the other columns: sizes and digests of the joined payload of the
    first program's streams, units with timestamps and random-access points, counts of errors, feature, and on demand the payload.
    Null or broken media give an empty payload; repeated rows are rows of their own; an empty table gives no rows.  Other columns
    pass through, but for those named like one of the result, which are replaced.
    """
    told = "payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature counter_errors units payload".split()
    media = media.select(*[c for c in media.columns if c.lower() not in told])
    others = [f for f in media.schema.fields if f.name != "media"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    more = f"payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, counter_errors long, units {UNITS}"
    unit = pa.list_(pa.struct([("pts", pa.int64()), ("dts", pa.int64()), ("offset", pa.int64()), ("bytes", pa.int64()), ("packet", pa.int64()), ("random_access", pa.bool_())]))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), unit, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            at = batch.schema.names.index("media")
            for cell in batch.column(at):
                raw = cell.as_py() or b""
                found = demux(raw)
                streams = found["streams"]
                payload = b"".join(s["payload"] for _, s in sorted(streams.items()))
                units = [u for _, s in sorted(streams.items()) for u in s["units"]]
                errors = sum(s["counter_errors"] for s in streams.values())
                stamps = [u["pts"] for u in units if u["pts"] is not None]
                feature = ";".join((f"programs={len(found['programs'])}", "streams=" + ",".join(f"{p}:{s['type']}" for p, s in sorted(streams.items())), f"packets={len(raw) // PACKET}", f"units={len(units)}", f"points={sum(u['random_access'] for u in units)}", f"pts={min(stamps, default=0)}-{max(stamps, default=0)}", f"errors={errors + found['lost_sync']}"))
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), feature, errors, units, payload))
            cols = list(zip(*out)) if out else [[]] * 9
            keep = 9 if payloads else 8
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(batch.num_columns) if i != at] + [pa.array(c, k) for c, k in zip(cols[:keep], kinds)], names=[n for n in batch.schema.names if n != "media"] + told[:keep])

    return media.mapInArrow(run, ", ".join(x for x in (schema, more, "payload binary" if payloads else "") if x))
