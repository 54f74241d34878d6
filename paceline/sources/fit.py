"""A reader of the record messages of FIT files (a public, self-describing binary protocol)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

EPOCH = 631_065_600  # seconds from 1970 to the protocol's epoch, 1989-12-31
RECORD = 20
TIMESTAMP = 253

#: fixed values: base types by their low five bits: struct code and the value that stands for none
BASE = {
    0: ("B", 0xFF), 1: ("b", 0x7F), 2: ("B", 0xFF), 3: ("h", 0x7FFF), 4: ("H", 0xFFFF), 5: ("i", 0x7FFFFFFF), 6: ("I", 0xFFFFFFFF),
    7: ("s", None), 8: ("f", None), 9: ("d", None), 10: ("B", 0), 11: ("H", 0), 12: ("I", 0), 13: ("B", 0xFF), 14: ("q", 2**63 - 1), 15: ("Q", 2**64 - 1), 16: ("Q", 0),
}
SEMICIRCLE = 180 / 2**31
#: fixed values: fields of a record: channel, factor, offset; a later one of the same channel wins
FIELDS = {
    0: ("latitude", SEMICIRCLE, 0.0), 1: ("longitude", SEMICIRCLE, 0.0), 2: ("elevation", 1 / 5, -500.0), 3: ("heartrate", 1.0, 0.0), 4: ("cadence", 1.0, 0.0),
    5: ("distance", 1 / 100, 0.0), 6: ("speed", 1 / 1000, 0.0), 7: ("watts", 1.0, 0.0), 73: ("speed", 1 / 1000, 0.0), 78: ("elevation", 1 / 5, -500.0),
}


def _value(raw: bytes, base: int, order: str) -> float | None:
    code, none = BASE.get(base & 0x1F, ("s", None))
    if code == "s" or struct.calcsize(code) > len(raw):
        return None
    (x,) = struct.unpack_from(order + code, raw)
    return None if x == none or x != x else float(x)


def fit_records(content: bytes) -> Iterator[dict[str, float]]:
    """The record messages that have a time, as channels; files joined one after another are read through."""
    at = 0
    if len(content) < 12:
        raise ValueError("no FIT file")
    while at + 12 <= len(content):
        head = content[at]
        if head not in (12, 14) or content[at + 8 : at + 12] != b".FIT":
            if at == 0:
                raise ValueError("no FIT file")
            return
        end = at + head + int.from_bytes(content[at + 4 : at + 8], "little")
        yield from _messages(content, at + head, min(end, len(content)))
        at = end + 2


def _messages(content: bytes, at: int, end: int) -> Iterator[dict[str, float]]:
    kinds: dict[int, tuple[int, str, list[tuple[int, int, int]], int]] = {}
    clock = None
    while at < end:
        head = content[at]
        at += 1
        if head & 0x80:  # a data message with five bits of time
            local = head >> 5 & 3
        elif head & 0x40:
            order = ">" if content[at + 1] else "<"
            number = int.from_bytes(content[at + 2 : at + 4], "big" if order == ">" else "little")
            n = content[at + 4]
            fields = [tuple(content[at + 5 + 3 * i : at + 8 + 3 * i]) for i in range(n)]
            at += 5 + 3 * n
            extra = 0
            if head & 0x20:
                extra = sum(content[at + 2 + 3 * i] for i in range(content[at]))
                at += 1 + 3 * content[at]
            kinds[head & 15] = (number, order, fields, extra)
            continue
        else:
            local = head & 15
        if local not in kinds:
            raise ValueError(f"data without a definition at {at}")
        number, order, fields, extra = kinds[local]
        values = {}
        for field, size, base in fields:
            values[field] = _value(content[at : at + size], base, order)
            at += size
        at += extra
        if at > end:
            return
        if values.get(TIMESTAMP) is not None:
            clock = int(values[TIMESTAMP])
        elif head & 0x80 and clock is not None:
            clock += (head & 31) - clock & 31
        if number == RECORD and clock is not None and (TIMESTAMP in values or head & 0x80):
            out = {"time_s": float(clock + EPOCH)}
            for field in sorted(values):
                if field in FIELDS and values[field] is not None:
                    name, factor, offset = FIELDS[field]
                    out[name] = values[field] * factor + offset
            yield out
