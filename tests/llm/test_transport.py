import hashlib
import random
import zlib

from paceline.llm import transport as ts


def test_payloads_come_back_and_points_are_marked():
    rng = random.Random(3)
    for n in (0, 1, 63, 64, 65, 161, 162, 163, 176, 183, 184, 185, 5000, 32768, 32769, 700_001):
        data = ts.padded(rng.randbytes(n))
        media = ts.pack(data)
        assert len(media) % 188 == 0 and media[::188] == b"\x47" * (len(media) // 188)
        found = ts.demux(media)
        assert found["programs"] == {1: {ts.DATA_PID: ts.PRIVATE_DATA}}
        s = found["streams"][ts.DATA_PID]
        assert s["payload"] == data and s["counter_errors"] == s["duplicates"] == s["broken"] == found["lost_sync"] == 0
        units = s["units"]
        assert [u["pts"] for u in units] == [k * 3600 for k in range(len(units))]
        assert [u["random_access"] for u in units] == [k % 8 == 0 for k in range(len(units))]


def plainly_read(media, pid):
    """The elementary data of one stream and its timestamps, byte by byte, after the standard's syntax tables alone."""
    data, stamps, pes = b"", [], b""

    def close(pes):
        nonlocal data
        if not pes:
            return
        assert pes[:3] == b"\0\0\1" and pes[6] >> 6 == 2
        assert int.from_bytes(pes[4:6], "big") in (0, len(pes) - 6)
        if pes[7] & 0x80:
            t = pes[9:14]
            assert t[0] & 1 and t[2] & 1 and t[4] & 1
            stamps.append((t[0] >> 1 & 7) << 30 | t[1] << 22 | t[2] >> 1 << 15 | t[3] << 7 | t[4] >> 1)
        data += pes[9 + pes[8] :]

    counter = None
    for at in range(0, len(media), 188):
        p = media[at : at + 188]
        assert p[0] == 0x47 and not p[1] & 0x80
        if (p[1] & 31) << 8 | p[2] != pid:
            continue
        body = 4 + (1 + p[4] if p[3] & 0x20 else 0)
        if not p[3] & 0x10:
            continue
        assert counter is None or p[3] & 15 == (counter + 1) % 16
        counter = p[3] & 15
        if p[1] & 0x40:
            close(pes)
            pes = b""
        pes += p[body:]
    close(pes)
    return data, stamps


def test_a_plain_reader_finds_the_same_payload():
    rng = random.Random(5)
    for n in (0, 64, 170, 5000, 32769, 400_000):
        data = ts.padded(rng.randbytes(n))
        got, stamps = plainly_read(ts.pack(data), ts.DATA_PID)
        assert got == data and stamps == [k * 3600 for k in range(len(stamps))]


def test_crc_matches_the_published_check_value():
    assert ts.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_damage_is_counted():
    data = bytes(range(256)) * 40
    packets = [ts.pack(data)[i : i + 188] for i in range(0, len(ts.pack(data)), 188)]
    lost = ts.demux(b"".join(packets[:10] + packets[11:]))["streams"][ts.DATA_PID]
    assert lost["counter_errors"] == 1 and len(lost["payload"]) == len(data) - 184
    twice = ts.demux(b"".join(packets[:10] + packets[9:]))["streams"][ts.DATA_PID]
    assert twice["duplicates"] == 1 and twice["payload"] == data
    bad = bytearray(packets[0])
    bad[9] ^= 1
    assert ts.demux(bytes(bad) + b"".join(packets[1:]))["streams"] == {}
    assert ts.demux(b"")["streams"] == {} and ts.demux(b"x" * 400)["lost_sync"] == 2


def test_column_round_trip(spark):
    texts = ["", None, "a", "é" * 100, "x" * 200_000, "a"]
    df = spark.createDataFrame([(i, t, "m") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {r.doc_id: r for r in ts.unpacked(ts.packed(df), payloads=True).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        r, want = got[i], ts.padded(raw)
        assert (r.n_bytes, r.payload_bytes, bytes(r.payload)) == (len(raw), len(want), want)
        assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-64:])
    assert got[2][2:] == got[5][2:]
    assert ts.unpacked(ts.packed(df.limit(0))).collect() == []
