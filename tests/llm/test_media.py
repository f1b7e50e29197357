"""The media query over documents against a plain reading of its streams; formats, checks and seeking."""

import hashlib
import struct
import zlib

import pytest
from regionloom.llm import media as M

SF = "/root/testdata/sf0.001"
KBPS = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]


def plain_crc(bits):
    c = 0xFFFF
    for b in bits:
        top = c >> 15 ^ b
        c = c << 1 & 0xFFFF ^ (0x8005 if top else 0)
    return c


def bits_of(data):
    return [x >> k & 1 for x in data for k in range(7, -1, -1)]


def plain_stream(payload):
    """The documented layout, frame by frame: (stream, offsets of payload frames)."""

    def frame(index, body):
        head = bytes((0xFF, 0xFA, index << 4 | 8, 0xC0))
        length = 144 * KBPS[index] * 1000 // 32000
        crc = plain_crc(bits_of(head[2:]) + [0] * 136)
        return (head + struct.pack(">H", crc) + bytes(17) + body).ljust(length, b"\x00")

    room = [144 * k * 1000 // 32000 - 23 for k in KBPS]
    frames, rest = [], payload
    while len(rest) > room[14]:
        frames.append(frame(14, rest[: room[14]]))
        rest = rest[room[14] :]
    frames.append(frame(next(i for i in range(1, 15) if room[i] >= len(rest)), rest))
    total = 144 + sum(map(len, frames))
    places = [144 + sum(map(len, frames[:k])) for k in range(len(frames) + 1)]
    toc = bytes(min(255, 256 * places[p * len(frames) // 100] // total) for p in range(100))
    first = frame(1, b"Xing" + struct.pack(">III", 7, len(frames), total) + toc)
    fields = b""
    for name, value in (("payload_bytes", len(payload)), ("payload_crc32", zlib.crc32(payload))):
        body = b"\x00" + name.encode() + b"\x00" + str(value).encode()
        fields += b"TXXX" + struct.pack(">I", len(body)) + b"\x00\x00" + body
    n = len(fields)
    tag = b"ID3\x03\x00\x00" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + fields
    return tag + first + b"".join(frames), [len(tag) + p for p in places[:-1]]


def test_query_against_plain_streams(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = M.op4_media_columns(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = (docs[r["doc_id"]] or "").encode()
        payload = raw + b"\x00" * (-len(raw) % 64 if raw else 64)
        stream, offsets = plain_stream(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(stream))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(stream).hexdigest()
        assert r["frame_offsets"] == offsets and r["samples"] == 1152 * len(offsets)
        f = dict(x.split("=") for x in r["feature"].split(" ")[1:])
        seconds = M.Fraction(1152 * len(offsets), 32000)
        assert r["feature"].startswith("mpeg1-l3 ") and f["frames"] == str(len(offsets)) and f["table"] == "Xing:ok" and f["skipped"] == "0"
        assert f["seconds"] == f"{seconds.numerator}/{seconds.denominator}" and f["crc"] == f"{len(offsets) + 1}/{len(offsets) + 1}"


def test_seek():
    s = M.read_stream(M.write_stream(bytes(range(256)) * 64))
    for k, o in enumerate(s.offsets):
        assert s.seek(M.Fraction(1152 * k, 32000)) == s.seek(M.Fraction(1152 * k + 1151, 32000)) == o
    assert s.seek(-1) is None and s.seek(s.duration) is None and M.read_stream(b"").seek(0) is None


@pytest.mark.parametrize("layer,mode,allocated", [(1, 3, 128), (1, 0, 256), (1, 0x50 >> 4, 4 * (16 + 24)), (2, 3, None), (2, 0, None)])
def test_checksums_of_layers_one_and_two(layer, mode, allocated):
    """A frame whose allocation bits are set by hand; the CRC covers those (Layer II: and selection bits)."""
    four = bytes((0xFF, 0xF0 | 4 - layer << 1, 8 << 4, mode << 4 if mode > 3 else mode << 6))
    h = M.parse_header(four)
    body = bytearray(h.length - 6)
    if layer == 2:
        table, channels, at = M._allocation(h), 1 if h.mono else 2, 0
        field, used = [], 0
        for k, n in enumerate(table):
            for c in range(channels):
                on = k < 5 and c == 0
                field += [0] * (n - 1) + [int(on)]
                used += on
        bits = field + [1, 0] * used
        for at, b in enumerate(bits):
            body[at // 8] |= b << 7 - at % 8
        allocated = len(bits)
    else:
        body[:32] = bytes(range(7, 39))
    crc = plain_crc(bits_of(four[2:]) + bits_of(body)[:allocated])
    frame = four + struct.pack(">H", crc) + bytes(body)
    s = M.read_stream(frame * 3)
    assert (s.frames, s.crc_ok, s.crc_bad, s.layer) == (3, 3, 0, layer)
    late = bytearray(frame)
    late[6 + allocated // 8 + 1] ^= 1  # after what the CRC covers
    early = bytearray(frame)
    early[6] ^= 128 if layer == 1 else 16
    s = M.read_stream(bytes(late) + bytes(early) + frame)
    assert (s.crc_ok, s.crc_bad) == (2, 1)


def test_free_format_and_vbri():
    free = b"".join(bytes((0xFF, 0xFB, pad << 1, 0xC0)) + bytes(396 + pad) for pad in (0, 1, 0, 0, 1))
    s = M.read_stream(b"junk" + free)
    assert s.frames == 5 and s.offsets == [4, 404, 805, 1205, 1605] and s.skipped == 4 and s.free == 400
    plain = bytes((0xFF, 0xFB, 0x90, 0xC4))
    frames = [plain + bytes(413) for _ in range(8)]
    head = plain + bytes(32) + b"VBRI" + bytes(6) + struct.pack(">II", 417 * 9, 8) + struct.pack(">4H", 4, 1, 2, 2)
    right = (head + struct.pack(">4H", 834, 834, 834, 834)).ljust(417, b"\x00")
    wrong = (head + struct.pack(">4H", 834, 835, 834, 834)).ljust(417, b"\x00")
    assert M.read_stream(right + b"".join(frames)).table_agrees and not M.read_stream(wrong + b"".join(frames)).table_agrees
