"""Media columns: MPEG audio frames that carry a payload, and a reader of such streams.

Writing. A payload becomes an MPEG-1 Layer III stream (mono, 32 kHz, CRC on): an ID3v2 tag with the
payload's length and CRC-32, a VBR table frame, then silent frames whose main-data bytes are the
payload. Frames have the largest bitrate until the rest fits; the last takes the smallest that holds
it, so the stream is a variable-bitrate one.

Reading works on any MPEG-1/2/2.5 Layer I-III stream, free-format ones included (their frame length is
the distance of the first two agreeing headers). Leading ID3v2 tags (also several) and a trailing ID3v1
tag (one that no frame covers) are parsed. A header counts as one only if the frame's end meets another
agreeing header, the tags or the end of the stream; anything else is skipped byte by byte until that holds
again. The VBR table ('Xing'/'Info', 'VBRI') is read from the first frame, its seek points are compared
with the frames found, CRC-16 is verified where a frame has it (over the header and, by layer, bit
allocation, scale factor selection or side information), durations are exact rationals and the byte offset
of every frame is kept: `Stream.seek` gives the frame that holds a time.

Edge cases. Null and empty texts are 64 zero bytes. A stream without a frame gives 0 frames, 0
samples and no payload. Equal texts, so also repeated rows, give equal bytes and features. Each row is handled on
its own, a very long text as one long stream. Result columns replace input columns of the same name; an empty
table has an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from fractions import Fraction
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import table

BLOCK = 64
FREE_BYTES = 1 << 14  # a free-format frame's end is looked for within
PROTECTED = 64  # bytes after the CRC that it can cover: 30 subbands, two channels of 4 + 2 bits
RATE = 32_000
#: Fixed values of the format: kbit/s by bitrate index (1-14), by (MPEG-1?, layer).
KBPS = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
#: Fixed values of the format: sample rates by version bits.
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    crc: bool
    kbps: int
    rate: int
    mono: bool
    length: int  # 0: free format
    samples: int
    padding: int = 0  # bytes
    joint: int = 0  # subbands that joint stereo leaves apart; 32 without it

    def agrees(self, other: Header | None) -> bool:
        return other is not None and (other.version, other.layer, other.rate, not other.length) == (self.version, self.layer, self.rate, not self.length)

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


@lru_cache(maxsize=4096)
def parse_header(four: bytes) -> Header | None:
    """A frame header, or None if the four bytes are not one."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    index, rate_index, padding = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
    if version == 1 or layer == 4 or index == 15 or rate_index == 3 or four[3] & 3 == 2:
        return None
    one = version == 3
    kbps, rate = index and KBPS[one, layer][index - 1], RATES[version][rate_index]
    samples = 384 if layer == 1 else 576 if layer == 3 and not one else 1152
    padding *= 4 if layer == 1 else 1
    length = kbps and (12000 * kbps // rate * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate) + padding
    joint = 4 * (four[3] >> 4 & 3) + 4 if four[3] >> 6 == 1 else 32
    return Header(version, layer, not four[1] & 1, kbps, rate, four[3] >> 6 == 3, length, samples, padding, joint)


#: Fixed values of the format: bits of allocation by subband in Layer II, for the tables that rates choose.
ALLOCATION = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4,
    "b": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "c": (4,) * 2 + (3,) * 6,
    "d": (4,) * 2 + (3,) * 10,
    "low": (4,) * 4 + (3,) * 7 + (2,) * 19,
}


def _allocation(h: Header) -> tuple[int, ...]:
    if h.version != 3:
        return ALLOCATION["low"]
    each = h.kbps // (1 if h.mono else 2)
    if h.kbps and each <= 48:
        return ALLOCATION["d" if h.rate == 32000 else "c"]
    return ALLOCATION["a" if h.rate == 48000 or h.kbps and each <= 80 else "b"]


def protected_bits(h: Header, body: bytes) -> int:
    """How many bits after the CRC it covers."""
    channels = 1 if h.mono else 2
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 4 * (h.joint * channels + 32 - h.joint)
    bits, at, used = int.from_bytes(body), 8 * len(body), 0
    for k, n in enumerate(_allocation(h)):
        for _ in range(channels if k < h.joint else 1):
            at -= n
            if at < 0:
                return 8 * len(body)
            if bits >> at & (1 << n) - 1:
                used += 1 if k < h.joint else channels
    return 8 * len(body) - at + 2 * used


@lru_cache(maxsize=65536)
def crc16(data: bytes, bits: int | None = None) -> int:
    """MPEG audio CRC of all or the leading bits: polynomial 8005 (hex), start FFFF."""
    c, left = 0xFFFF, 8 * len(data) if bits is None else bits
    for byte in data:
        c ^= byte << 8 if left >= 8 else (byte >> 8 - left << 8 - left) << 8
        for _ in range(min(8, left)):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        left -= min(8, left)
    return c


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _tag(fields: dict[str, str]) -> bytes:
    frames = b""
    for name, value in fields.items():
        body = b"\x00" + name.encode() + b"\x00" + value.encode()
        frames += b"TXXX" + struct.pack(">IH", len(body), 0) + body
    return b"ID3\x03\x00\x00" + _synchsafe(len(frames)) + frames


_HEADS: list[tuple[int, bytes]] = []  # frame length, its first 23 bytes, ascending
for _i in range(1, 15):
    _four = bytes((0xFF, 0xFA, _i << 4 | 2 << 2, 0xC0))
    _side = bytes(17)
    _HEADS.append((parse_header(_four).length, _four + struct.pack(">H", crc16(_four[2:] + _side)) + _side))
_HEAD = 23


def write_stream(payload: bytes) -> bytes:
    """The stream that carries `payload`."""
    largest, head = _HEADS[-1]
    room = largest - _HEAD
    frames = [head + payload[a : a + room] for a in range(0, len(payload) - room, room)]
    rest = payload[len(frames) * room :]
    length, head = next(x for x in _HEADS if x[0] - _HEAD >= len(rest))
    frames.append(head + rest.ljust(length - _HEAD, b"\x00"))
    first, total = _HEADS[0][0], _HEADS[0][0] + sum(map(len, frames))
    ends = [first]
    for f in frames:
        ends.append(ends[-1] + len(f))
    toc = bytes(min(255, 256 * ends[p * len(frames) // 100] // total) for p in range(100))
    table_frame = (_HEADS[0][1] + b"Xing" + struct.pack(">III", 7, len(frames), total) + toc).ljust(first, b"\x00")
    tag = _tag({"payload_bytes": str(len(payload)), "payload_crc32": str(zlib.crc32(payload))})
    return tag + table_frame + b"".join(frames)


@dataclass
class Stream:
    """What a stream holds: tags, table, frames, offsets, checks."""

    tags: dict[str, str] = field(default_factory=dict)
    table: str = ""
    table_frames: int = 0
    table_bytes: int = 0
    toc: bytes = b""
    version: int = 0
    layer: int = 0
    rate: int = 0
    channels: int = 0
    frames: int = 0
    samples: int = 0
    kbps: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    crc_ok: int = 0
    crc_bad: int = 0
    skipped: int = 0
    body: bytes = b""
    free: int = 0  # bytes of a free-format frame without padding
    points: list[int] = field(default_factory=list)  # VBRI: bytes between its seek points
    point_frames: int = 0
    start: int = 0  # of the frame with the table, or of the first

    @property
    def duration(self) -> Fraction:
        return Fraction(self.samples, self.rate) if self.rate else Fraction(0)

    def seek(self, seconds: Fraction | float) -> int | None:
        """The byte offset of the frame that holds a time; None outside the stream."""
        if not self.frames or not 0 <= seconds < self.duration:
            return None
        return self.offsets[int(Fraction(seconds) * self.rate) * self.frames // self.samples]

    @property
    def table_agrees(self) -> bool:
        """Do the table's number of frames and seek points fit the frames found?"""
        if not self.table or self.table_frames and self.table_frames != self.frames:
            return False
        if self.points:
            wanted, at = self.offsets[self.point_frames :: self.point_frames], self.offsets[0] if self.offsets else 0
            return all(w == at + n for w, n in zip(wanted, accumulate(self.points)))
        if len(self.toc) == 100 and self.offsets and self.table_bytes:
            places = [256 * (self.offsets[p * self.frames // 100] - self.start) // self.table_bytes for p in range(100)]
            return all(abs(min(255, x) - y) <= 1 for x, y in zip(places, self.toc))
        return True


def _id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Parse a tag at `at`; its end, or `at` if there is none."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or any(x & 0x80 for x in data[at + 6 : at + 10]):
        return at
    n = data[at + 6] << 21 | data[at + 7] << 14 | data[at + 8] << 7 | data[at + 9]
    p, end = at + 10, min(len(data), at + 10 + n)
    safe = data[at + 3] >= 4
    while p + 10 <= end and data[p : p + 1] != b"\x00":
        raw = data[p + 4 : p + 8]
        size = raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3] if safe else int.from_bytes(raw)
        name, body = data[p : p + 4].decode("latin-1"), data[p + 10 : min(end, p + 10 + size)]
        if name == "TXXX" and body:
            key, _, value = body[1:].partition(b"\x00")
            tags[key.decode("utf-8", "replace")] = value.decode("utf-8", "replace")
        elif name[:1] == "T" and body:
            tags[name] = body[1:].decode("latin-1").rstrip("\x00")
        p += 10 + size
    return end


def _table(s: Stream, data: bytes, at: int, h: Header) -> bool:
    """Read a VBR table from the frame at `at`."""
    p = at + 4 + 2 * h.crc + h.side
    kind = data[p : p + 4]
    if kind in (b"Xing", b"Info") and len(data) >= p + 8:
        flags, q = int.from_bytes(data[p + 4 : p + 8]), p + 8
        s.table = kind.decode()
        if flags & 1:
            s.table_frames, q = int.from_bytes(data[q : q + 4]), q + 4
        if flags & 2:
            s.table_bytes, q = int.from_bytes(data[q : q + 4]), q + 4
        if flags & 4:
            s.toc = data[q : q + 100]
        return True
    p = at + 4 + 32
    if data[p : p + 4] == b"VBRI" and len(data) >= p + 26:
        s.table, s.table_bytes, s.table_frames = "VBRI", int.from_bytes(data[p + 10 : p + 14]), int.from_bytes(data[p + 14 : p + 18])
        n, scale, size, s.point_frames = struct.unpack(">4H", data[p + 18 : p + 26])
        if size in (1, 2, 3, 4) and s.point_frames and len(data) >= p + 26 + n * size:
            s.points = [scale * int.from_bytes(data[q : q + size]) for q in range(p + 26, p + 26 + n * size, size)]
        return True
    return False


def _free_length(data: bytes, at: int, h: Header) -> int:
    """Bytes of the free-format frame at `at` without padding, by the next agreeing header; 0 if none is near."""
    p = at + 4
    while 0 <= (p := data.find(b"\xff", p, at + FREE_BYTES)):
        if h.agrees(n := parse_header(data[p : p + 4])) and n.mono == h.mono:
            size = p - at - h.padding
            end = p + size + n.padding
            if end == len(data) or h.agrees(parse_header(data[end : end + 4])):
                return size
        p += 1
    return 0


def read_stream(data: bytes) -> Stream:
    """Parse a stream, resynchronising over anything that is not a frame."""
    s, at, end = Stream(), 0, len(data)
    while (nxt := _id3v2(data, at, s.tags)) != at:
        at = nxt
    tag = end - 128 if end - at >= 128 and data[end - 128 : end - 125] == b"TAG" else end  # unless a frame covers it
    body, locked = [], False
    while at + 4 <= tag:
        h = parse_header(data[at : at + 4])
        if h and not h.length:
            s.free = s.free or _free_length(data, at, h)
            h = replace(h, length=s.free + h.padding, kbps=s.free * 8 * h.rate // (h.samples * 1000)) if s.free else None
        stop = at + h.length if h else 0
        agrees = False
        if h and stop <= end and (not s.rate or (h.version, h.layer, h.rate) == (s.version, s.layer, s.rate)):
            after = parse_header(data[stop : stop + 4]) if stop + 4 <= end else None
            follows = after is not None and (after.version, after.layer, after.rate) == (h.version, h.layer, h.rate)
            agrees = follows or stop == end or stop == tag or (locked and stop < tag)
        if not agrees:
            s.skipped, locked = s.skipped + 1, False
            nxt = data.find(b"\xff", at + 1, tag)
            s.skipped += (nxt if nxt >= 0 else tag) - at - 1
            at = nxt if nxt >= 0 else tag
            continue
        locked = True
        if stop > tag:
            tag = end
        if not s.rate:
            s.version, s.layer, s.rate, s.channels = h.version, h.layer, h.rate, 1 if h.mono else 2
        start = at + 4 + 2 * h.crc
        if not s.frames and not s.table:
            s.start = at
        if h.crc:
            covered = data[start : min(stop, start + PROTECTED)]
            bits = 16 + protected_bits(h, covered)
            good = crc16(data[at + 2 : at + 4] + covered[: -(-bits // 8) - 2], bits) == int.from_bytes(data[at + 4 : at + 6])
            s.crc_ok, s.crc_bad = s.crc_ok + good, s.crc_bad + (not good)
        if not s.frames and not s.table and _table(s, data, at, h):
            at = stop
            continue
        s.frames, s.samples = s.frames + 1, s.samples + h.samples
        s.kbps.append(h.kbps)
        s.offsets.append(at)
        body.append(data[start + h.side : stop])
        at = stop
    if tag < end:
        s.tags["id3v1"] = data[tag + 3 : tag + 33].rstrip(b"\x00 ").decode("latin-1")
    s.skipped += max(0, tag - at)
    s.body = b"".join(body)
    return s


def payload_of(s: Stream) -> bytes | None:
    """The payload that `write_stream` stored, if its length and checksum hold."""
    n, crc = s.tags.get("payload_bytes", ""), s.tags.get("payload_crc32", "")
    if not (n.isdigit() and crc.isdigit()) or len(s.body) < int(n):
        return None
    payload = s.body[: int(n)]
    return payload if zlib.crc32(payload) == int(crc) else None


def feature(s: Stream) -> str:
    """One line: format, frames, exact duration, bitrates, checks, table and seek offsets."""
    seek = hashlib.sha256(",".join(map(str, s.offsets)).encode()).hexdigest()[:16]
    d = s.duration
    kbps = f"{min(s.kbps)}-{max(s.kbps)}" if s.kbps else "-"
    return (
        f"mpeg{ {3: '1', 2: '2', 0: '2.5'}[s.version] }-l{s.layer} rate={s.rate} channels={s.channels} frames={s.frames} "
        f"samples={s.samples} seconds={d.numerator}/{d.denominator} kbps={kbps} crc={s.crc_ok}/{s.crc_ok + s.crc_bad} "
        f"table={s.table or '-'}{':ok' if s.table_agrees else ''} skipped={s.skipped} seek={seek}"
    )


def padded(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length of a text, and its bytes padded with zeros to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(1, -(-len(raw) // BLOCK)) * BLOCK, b"\x00")


def _append(rows: DataFrame, names_types: list[tuple[str, T.DataType]], made) -> DataFrame:
    """`rows` plus columns that `made(value of each row's input)` yields as tuples."""
    names = [n for n, _ in names_types]
    keep = [c for c in rows.columns if c not in names]
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(n, t) for n, t in names_types])
    source, make = made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema)
        for batch in batches:
            cols = list(zip(*[make(x.as_py()) for x in batch.column(source)])) or [[] for _ in names]
            new = [pa.array(list(c), kinds.field(n).type) for n, c in zip(names, cols)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], [*keep, *names])

    return rows.mapInArrow(run, schema)


def encode_media(docs: DataFrame) -> DataFrame:
    """`docs` plus media (binary): each text's payload as a stream."""
    return _append(docs, [("media", T.BinaryType())], ("text", lambda t: (write_stream(padded(t)[1]),)))


def probe_media(rows: DataFrame) -> DataFrame:
    """`rows` (with a media column) plus seconds, samples, rate, frame_offsets, crc_bad, payload, feature.

    Null media give nulls.
    """
    out = [
        ("duration_num", T.LongType()), ("duration_den", T.LongType()), ("samples", T.LongType()), ("rate", T.IntegerType()),
        ("frame_offsets", T.ArrayType(T.LongType())), ("crc_bad", T.LongType()), ("payload", T.BinaryType()), ("feature", T.StringType()),
    ]

    def make(data: bytes | None):
        if data is None:
            return (None,) * len(out)
        s = read_stream(data)
        return s.duration.numerator, s.duration.denominator, s.samples, s.rate, s.offsets, s.crc_bad, payload_of(s), feature(s)

    return _append(rows, out, ("media", make))


def round_trip(docs: DataFrame) -> DataFrame:
    """`docs` plus digests of the stored stream and of the payload read back from it.

    Writing and reading happen in one pass, so that streams need not leave the worker.
    """
    out = [
        ("n_bytes", T.LongType()), ("payload_bytes", T.LongType()), ("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()),
        ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()),
        ("samples", T.LongType()), ("frame_offsets", T.ArrayType(T.LongType())),
    ]

    def make(text: str | None):
        n, payload = padded(text)
        media = write_stream(payload)
        s = read_stream(media)
        back = payload_of(s)
        if back is None:
            raise ValueError("a stored stream did not give its payload back")
        return (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature(s), s.samples, s.offsets)

    return _append(docs, out, ("text", make))


def op4_media_columns(spark, sf_dir):
    out = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples", "frame_offsets"
    )
