"""MPEG audio columns: write payloads into Layer III streams, and read any MPEG audio stream back.

Writer: an ID3v2.4 tag, an Info/Xing frame with frame count, byte count, seek table and checksums, then MPEG-1 Layer III
frames (mono, 48 kHz, CRC-protected) whose side information declares no spectral data; the payload lies in the frames'
ancillary bytes. Players decode silence; the reader gets every byte back. The last frame takes the smallest bitrate that
holds the rest, so the stream has a variable bitrate.

Reader: parses ID3v2, ID3v1 and APEv2 tags, finds frame headers again after junk (a header counts when the next one, at
the distance it implies, agrees with it, or its frame's checksum holds; at the stream's end, when it agrees with the frames before, or as the only frame that
ends the stream exactly; a free bitrate's size counts when two further headers agree), parses Xing/Info and VBRI tables, verifies
the CRC-16 of protected frames of all layers, the table's own CRC and the CRC of all audio bytes, and computes exact
durations as fractions of seconds and the byte offset of every frame.

Defined cases: a null or empty payload is stored as its padding; null media gives a null result row; any bytes give a result, those without
a frame zero frames and `ok` false; tables that don't fit their frame are no tables; repeated rows give equal results; an empty table
gives an empty result.
"""

from __future__ import annotations

import struct
import sys
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from math import gcd

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnfold.llm.common import batches, slices

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (MPEG-1?, layer), and Hz by version bits.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

#: Layer II: bits of each subband's allocation, as (subbands, bits), by table a to d of 11172-3 and that of 13818-3.
ALLOCATIONS = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "lsf": ((4, 4), (7, 3), (19, 2)),
}

SIDE = 17  # side information of an MPEG-1 mono frame
HEAD = 4 + 2 + SIDE


def _table(poly: int, reflected: bool) -> list[int]:
    """CRC-16 of every pair of bytes, from a zero register."""
    one = []
    for b in range(256):
        c = b if reflected else b << 8
        for _ in range(8):
            c = ((c >> 1) ^ poly if c & 1 else c >> 1) if reflected else ((c << 1) ^ poly if c & 0x8000 else c << 1) & 0xFFFF
        one.append(c)
    step = (lambda c, b: one[(c ^ b) & 255] ^ (c >> 8)) if reflected else (lambda c, b: one[((c >> 8) ^ b) & 255] ^ ((c << 8) & 0xFFFF))
    return [step(step(0, x & 255), x >> 8) if reflected else step(step(0, x >> 8), x & 255) for x in range(65536)]


_MSB = _table(0x8005, False)
_LSB = _table(0xA001, True)


@lru_cache(maxsize=4096)
def crc_frame(data: bytes) -> int:
    """CRC-16 of MPEG audio (polynomial 0x8005, most significant bit first, from all ones)."""
    return crc_bits(data, 8 * len(data))


def crc_bits(data: bytes, bits: int) -> int:
    """The same over the first `bits` bits."""
    c, whole = 0xFFFF, bits // 16 * 2
    for (x,) in struct.iter_unpack(">H", data[:whole]):
        c = _MSB[c ^ x]
    for i in range(8 * whole, bits):
        bit = data[i >> 3] >> (7 - (i & 7)) & 1
        c = ((c << 1) ^ 0x8005 if (c >> 15) ^ bit else c << 1) & 0xFFFF
    return c


def crc_arc(data: bytes, c: int = 0) -> int:
    """CRC-16/ARC, as tables of Info frames use it."""
    n, pairs = len(data) & ~1, _LSB
    words = array("H", data[:n])
    if sys.byteorder == "big":
        words.byteswap()
    for x in words:
        c = pairs[c ^ x]
    if len(data) & 1:
        c ^= data[-1]
        for _ in range(8):
            c = (c >> 1) ^ 0xA001 if c & 1 else c >> 1
    return c


_HEADS: dict[int, bytes] = {}


def _head(kbps: int) -> bytes:
    """Header, checksum and empty side information of a writer's frame."""
    if kbps not in _HEADS:
        h = struct.pack(">I", (0x7FF << 21) | (3 << 19) | (1 << 17) | (BITRATES[True, 3].index(kbps) << 12) | (1 << 10) | (3 << 6))
        side = bytes(SIDE)
        c = crc_frame(h[2:] + side)
        _HEADS[kbps] = h + struct.pack(">H", c) + side
    return _HEADS[kbps]


def _frame(kbps: int, body: bytes) -> bytes:
    return (_head(kbps) + body).ljust(3 * kbps, b"\0")  # 144 * bitrate / 48000 bytes


def encode(payload: bytes) -> bytes:
    """The whole stream for a payload."""
    room, frames = 960 - HEAD, []
    for i in range(0, len(payload), room):
        body = payload[i : i + room]
        frames.append(_frame(next(k for k in BITRATES[True, 3][1:] if 3 * k >= HEAD + len(body)), body))
    audio = b"".join(frames)
    total, sizes = len(audio) + 192, [len(f) for f in frames]
    toc, at, seen = bytearray(), 192, 0
    for p in range(100):
        while seen < len(frames) * p // 100:
            at, seen = at + sizes[seen], seen + 1
        toc.append(min(255, at * 256 // total))
    table = b"Xing" + struct.pack(">III", 0xF, len(frames), total) + bytes(toc) + struct.pack(">I", 100)
    table += b"tarnfold\0" + bytes(12) + struct.pack(">I", 0)[:3] + bytes(4) + struct.pack(">IH", total, crc_arc(audio))
    info = _head(64) + table
    info = info + struct.pack(">H", crc_arc(info[:190].ljust(190, b"\0")))
    body = b"\x03payload\0" + str(len(payload)).encode()
    frame = b"TXXX" + _syncsafe(len(body)) + b"\0\0" + body
    return b"ID3\x04\0\0" + _syncsafe(len(frame)) + frame + info.ljust(192, b"\0") + audio


def _syncsafe(n: int) -> bytes:
    return bytes((n >> s) & 127 for s in (21, 14, 7, 0))


class Header:
    __slots__ = ("version", "layer", "protected", "kbps", "rate", "padded", "mode", "extension", "samples", "size")

    def __init__(self, word: int) -> None:
        """Raises ValueError where the 32 bits are no header. size is 0 for a free bitrate."""
        self.version, layer = word >> 19 & 3, word >> 17 & 3
        rate, index = word >> 10 & 3, word >> 12 & 15
        if word >> 21 != 0x7FF or self.version == 1 or layer == 0 or rate == 3 or index == 15 or word & 3 == 2:
            raise ValueError
        self.layer, self.protected, self.padded = 4 - layer, not word >> 16 & 1, word >> 9 & 1
        self.mode, self.extension = word >> 6 & 3, word >> 4 & 3
        self.rate, self.kbps = RATES[self.version][rate], BITRATES[self.version == 3, self.layer][index]
        self.samples = 384 if self.layer == 1 else 576 if self.layer == 3 and self.version != 3 else 1152
        if self.layer == 1:
            self.size = (12000 * self.kbps // self.rate + self.padded) * 4 if self.kbps else 0
        else:
            self.size = self.samples // 8 * 1000 * self.kbps // self.rate + self.padded if self.kbps else 0

    def alike(self, other: Header) -> bool:
        return (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)

    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mode == 3 else 32) if self.version == 3 else 9 if self.mode == 3 else 17

    def subbands(self) -> list[int]:
        """Bits of the allocation of each Layer II subband."""
        each = self.kbps // (1 if self.mode == 3 else 2) if self.kbps else 192
        if self.version != 3:
            table = "lsf"
        elif each < 56:
            table = "d" if self.rate == 32000 else "c"
        else:
            table = "b" if each >= 96 and self.rate != 48000 else "a"
        return [bits for n, bits in ALLOCATIONS[table] for _ in range(n)]

    def covered(self, body: bytes) -> int:
        """Bits of the frame's body (what follows the checksum) that the checksum covers."""
        if self.layer == 3:
            return 8 * self.side()
        channels, bound = 1 if self.mode == 3 else 2, 4 * (self.extension + 1) if self.mode == 1 else 32
        if self.layer == 1:
            return 4 * (32 if channels == 1 else min(bound, 32) + 32)
        value, size, at, used = int.from_bytes(body, "big"), 8 * len(body), 0, 0
        for k, bits in enumerate(self.subbands()):  # allocations, then two bits of scale factor selection for each channel of a used subband
            for _ in range(channels if k < bound else 1):
                at += bits
                if at <= size and value >> (size - at) & ((1 << bits) - 1):
                    used += 1 if k < bound else channels
        return min(size, at + 2 * used)


_KNOWN: dict[int, Header | None] = {}


def header_at(data: bytes, at: int) -> Header | None:
    if at + 4 > len(data) or data[at] != 255:
        return None
    word = int.from_bytes(data[at : at + 4], "big")
    if word not in _KNOWN:
        if len(_KNOWN) > 65536:
            _KNOWN.clear()
        try:
            _KNOWN[word] = Header(word)
        except ValueError:
            _KNOWN[word] = None
    return _KNOWN[word]


def _tags(data: bytes) -> tuple[int, int, dict[str, str]]:
    """(first byte after leading tags, end before trailing tags, text frames found)."""
    start, end, found = 0, len(data), {}
    while data[start : start + 3] == b"ID3" and start + 10 <= end:
        size = sum((b & 127) << s for b, s in zip(data[start + 6 : start + 10], (21, 14, 7, 0), strict=True))
        body, major = data[start + 10 : start + 10 + size], data[start + 3]
        at = 0
        if data[start + 5] & 64 and len(body) >= 4:  # an extended header
            at = int.from_bytes(body[:4], "big") + 4 if major == 3 else sum((b & 127) << s for b, s in zip(body[:4], (21, 14, 7, 0), strict=True))
        head = 6 if major == 2 else 10
        while major in (2, 3, 4) and at + head <= len(body) and body[at] >= 65:
            raw = body[at + 3 : at + 6] if major == 2 else body[at + 4 : at + 8]
            n = sum((b & 127) << s for b, s in zip(raw, (21, 14, 7, 0), strict=True)) if major == 4 else int.from_bytes(raw, "big")
            key, value = body[at : at + (3 if major == 2 else 4)].decode("latin-1"), body[at + head : at + head + n]
            if key[0] == "T" and value:
                code = ("latin-1", "utf-16", "utf-16-be", "utf-8")[value[0] & 3]
                text = value[1:].decode(code, "replace").rstrip("\0")
                if key in ("TXXX", "TXX"):
                    name, _, text = text.partition("\0")
                    key = f"TXXX:{name}"
                found[key] = text
            at += head + n
        start += 10 + size + 10 * bool(data[start + 5] & 16)
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        v1 = data[end : end + 128]
        for key, lo, hi in (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93), ("TYER", 93, 97), ("COMM", 97, 125)):
            if text := v1[lo:hi].split(b"\0")[0].rstrip(b" ").decode("latin-1"):
                found.setdefault(key, text)
        if not v1[125] and v1[126]:  # ID3v1.1
            found.setdefault("TRCK", str(v1[126]))
        if v1[127] != 255:
            found.setdefault("TCON", f"({v1[127]})")
    if end - start >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, items, flags = struct.unpack("<III", data[end - 20 : end - 8])
        at = max(start, end - size)
        stop = end - 32
        for _ in range(items):
            if at + 8 > stop or (zero := data.find(b"\0", at + 8, stop)) < 0:
                break
            n, kind = struct.unpack("<II", data[at : at + 8])
            if not kind & 6:  # text
                found[f"APE:{data[at + 8 : zero].decode('latin-1')}"] = data[zero + 1 : min(stop, zero + 1 + n)].decode("utf-8", "replace")
            at = zero + 1 + n
        end = max(start, end - size - 32 * bool(flags >> 31))
    return min(start, end), end, found


def _free_size(data: bytes, at: int, end: int, h: Header) -> int:
    """Unpadded size of a free bitrate's frame: two further headers of the kind stand at that distance, or one and the stream's end; 0 where none do."""
    p = at + 24
    while (p := data.find(b"\xff", p, min(end, at + 8192))) >= 0:
        o = header_at(data, p)
        if o and not o.kbps and h.alike(o):
            size = p - at - h.padded
            after = p + size + o.padded
            third = header_at(data, after) if after + 4 <= end else None
            if after == end or third and not third.kbps and h.alike(third):
                return size
        p += 1
    return 0


def _checked(data: bytes, at: int, size: int, h: Header) -> bool:
    """Whether a protected frame's checksum holds."""
    body = data[at + 6 : at + size][:256]
    n = h.covered(body)
    covered = data[at + 2 : at + 4] + body[: (n + 7) // 8]
    return n <= 8 * len(body) and (crc_frame(covered) if n % 8 == 0 else crc_bits(covered, 16 + n)) == int.from_bytes(data[at + 4 : at + 6], "big")


def decode(data: bytes) -> dict:
    """Everything the reader knows about a stream; see the fields of SCHEMA."""
    start, end, tags = _tags(data)
    offsets, sizes, heads = [], [], []
    at, junk, resyncs, good, bad = start, 0, 0, 0, 0
    free: dict[tuple, int] = {}
    synced = False
    while at + 4 <= end:
        h = header_at(data, at)
        size = 0
        if h:
            key = (h.version, h.layer, h.rate)
            size = h.size
            if not h.kbps:
                free_size = free.get(key) or _free_size(data, at, end, h)
                size = free_size + h.padded if free_size else 0
            known = bool(heads) and h.alike(heads[-1])
            if not size or at + size > end:
                size = 0
            elif not (synced and known):
                after = header_at(data, at + size) if at + size + 4 <= end else None
                at_end = at + size + 4 > end and (known or not heads and at + size == end)
                size = size if at_end or after and h.alike(after) or h.protected and _checked(data, at, size, h) else 0
        if not size:
            synced, to = False, data.find(b"\xff", at + 1, end)
            to = end if to < 0 else to
            junk, at = junk + to - at, to
            continue
        if not h.kbps:
            free[key] = size - h.padded
        resyncs += not synced and bool(offsets)
        synced = True
        if h.protected:
            ok = _checked(data, at, size, h)
            good, bad = good + ok, bad + (not ok)
        offsets.append(at)
        sizes.append(size)
        heads.append(h)
        at += size
    junk += max(0, end - at)
    out = {"ok": bool(heads), "tags": tags, "junk_bytes": junk, "resyncs": resyncs, "crc_good": good, "crc_bad": bad, "table": None, "table_frames": None, "table_bytes": None, "table_crc_ok": None, "audio_crc_ok": None, "delay": 0, "padding": 0, "toc": None}
    if heads:
        h, a = heads[0], offsets[0]
        x = a + 4 + 2 * h.protected + (h.side() if h.layer == 3 else 0)
        name = data[x : x + 4]
        flags, p = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8
        if h.layer == 3 and name in (b"Xing", b"Info") and p + sum(n for bit, n in ((1, 4), (2, 4), (4, 100), (8, 4)) if flags & bit) <= a + sizes[0]:
            for bit, field in ((1, "table_frames"), (2, "table_bytes")):
                if flags & bit:
                    out[field] = int.from_bytes(data[p : p + 4], "big")
                    p += 4
            if flags & 4:
                out["toc"], p = list(data[p : p + 100]), p + 100
            p += 4 * bool(flags & 8)
            if p + 36 <= a + sizes[0] and data[p : p + 4].strip(b"\0"):
                gap = int.from_bytes(data[p + 21 : p + 24], "big")
                out["delay"], out["padding"] = gap >> 12, gap & 4095
                out["table_crc_ok"] = crc_arc(data[a : p + 34].ljust(190, b"\0")[:190]) == int.from_bytes(data[p + 34 : p + 36], "big")
                out["audio_crc_ok"] = crc_arc(data[a + sizes[0] : end]) == int.from_bytes(data[p + 32 : p + 34], "big")
            out["table"] = name.decode()
        elif h.layer == 3 and data[a + 36 : a + 40] == b"VBRI" and sizes[0] >= 62:
            size, count, entries, scale, width = struct.unpack(">IIHHH", data[a + 46 : a + 60])
            if 62 + entries * width <= sizes[0]:
                out["table"], out["table_bytes"], out["table_frames"] = "VBRI", size, count
                steps = (int.from_bytes(data[a + 62 + i * width : a + 62 + (i + 1) * width], "big") * scale for i in range(entries))
                out["toc"] = list(accumulate(steps, initial=0))
        if out["table"]:
            offsets, sizes, heads = offsets[1:], sizes[1:], heads[1:]
    num, den = 0, 1
    for rate in {h.rate for h in heads}:
        n = sum(h.samples for h in heads if h.rate == rate)
        n = max(0, n - out["delay"] - out["padding"]) if len({h.rate for h in heads}) == 1 else n
        num, den = num * rate + n * den, den * rate
    g = gcd(num, den) or 1
    out |= {"frames": len(heads), "duration_num": num // g, "duration_den": den // g, "offsets": offsets, "min_kbps": min((h.kbps for h in heads), default=None), "max_kbps": max((h.kbps for h in heads), default=None), "rate": heads[0].rate if heads else None}
    if (n := tags.get("TXXX:payload", "")).isdigit():
        parts = (data[o + 4 + 2 * h.protected + (h.side() if h.layer == 3 else 0) : o + s] for o, s, h in zip(offsets, sizes, heads, strict=True))
        out["payload"] = b"".join(parts)[: int(n)]
    else:
        out["payload"] = None
    return out


SCHEMA = (
    "ok boolean, frames long, rate int, min_kbps int, max_kbps int, duration_num long, duration_den long, delay int, padding int, "
    "`table` string, table_frames long, table_bytes long, toc array<long>, table_crc_ok boolean, audio_crc_ok boolean, "
    "crc_good long, crc_bad long, junk_bytes long, resyncs long, tags map<string,string>, offsets array<long>, payload binary"
)


def _columns(names: list[str], keep: tuple[str, ...], df: DataFrame) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)


def store(df: DataFrame, payload: str, keep: tuple[str, ...] = (), block: int = 64) -> DataFrame:
    """keep columns and `media`: payload bytes, padded with zeros to a positive multiple of `block`, as a stream."""
    given = df.select(*keep, F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("_payload"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for part in slices(b, "_payload"):
                media = [encode(x.ljust(max(block, -(-len(x) // block) * block), b"\0")) for x in part.column("_payload").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(media, pa.binary())], [*keep, "media"])

    return batches(given, run, ", ".join(filter(None, [_columns(given.columns, keep, given), "media binary"])))


def read(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """keep columns, the stream's fields (SCHEMA) and the stream itself as `media`."""
    given = df.select(*keep, F.col(media).alias("media"))
    fields = [f.split()[0].strip("`") for f in SCHEMA.replace("map<string,string>", "m").split(", ")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {f.name: f.type for f in TYPES}
        for b in it:
            for part in slices(b, "media"):
                got = [decode(x) if x is not None else {} for x in part.column("media").to_pylist()]
                cols = [pa.array([list(g[f].items()) if f == "tags" and f in g else g.get(f) for g in got], types[f]) for f in fields]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *cols, part.column("media")], [*keep, *fields, "media"])

    return batches(given, run, ", ".join(filter(None, [_columns(given.columns, keep, given), SCHEMA, "media binary"])))


_PA = {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "map<string,string>": pa.map_(pa.string(), pa.string())}
TYPES = [pa.field(f.split()[0].strip("`"), _PA[f.split()[1]]) for f in SCHEMA.split(", ")]
