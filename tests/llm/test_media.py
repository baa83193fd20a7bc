"""MPEG audio: exact round trips, tags, tables, junk, broken checksums."""

import hashlib
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnfold.llm import mpeg


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=5000))
def test_round_trip(payload):
    got = mpeg.decode(mpeg.encode(payload))
    assert got["payload"] == payload
    assert got["crc_bad"] == 0 and got["junk_bytes"] == 0 and got["table_crc_ok"] and got["audio_crc_ok"]
    assert got["frames"] == got["table_frames"] == len(got["offsets"])
    assert got["duration_num"] * 125 == got["frames"] * 3 * got["duration_den"]


def test_resynchronises_after_junk_and_sees_damage():
    media = mpeg.encode(bytes(range(256)) * 20)
    clean = mpeg.decode(media)
    cut = clean["offsets"][2]
    noisy = mpeg.decode(media[:cut] + b"\xff\xfb\x00junk" + media[cut:])
    assert noisy["frames"] == clean["frames"] and noisy["junk_bytes"] == 7 and noisy["resyncs"] == 1 and noisy["audio_crc_ok"] is False
    broken = bytearray(media)
    broken[clean["offsets"][1] + 8] ^= 1  # side information
    assert mpeg.decode(bytes(broken))["crc_bad"] == 1


def frames(head, n, size, **kw):
    return b"".join(struct.pack(">I", head).ljust(size, b"\0") for _ in range(n))


@pytest.mark.parametrize("junk", [b"\xff\xfb\x00\x00", b"\xff\xfb\x00\x00" * 3, b"\xff\xfb\x90\x00", b"\xff\xfd\x00\x04x", b"\xff" * 9])
def test_headers_in_junk_swallow_nothing(junk):
    payload = bytes(range(256)) * 20
    media = mpeg.encode(payload)
    clean = mpeg.decode(media)
    for cut in (clean["offsets"][0], clean["offsets"][2], clean["offsets"][-1]):
        got = mpeg.decode(media[:cut] + junk + media[cut:])
        assert got["frames"] == clean["frames"] and got["junk_bytes"] == len(junk) and got["payload"] == payload


def test_free_bitrate():
    head = 0xFFFB0004  # Layer III, free bitrate, 44.1 kHz, unprotected
    got = mpeg.decode(frames(head, 5, 400))
    assert got["frames"] == 5 and got["offsets"] == [0, 400, 800, 1200, 1600] and got["junk_bytes"] == 0
    padded = frames(head, 1, 400) + frames(head | 1 << 9, 1, 401) + frames(head, 2, 400)
    assert mpeg.decode(padded)["offsets"] == [0, 400, 801, 1201]
    assert mpeg.decode(frames(head, 1, 400))["frames"] == 0  # nothing tells its size


def bitwise_crc(bits):
    c = 0xFFFF
    for b in bits:
        c = ((c << 1) ^ (0x8005 if (c >> 15) ^ b else 0)) & 0xFFFF
    return c


@pytest.mark.parametrize(("head", "bits", "channels", "bound"), [
    (0xFFFCC4C0, [4] * 11 + [3] * 12 + [2] * 4, 1, 99),  # 48 kHz mono, 256 kbit/s: table a
    (0xFFFCC000, [4] * 11 + [3] * 12 + [2] * 7, 2, 99),  # 44.1 kHz stereo, 256 kbit/s: b
    (0xFFFC2000, [4] * 2 + [3] * 6, 2, 99),  # 44.1 kHz stereo, 48 kbit/s: c
    (0xFFFC28C0 & ~0xF000 | 0x1000, [4] * 2 + [3] * 10, 1, 99),  # 32 kHz mono, 32 kbit/s: d
    (0xFFFCC050, [4] * 11 + [3] * 12 + [2] * 7, 2, 8),  # joint stereo, bound 8
    (0xFFF48400, [4] * 4 + [3] * 7 + [2] * 19, 2, 99),  # 24 kHz: 13818-3
])
def test_layer_two_checksums(head, bits, channels, bound):
    h = mpeg.Header(head)
    assert h.layer == 2 and h.protected
    rng = random.Random(head)
    out, used = [], 0
    for k, n in enumerate(bits):
        for _ in range(channels if k < bound else 1):
            v = rng.choice([0, rng.randrange(1 << n)])
            out += [v >> (n - 1 - i) & 1 for i in range(n)]
            used += bool(v) * (1 if k < bound else channels)
    out += [rng.randrange(2) for _ in range(2 * used)]
    body = bytes(int("".join(map(str, (out + [1] * 16)[i : i + 8])), 2) for i in range(0, len(out), 8))
    crc = bitwise_crc([head >> i & 1 for i in range(15, -1, -1)] + out)
    frame = (struct.pack(">IH", head, crc) + body).ljust(h.size, b"\xaa")
    got = mpeg.decode(frame * 3)
    assert (got["frames"], got["crc_good"], got["crc_bad"]) == (3, 3, 0)
    broken = bytearray(frame * 3)
    broken[6] ^= 1
    assert mpeg.decode(bytes(broken))["crc_bad"] == 1


@settings(max_examples=400, deadline=None)
@given(st.binary(max_size=700), st.lists(st.tuples(st.integers(0, 5000), st.integers(0, 255)), max_size=12), st.integers(0, 6000), st.booleans())
def test_any_bytes_give_a_result(payload, edits, cut, vbri):
    frame = struct.pack(">I", 0xFFFB9004)
    table = (frame + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 834, 2, 2, 1, 2, 1) + bytes(4)).ljust(417, b"\0")
    media = bytearray(table + frame.ljust(417, b"\0") * 3 + payload if vbri else mpeg.encode(payload) + b"APETAGEX" + bytes(24))
    for at, x in edits:
        media[at % len(media)] = x
    got = mpeg.decode(bytes(media)[: cut or None])
    assert got["frames"] == len(got["offsets"]) and got["junk_bytes"] >= 0
    mpeg.decode(b"ID3\x02\0\0\0\0\0\x09" + bytes(media)[:cut] + b"TAG" + payload[:125].ljust(125, b"x"))


def test_small_frame_with_a_table_cut_short():
    frame = struct.pack(">I", 0xFFF31404).ljust(24, b"\0")  # 24 bytes: 8 kbit/s, 24 kHz
    assert mpeg.decode(frame * 2 + b"VBRI" + bytes(3))["frames"] == 2
    assert mpeg.decode(frame + b"\0" * 12 + b"VBRI")["ok"] in (True, False)


def test_trailing_and_old_tags():
    audio = frames(0xFFFB9004, 3, 417)
    item = lambda k, v: struct.pack("<II", len(v), 0) + k + b"\0" + v
    items = item(b"Artist", "Ä".encode()) + item(b"Year", b"1999")
    foot = lambda flags: b"APETAGEX" + struct.pack("<IIII", 2000, len(items) + 32, 2, flags) + bytes(8)
    v1 = b"TAG" + b"Song".ljust(30, b"\0") + b"Band".ljust(30, b" ") + b"Disc".ljust(30, b"\0") + b"2001" + b"Hm".ljust(28, b"\0") + b"\0\x07" + b"\x11"
    v2 = b"ID3\x02\0\0\0\0\0\x0b" + b"TT2\0\0\x05\0Name"
    got = mpeg.decode(v2 + audio + foot(1 << 31 | 1 << 29) + items + foot(1 << 31) + v1)
    assert got["frames"] == 3 and got["junk_bytes"] == 0
    want = {"TT2": "Name", "APE:Artist": "Ä", "APE:Year": "1999", "TIT2": "Song", "TPE1": "Band", "TALB": "Disc", "TYER": "2001", "COMM": "Hm", "TRCK": "7", "TCON": "(17)"}
    assert got["tags"] == want


def test_known_checksums():
    assert mpeg.crc_arc(b"123456789") == 0xBB3D
    assert mpeg.crc_frame(b"123456789") == 0xAEE7


def test_tags_and_vbri():
    frame = struct.pack(">I", 0xFFFB9004)  # Layer III, 128 kbit/s, 44.1 kHz, stereo, unprotected
    body = frame + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 417 * 3, 2, 2, 1, 2, 1) + struct.pack(">HH", 417, 417)
    stream = body.ljust(417, b"\0") + (frame.ljust(417, b"\0")) * 2
    id3 = b"ID3\x03\0\0" + bytes([0, 0, 0, 19]) + b"TIT2" + struct.pack(">I", 9) + b"\0\0" + b"\0A title!"
    got = mpeg.decode(id3 + stream + b"TAG" + b"Old".ljust(125, b"\0"))
    assert got["table"] == "VBRI" and got["table_frames"] == 2 and got["toc"] == [0, 417, 834]
    assert got["tags"]["TIT2"] == "A title!" and got["frames"] == 2 and got["rate"] == 44100
    assert got["duration_num"] / got["duration_den"] == pytest.approx(2 * 1152 / 44100)


@pytest.mark.parametrize("data", [b"", b"\xff", b"ID3", b"no audio at all" * 9])
def test_no_audio(data):
    got = mpeg.decode(data)
    assert got["ok"] is False and got["frames"] == 0 and got["payload"] is None


def test_query_cases(spark, tmp_path):
    from tarnfold.llm import queries as q

    rows = [(1, "äb"), (2, None), (3, ""), (4, "x" * 20_000), (5, "äb"), (None, "y")]
    spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as media", "1 as payload").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in q.op1_mpeg_audio(spark, str(tmp_path)).collect()}
    assert len(got) == 6 and got[1].payload_sha256 == got[5].payload_sha256 and got[1].media_sha256 == got[5].media_sha256
    assert (got[2].n_bytes, got[2].payload_bytes, got[3].n_bytes, got[3].payload_bytes) == (0, 64, 0, 64)
    assert got[1].n_bytes == 3 and got[4].payload_bytes == 20_032
    assert got[2].tail_crc32 == zlib.crc32(bytes(64))
    for i, text in rows:
        raw = (text or "").encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        media = mpeg.encode(padded)
        assert (got[i].n_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert (got[i].media_bytes, got[i].media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert mpeg.read(mpeg.store(empty, "text", keep=("doc_id",)), keep=("doc_id",)).count() == 0
