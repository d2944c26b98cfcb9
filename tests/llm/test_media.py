import gzip
import hashlib
import io
import struct
import time
import zipfile
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloakline.llm import media


def wav(n=50):
    body = b"WAVE" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", n) + bytes(n)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def made() -> dict[str, bytes]:
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
    return {
        "image/png": media.store_png(bytes(range(256)) * 9, 576),
        "image/gif": b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + bytes(8) + b"\x00" + b"\x02\x02\x4c\x01\x00" + b"\x3b",
        "image/bmp": b"BM" + struct.pack("<IHHI", 58, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4),
        "audio/wav": wav(),
        "application/zip": z.getvalue(),
        "application/gzip": gzip.compress(b"payload" * 40, mtime=0),
        "application/pdf": b"%PDF-1.4\n1 0 obj<<>>endobj\nxref\nstartxref\n9\n%%EOF",
        "image/jpeg": b"\xff\xd8\xff\xe0\x00\x10JFIF\x00" + bytes(9) + b"\xff\xda\x00\x08" + bytes(6) + b"\x12\xff\x00\x34\xff\xd9",
        "audio/ogg": b"OggS\x00\x02" + bytes(20) + b"\x01\x05" + b"abcde",
        "audio/mpeg": b"ID3\x03\x00\x00\x00\x00\x00\x05" + bytes(5),
        "video/mp4": struct.pack(">I", 16) + b"ftypisom" + bytes(4) + struct.pack(">I", 8) + b"free",
        "image/tiff": tiff(),
        "audio/flac": flac(3),
        "audio/aiff": b"FORM" + struct.pack(">I", 4 + 8 + 18) + b"AIFFCOMM" + struct.pack(">I", 18) + bytes(18),
    }


def tiff(order="<"):
    """One strip of 6 bytes before the directory, and a resolution behind it."""
    entries = [(256, 3, 1, 3), (257, 3, 1, 2), (273, 4, 1, 8), (279, 4, 1, 6), (282, 5, 1, 14 + 2 + 12 * 5 + 4)]
    body = (b"II*\x00" if order == "<" else b"MM\x00*") + struct.pack(order + "I", 14) + b"strips" + struct.pack(order + "H", 5)
    for tag, kind, n, value in entries:
        body += struct.pack(order + "HHI", tag, kind, n) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
    return body + struct.pack(order + "I", 0) + struct.pack(order + "II", 72, 1)


def crc(data, poly, bits):
    r = 0
    for b in data:
        r ^= b << (bits - 8)
        for _ in range(8):
            r = (r << 1 ^ poly if r >> (bits - 1) else r << 1) & (1 << bits) - 1
    return r


def flac(frames, declare=True):
    """Frames of 16 equal samples."""
    info = struct.pack(">HH", 16, 16) + bytes(6) + ((8000 << 44 | 15 << 36 | (16 * frames if declare else 0)).to_bytes(8, "big")) + bytes(16)
    out = b"fLaC" + bytes([0x80, 0, 0, 34]) + info
    for k in range(frames):
        head = bytes([0xFF, 0xF8, 0x60, 0x08, k, 15])
        head += bytes([crc(head, 0x07, 8)])
        frame = head + b"\x00" + struct.pack(">h", 300 * k - 7)
        out += frame + struct.pack(">H", crc(frame, 0x8005, 16))
    return out


def test_types_and_carving():
    sniffer = media.Sniffer()
    for kind, data in made().items():
        assert sniffer.sniff(data)[0] == kind, kind
        inside = b"text before " + data + b" and after"
        got, spans = sniffer.sniff(inside)
        assert got in ("text", "binary")
        assert [(media.TYPES[t], inside[s:e]) for t, s, e in spans] == [(kind, data)], kind


def test_what_follows_a_medium_is_carved():
    sniffer, gif = media.Sniffer(), made()["image/gif"]
    for kind, data in (*made().items(), ("image/tiff", tiff(">")), ("audio/flac", flac(2, False))):
        got, spans = sniffer.sniff(data + bytes(400) + gif)
        assert got == kind and spans == [(spans[0][0], 0, len(data)), ("gif", len(data) + 400, len(data) + 400 + len(gif))], kind
    broken = bytearray(flac(3))
    broken[-5] ^= 1
    assert sniffer.sniff(bytes(broken))[0] == "binary"
    assert sniffer.sniff(tiff()[:-4])[0] == "binary"


def test_many_magic_numbers_take_time_in_proportion():
    import time

    sniffer, began = media.Sniffer(), time.time()
    for magic in (b"PK\x03\x04", b"%PDF-1.4", b"\x1f\x8b\x08", b"fLaC", b"II*\x00", b"RIFF"):
        sniffer.sniff(magic * (400_000 // len(magic)))
    assert time.time() - began < 20


def test_broken_media_are_not_taken():
    sniffer = media.Sniffer()
    for kind, data in made().items():
        if kind in ("image/png", "image/gif", "audio/wav", "application/zip", "image/bmp", "application/gzip", "application/pdf", "image/jpeg"):
            assert sniffer.sniff(data[: len(data) // 2])[0] != kind, kind
    png = bytearray(made()["image/png"])
    png[40] ^= 1
    assert sniffer.sniff(bytes(png))[0] != "image/png"


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300), st.sampled_from([s[1] for s in media.SIGNATURES]))
def test_any_bytes_are_sniffed(data, magic):
    sniffer = media.Sniffer()
    for body in (data, magic + data, data[:7] + magic + data[7:]):
        kind, spans = sniffer.sniff(body)
        assert kind and all(0 <= s < e <= len(body) for _, s, e in spans)


def test_stored_texts_round_trip(spark, documents):
    rows = media.sniff_media(media.stored_texts(documents)).collect()
    texts = [(r.text or "").encode() for r in documents.collect()]
    want = []
    for t in texts:
        n = max(1, -(-len(t) // 576)) * 576
        payload = t + b"\xff" * (n - len(t))
        want.append((len(t), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])))
    assert sorted((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted(want)
    assert all(r.media_type == "image/png" and r.corrected and not r.carved for r in rows)
    same = [r for r in rows if r.doc_id == 4]
    assert len(same) == 2 and same[0][2:] == same[1][2:]


def test_media_edge_rows(spark):
    rows = spark.createDataFrame([(1, None, None), (2, bytearray(b""), "image/png"), (3, bytearray(made()["audio/wav"]), None), (4, bytearray(b"plain"), "text")], "id int, media binary, declared string")
    got = {r.id: (r.media_type, r.corrected) for r in media.sniff_media(rows).collect()}
    assert got == {1: ("empty", True), 2: ("empty", True), 3: ("audio/wav", True), 4: ("text", False)}
    assert media.sniff_media(rows.limit(0)).count() == 0
    chunk = struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0)  # an image of colours
    other = b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in ((b"IHDR", chunk), (b"IDAT", zlib.compress(bytes(4))), (b"IEND", b"")))
    clash = spark.createDataFrame([(1, bytearray(other), "x", "own", 5)], "id int, media binary, declared string, feature string, media_bytes int")
    got = media.sniff_media(clash).first()
    assert got.media_type == "image/png" and got.payload_bytes == got.media_bytes == len(other) and got.feature.startswith("image/png;raw")


@pytest.mark.parametrize("n", [576, 5760])
def test_png_holds_its_samples(n):
    payload = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    assert media.read_png(media.store_png(payload, 576)) == (576, n // 576, payload)


def test_long_names_and_long_chains():
    """A gzip file with a name of 5,000 bytes, a TIFF file of 1,500 directories, and many gzip starts before one zero byte."""
    body = gzip.compress(b"x" * 1000)
    named = body[:3] + b"\x08" + body[4:10] + b"n" * 5000 + b"\x00" + body[10:]
    assert media._gzip(named, 0) == ("gzip", len(named))
    size = 18
    chain = b"".join(struct.pack("<HHHIHHI", 1, 256, 3, 1, 7, 0, 8 + size * (k + 1) if k < 1499 else 0) for k in range(1500))
    tiff = b"II*\x00" + struct.pack("<I", 8) + chain
    assert media._tiff(tiff, 0)[1] == len(tiff)
    began = time.time()
    data = (b"\x1f\x8b\x08\x08" + b"1" * 6) * 100_000
    assert all(media._gzip(data, at) is None for at in range(0, len(data), 10)) and time.time() - began < 20
