"""Media columns: signature sniffing.

An Aho-Corasick automaton finds every magic number in one pass over the bytes; a validator of that format then reads
the structure (chunk lengths, checksums, headers) from there and gives the end, or refuses. A valid medium at byte 0
decides the type and corrects a wrong declared one; valid media further in are carved as spans. Spans don't overlap:
what starts inside an accepted medium belongs to it. A TIFF reaches to the last byte that its directories name, a FLAC to
the last frame whose checksum holds.

Defined cases: null or empty bytes have type "empty" and no spans; bytes without a valid medium at 0 have type "text"
if they are UTF-8 without control characters, else "binary"; null declared types are corrected; repeated rows give
equal values.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batches_of, small_batches

#: Fixed values of public formats: (format, magic bytes, place of the magic in the medium).
SIGNATURES = (
    ("png", b"\x89PNG\r\n\x1a\n", 0),
    ("jpeg", b"\xff\xd8\xff", 0),
    ("gif", b"GIF87a", 0),
    ("gif", b"GIF89a", 0),
    ("bmp", b"BM", 0),
    ("riff", b"RIFF", 0),
    ("aiff", b"FORM", 0),
    ("flac", b"fLaC", 0),
    ("ogg", b"OggS", 0),
    ("mp3", b"ID3", 0),
    ("mp4", b"ftyp", 4),
    ("pdf", b"%PDF-", 0),
    ("zip", b"PK\x03\x04", 0),
    ("gzip", b"\x1f\x8b\x08", 0),
    ("tiff", b"II*\x00", 0),
    ("tiff", b"MM\x00*", 0),
)
TYPES = {
    "png": "image/png", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "wav": "audio/wav", "avi": "video/avi", "webp": "image/webp", "aiff": "audio/aiff",
    "flac": "audio/flac", "ogg": "audio/ogg", "mp3": "audio/mpeg", "mp4": "video/mp4", "pdf": "application/pdf", "zip": "application/zip", "gzip": "application/gzip", "tiff": "image/tiff",
}


def u32(data: bytes, at: int, order: str = "<") -> int:
    return struct.unpack_from(order + "I", data, at)[0]


def png_chunks(data: bytes, at: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first, end) of the data of each chunk; ends after IEND, raises where a length or checksum is wrong."""
    at += 8
    while True:
        n, kind = u32(data, at, ">"), data[at + 4 : at + 8]
        if at + 12 + n > len(data) or zlib.crc32(memoryview(data)[at + 4 : at + 8 + n]) != u32(data, at + 8 + n, ">"):
            raise ValueError("broken chunk")
        yield kind, at + 8, at + 8 + n
        at += 12 + n
        if kind == b"IEND":
            return


def _png(data: bytes, at: int):
    chunks = list(png_chunks(data, at))
    ok = chunks[0][0] == b"IHDR" and chunks[0][2] - chunks[0][1] == 13 and any(c[0] == b"IDAT" for c in chunks)
    return ("png", chunks[-1][2] + 4) if ok else None


def _jpeg(data: bytes, at: int):
    at += 2
    while data[at] == 0xFF:
        kind = data[at + 1]
        if kind in (0xD8, 0x00, 0xD9):
            return None
        n = struct.unpack_from(">H", data, at + 2)[0]
        if n < 2:
            return None
        at += 2 + n
        if kind == 0xDA:  # entropy-coded data up to a marker that is neither stuffing nor a restart
            while True:
                at = data.index(b"\xff", at)
                if data[at + 1] == 0 or 0xD0 <= data[at + 1] <= 0xD7 or data[at + 1] == 0xFF:
                    at += 1 + (data[at + 1] != 0xFF)
                elif data[at + 1] == 0xD9:
                    return "jpeg", at + 2
                else:
                    break
    return None


def _gif(data: bytes, at: int):
    flags = data[at + 10]
    at += 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def blocks(at: int) -> int:
        while data[at]:
            at += data[at] + 1
        return at + 1

    while True:
        if data[at] == 0x3B:
            return "gif", at + 1
        if data[at] == 0x21:
            at = blocks(at + 2)
        elif data[at] == 0x2C:
            flags = data[at + 9]
            at = blocks(at + 10 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0) + 1)
        else:
            return None


def _bmp(data: bytes, at: int):
    size, first, header = u32(data, at + 2), u32(data, at + 10), u32(data, at + 14)
    ok = header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= first <= size and at + size <= len(data)
    return ("bmp", at + size) if ok else None


def _riff(data: bytes, at: int):
    end, form = at + 8 + u32(data, at + 4), data[at + 8 : at + 12]
    kind = {b"WAVE": "wav", b"AVI ": "avi", b"WEBP": "webp"}.get(form)
    if kind is None or end > len(data):
        return None
    seen, here = [], at + 12
    while here + 8 <= end:
        seen.append(data[here : here + 4])
        here += 8 + u32(data, here + 4)
        here += here - at & 1
    if here not in (end, end + 1) or kind == "wav" and not (b"fmt " in seen and b"data" in seen):
        return None
    return kind, end


def _aiff(data: bytes, at: int):
    end = at + 8 + u32(data, at + 4, ">")
    if data[at + 8 : at + 12] not in (b"AIFF", b"AIFC") or end > len(data):
        return None
    seen, here = set(), at + 12
    while here + 8 <= end:
        seen.add(data[here : here + 4])
        here += 8 + u32(data, here + 4, ">")
        here += here - at & 1
    return ("aiff", end) if here in (end, end + 1) and b"COMM" in seen else None


def crc_table(poly: int, bits: int) -> list[int]:
    """Remainders of a byte, highest bit first."""
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for byte in range(256):
        r = byte << (bits - 8)
        for _ in range(8):
            r = (r << 1 ^ poly if r & top else r << 1) & mask
        out.append(r)
    return out


CRC8, CRC16 = crc_table(0x07, 8), crc_table(0x8005, 16)


def flac_header(data: bytes, at: int) -> tuple[int, int] | None:
    """(end, samples) of a frame's header whose checksum holds."""
    if at + 6 > len(data) or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        return None
    size, rate = data[at + 2] >> 4, data[at + 2] & 15
    if not size or rate == 15 or data[at + 3] >> 4 > 10 or data[at + 3] & 1:
        return None
    lead, here = data[at + 4], at + 5
    while lead & 0x80 and lead & 0x40:  # the number's further bytes
        if data[here] & 0xC0 != 0x80:
            return None
        lead, here = lead << 1 & 0xFF, here + 1
    samples = 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << max(0, size - 8)
    if size in (6, 7):
        samples = int.from_bytes(data[here : here + size - 5], "big") + 1
        here += size - 5
    here += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    check = 0
    for b in data[at:here]:
        check = CRC8[check ^ b]
    return (here + 1, samples) if here < len(data) and data[here] == check else None


def _flac(data: bytes, at: int):
    at, first, total = at + 4, True, 0
    while True:
        last, kind, n = data[at] >> 7, data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        if first and (kind, n) != (0, 34) or kind == 127 or at + 4 + n > len(data):
            return None
        if first:
            total = int.from_bytes(data[at + 17 : at + 22], "big") & (1 << 36) - 1
        at, first = at + 4 + n, False
        if last:
            break
    # A frame has no length: it ends where the checksum over it comes out as zero and the next one starts, where all samples are there, or, if their number isn't declared, where it first is zero.
    done = 0
    while (head := flac_header(data, at)) and not (total and done >= total):
        check, possible = 0, None
        done += head[1]
        for here, b in enumerate(memoryview(data)[at:], at + 1):
            check = (check << 8 & 0xFFFF) ^ CRC16[check >> 8 ^ b]
            if not check and here > head[0] + 2:
                possible = possible or here
                if total and done >= total or flac_header(data, here):
                    possible = here
                    break
        if possible is None or total and done < total and possible != here:
            return None
        at = possible
    return ("flac", at) if not total or done >= total else None


def _ogg(data: bytes, at: int):
    pages = 0
    while data[at : at + 5] == b"OggS\x00" and at + 27 <= len(data):
        n = data[at + 26]
        end = at + 27 + n + sum(data[at + 27 : at + 27 + n])
        if end > len(data):
            return None
        at, pages = end, pages + 1
    return ("ogg", at) if pages else None


def _mp3(data: bytes, at: int):
    size = data[at + 6 : at + 10]
    if data[at + 3] not in (2, 3, 4) or any(b & 128 for b in size):
        return None
    end = at + 10 + sum(b << s for b, s in zip(size, (21, 14, 7, 0)))
    rates, rate = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), (44100, 48000, 32000)
    while end + 4 <= len(data) and data[end] == 0xFF and data[end + 1] & 0xFE == 0xFA:
        b, s = data[end + 2] >> 4, data[end + 2] >> 2 & 3
        if b in (0, 15) or s == 3:
            break
        end += 144_000 * rates[b] // rate[s] + (data[end + 2] >> 1 & 1)
    return ("mp3", min(end, len(data))) if end <= len(data) else None


def _mp4(data: bytes, at: int):
    here = at
    while here + 8 <= len(data):
        n, kind = u32(data, here, ">"), data[here + 4 : here + 8]
        if n == 1:
            n = struct.unpack_from(">Q", data, here + 8)[0]
        if n < 8 or here + n > len(data) or not re.fullmatch(rb"[ -~\xa9]{4}", kind):
            break
        here += n
    return ("mp4", here) if here > at else None


def _pdf(data: bytes, at: int):
    if not re.match(rb"%PDF-[12]\.\d", data[at : at + 8]):
        return None
    nxt = data.find(b"%PDF-", at + 5)
    end = data.rfind(b"%%EOF", at, nxt if nxt > 0 else len(data))
    return ("pdf", end + 5) if end > 0 and data.rfind(b"startxref", at, end) > 0 else None


def zip_ends(data: bytes) -> dict[int, int]:
    """Ends of archives by their first byte, read from their end records in one pass; of several the first counts."""
    out, end = {}, data.find(b"PK\x05\x06")
    while 0 <= end <= len(data) - 22:
        size, offset, note = *struct.unpack_from("<II", data, end + 12), struct.unpack_from("<H", data, end + 20)[0]
        first = end - offset - size
        if first >= 0 and end + 22 + note <= len(data) and (size == 0 or data[first + offset : first + offset + 4] == b"PK\x01\x02"):
            out.setdefault(first, end + 22 + note)
        end = data.find(b"PK\x05\x06", end + 4)
    return out


_nul: list = [b"", 0, -1]  # a payload, a place in it, and the next zero byte from there (its length: none)


def next_nul(data: bytes, here: int) -> int:
    """The next zero byte, or the end. The last answer is kept, so many starts before one zero byte look for it once."""
    if _nul[0] is not data or not _nul[1] <= here <= _nul[2]:
        found = data.find(b"\x00", here)
        _nul[:] = [data, here, len(data) if found < 0 else found]
    return _nul[2]


def _gzip(data: bytes, at: int):
    flags, here = data[at + 3], at + 10
    if flags & 0xE0:
        return None
    if flags & 4:
        here += 2 + struct.unpack_from("<H", data, here)[0]
    for flag in (8, 16):
        if flags & flag:
            here = next_nul(data, here) + 1
    here += 2 if flags & 2 else 0
    stream, check, size, piece = zlib.decompressobj(-15), 0, 0, 256
    while not stream.eof:
        part = stream.unconsumed_tail
        if not part:
            part, here, piece = data[here : here + piece], here + piece, 65536
            if not part:
                return None
        out = stream.decompress(part, 1 << 20)
        check, size = zlib.crc32(out, check), size + len(out)
    here = min(here, len(data)) - len(stream.unused_data)
    return ("gzip", here + 8) if struct.unpack_from("<II", data, here) == (check, size & 0xFFFFFFFF) else None


#: Bytes of a value of each TIFF type from 1 on; pairs of tags that hold places and lengths of strips and tiles.
TIFF_SIZES = (1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8, 4)
TIFF_DATA = ((273, 279), (324, 325), (513, 514))


def _tiff(data: bytes, at: int):
    order, here, seen, end, room = "<" if data[at] == 0x49 else ">", u32(data, at + 4, "<" if data[at] == 0x49 else ">"), set(), at + 8, len(data) - at
    while here and here not in seen:  # directories are a chain; those that lie in each other are none
        seen.add(here)
        n = struct.unpack_from(order + "H", data, at + here)[0]
        room -= 6 + 12 * n
        if room < 0 or not n or here < 8 or at + here + 6 + 12 * n > len(data):
            return None
        end, held = max(end, at + here + 6 + 12 * n), {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + here + 2 + 12 * k)
            if not 1 <= kind <= len(TIFF_SIZES):
                return None
            size, place = TIFF_SIZES[kind - 1] * count, at + here + 2 + 12 * k + 8
            if size > 4:
                place = at + u32(data, place, order)
            if place + size > len(data):
                return None
            end = max(end, place + size if size > 4 else 0)
            if kind in (3, 4) and any(tag in pair for pair in TIFF_DATA):
                held[tag] = struct.unpack_from(f"{order}{count}{'H' if kind == 3 else 'I'}", data, place)
        for places, lengths in TIFF_DATA:
            if len(held.get(places, ())) != len(held.get(lengths, ())):
                return None
            end = max([end, *(at + p + n for p, n in zip(held.get(places, ()), held.get(lengths, ())))])
        if end > len(data):
            return None
        here = u32(data, at + here + 2 + 12 * n, order)
    return "tiff", end


VALID = {"png": _png, "jpeg": _jpeg, "gif": _gif, "bmp": _bmp, "riff": _riff, "aiff": _aiff, "flac": _flac, "ogg": _ogg, "mp3": _mp3, "mp4": _mp4, "pdf": _pdf, "gzip": _gzip, "tiff": _tiff}


class Sniffer:
    def __init__(self):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for kind, magic, place in SIGNATURES:
            self.found.add_word(magic.decode("latin-1"), (kind, place + len(magic) - 1))
        self.found.make_automaton()

    def spans(self, data: bytes) -> list[tuple[str, int, int]]:
        """(format, first byte, end) of valid media, in order, none inside another."""
        out, end, archives = [], 0, None
        starts = sorted((last - back, kind) for last, (kind, back) in self.found.iter(data.decode("latin-1")) if last >= back)
        for at, kind in starts:
            if at < end:
                continue
            try:
                if kind == "zip":
                    archives = zip_ends(data) if archives is None else archives
                    got = ("zip", archives[at]) if at in archives else None
                else:
                    got = VALID[kind](data, at)
            except (IndexError, ValueError, struct.error, zlib.error):  # cut short or broken: not a medium
                got = None
            if got and got[1] <= len(data):
                out.append((got[0], at, got[1]))
                end = got[1]
        return out

    def sniff(self, data: bytes) -> tuple[str, list[tuple[str, int, int]]]:
        """The type of the whole, and the media carved from it."""
        spans = self.spans(data)
        if spans and spans[0][1] == 0:
            return TYPES[spans[0][0]], [s for s in spans if s[1] or s[2] < len(data)]
        if not data:
            return "empty", []
        try:
            return "binary" if re.search(r"[\x00-\x08\x0e-\x1f]", data.decode()) else "text", spans
        except UnicodeDecodeError:
            return "binary", spans


def store_png(payload: bytes, width: int) -> bytes:
    """An 8-bit greyscale image of `width` columns that holds the payload, whose length is a multiple of that."""
    rows = np.zeros((len(payload) // width, width + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, width)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def read_png(data: bytes) -> tuple[int, int, bytes]:
    """Width, height and samples of an image that store_png made."""
    at, packed = {}, []
    for kind, first, end in png_chunks(data, 0):
        if kind == b"IDAT":
            packed.append(data[first:end])
        at[kind] = data[first:end]
    width, height, depth, colour, *_ = struct.unpack(">IIBBBBB", at[b"IHDR"])
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, -1)
    if (depth, colour, rows.shape[1]) != (8, 0, width + 1) or rows[:, 0].any():
        raise ValueError("not an unfiltered 8-bit greyscale image")
    return width, height, rows[:, 1:].tobytes()


def stored_texts(documents: DataFrame, width: int = 576) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as UTF-8, filled up with bytes 255 to a positive multiple of `width`, as an image. The declared type is the text's own, which is wrong for it."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            texts = as_bytes(b.column(1))
            media = [store_png(t + b"\xff" * (-len(t) % width or width * (not t)), width) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary()), pa.array(["text/plain"] * len(texts))], names=["doc_id", "n_bytes", "media", "declared"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary, declared string")


SNIFFED = "media_type string, corrected boolean, carved array<struct<type:string,start:long,length:long>>, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"


def sniff_media(media: DataFrame, content: str = "media", declared: str = "declared") -> DataFrame:
    """Adds to a table the type that the bytes show, whether it corrects the declared one, carved media, and digests and
    features of the samples read back from the stored bytes (of the bytes themselves where no samples can be read). Columns of
    the table with the names of those are replaced."""
    made = [x.split()[0] for x in re.split(r", (?=[a-z_0-9]+ )", SNIFFED)]
    kept = [f for f in media.schema.fields if f.name not in (content, declared, *made)]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), SNIFFED])
    small_batches(media.sparkSession, 256)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        names = [f.name for f in kept]
        for b in batches_of(batches):
            rows = []
            for data, said in zip(b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist()):
                data = data or b""
                kind, carved = sniffer.sniff(data)
                payload, shape = data, "raw"
                if kind == "image/png" and not carved:
                    try:
                        width, height, payload = read_png(data)
                        shape = f"{width}x{height}"
                    except (ValueError, KeyError, zlib.error):  # an image of another layout: its bytes as they are
                        pass
                carved = [{"type": TYPES[t], "start": s, "length": e - s} for t, s, e in carved]
                values = np.frombuffer(payload, np.uint8)
                share = np.bincount(values, minlength=256) / max(1, len(values))
                entropy = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
                mean = float((share * np.arange(256)).sum())
                spread = float(np.sqrt(max(0.0, (share * np.arange(256) ** 2).sum() - mean**2)))
                feature = f"{kind};{shape};mean={mean:.4f};spread={spread:.4f};entropy={entropy:.4f};distinct={int((share > 0).sum())};carved={len(carved)}"
                rows.append((kind, kind != said, carved, len(data), hashlib.sha256(data).hexdigest(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), feature))
            cols = list(zip(*rows))
            span = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
            kinds = [pa.string(), pa.bool_(), span, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(names))), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[*names, *made])

    return media.select(*(F.col(f"`{f.name}`") for f in kept), F.col(content).alias("_content"), F.col(declared).alias("_declared")).mapInArrow(run, schema)
