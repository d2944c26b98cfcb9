"""Token-id files: bit-plane shuffled, zstandard-compressed blocks of ids with a chunk index.

File layout, little-endian: 8 magic bytes; blocks; index; 8 bytes index length; 8 magic bytes. A block holds up to
`block_ids` ids cut across documents: its ids are transposed into bit planes (plane k holds bit k of each id) or byte
planes, only as many as the largest id needs, and each plane is one zstandard frame. The index, itself one frame of
JSON lines and arrays, names every block's place, its ids and its planes' lengths, and every document's id and length,
so any document can be read from the blocks that it touches.

Tasks write under a name of their own attempt and report it in a manifest row; the manifest is stored as a table before
it is used, so files of lost or repeated attempts are never read.

Defined cases: null or empty text is a document of the end id only; null ids sort first; repeated rows are separate
documents, in the order of a hash of their text; other columns are ignored; an empty table gives no file and no row.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, as_texts, batches_of, input_size, small_batches
from .tokens import encoder

MAGIC = b"CLKPLANE"
MANIFEST = "part int, file string, n_docs long, n_tokens long, n_bytes long"
DOCUMENTS = "doc_id long, start long, n_tokens long, ids binary"


def to_planes(ids: np.ndarray, mode: str) -> list[bytes]:
    """Bit or byte planes of ids, as many as the largest id needs (one at least)."""
    width = max(1, int(ids.max()).bit_length())
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)[:, : (width + 7) // 8]
    if mode == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(raw.shape[1])]
    bits = np.unpackbits(raw, axis=1, bitorder="little")[:, :width]
    return [row.tobytes() for row in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]


def from_planes(planes: list[bytes], n: int, mode: str) -> np.ndarray:
    """The ids whose planes these are."""
    out = np.zeros((n, 4), np.uint8)
    if mode == "byte":
        for k, plane in enumerate(planes):
            out[:, k] = np.frombuffer(plane, np.uint8)
    else:
        rows = np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), -1)
        bits = np.unpackbits(rows, axis=1, bitorder="little", count=n)
        packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
        out[:, : packed.shape[1]] = packed
    return out.view("<u4").reshape(n)


class PlaneWriter:
    """Writes one file to a stream; memory holds a block and the index."""

    def __init__(self, sink, block_ids: int = 65536, mode: str = "bit", level: int = 3):
        self.sink, self.block_ids, self.mode = sink, block_ids, mode
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.held, self.n_held, self.at, self.n_tokens = [], 0, len(MAGIC), 0
        self.blocks, self.docs, self.lengths = [], [], []
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.n_tokens += len(ids) // 4
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= self.block_ids:
            self._blocks(False)

    def _blocks(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        for at in range(0, len(ids), self.block_ids):
            block = ids[at : at + self.block_ids]
            if len(block) < self.block_ids and not last:
                break
            frames = [self.pack(p) for p in to_planes(block, self.mode)]
            for f in frames:
                self.sink.write(f)
            self.blocks.append([self.at, len(block), [len(f) for f in frames]])
            self.at += sum(map(len, frames))
        rest = ids[len(ids) - len(ids) % self.block_ids :].tobytes() if not last else b""
        self.held, self.n_held = [rest], len(rest) // 4

    def close(self) -> int:
        """Write the last block and the index; bytes of the file."""
        if self.n_held:
            self._blocks(True)
        head = json.dumps({"mode": self.mode, "block_ids": self.block_ids, "n_docs": len(self.docs), "n_tokens": self.n_tokens, "blocks": self.blocks}).encode()
        null = np.packbits(np.array([d is None for d in self.docs], bool)).tobytes()
        body = struct.pack("<Q", len(head)) + head + np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array(self.lengths, "<u4").tobytes() + null
        index = self.pack(body)
        self.sink.write(index + struct.pack("<Q", len(index)) + MAGIC)
        return self.at + len(index) + 16


class PlaneReader:
    """Reads one file; a block is decoded when a document in it is asked for."""

    def __init__(self, source):
        self.source = source
        self.unpack = zstandard.ZstdDecompressor()
        size = source.size()
        source.seek(size - 16)
        n, magic = struct.unpack("<Q", source.read(8))[0], source.read(8)
        source.seek(0)
        if magic != MAGIC or source.read(8) != MAGIC:
            raise ValueError("not a plane file")
        source.seek(size - 16 - n)
        body = self.unpack.decompressobj().decompress(source.read(n))
        k = struct.unpack_from("<Q", body)[0]
        self.head = json.loads(body[8 : 8 + k])
        d, at = self.head["n_docs"], 8 + k
        self.doc_ids = np.frombuffer(body, "<i8", d, at)
        self.lengths = np.frombuffer(body, "<u4", d, at + 8 * d).astype(np.int64)
        self.null = np.unpackbits(np.frombuffer(body, np.uint8, (d + 7) // 8, at + 12 * d), count=d).astype(bool)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))
        self.held: tuple[int, np.ndarray] = (-1, np.zeros(0, "<u4"))

    def block(self, k: int) -> np.ndarray:
        if self.held[0] != k:
            at, n, sizes = self.head["blocks"][k]
            self.source.seek(at)
            raw, planes = self.source.read(sum(sizes)), []
            for size in sizes:
                planes.append(self.unpack.decompressobj().decompress(raw[:size]))
                raw = raw[size:]
            self.held = (k, from_planes(planes, n, self.head["mode"]))
        return self.held[1]

    def ids(self, k: int) -> bytes:
        """The ids of document k of the file."""
        at, end, size, out = int(self.starts[k]), int(self.starts[k + 1]), self.head["block_ids"], []
        while at < end:
            part = self.block(at // size)[at % size : at % size + end - at]
            out.append(part.tobytes())
            at += len(part)
        return b"".join(out)

    def documents(self) -> Iterator[tuple[int | None, int, int, bytes]]:
        for k in range(self.head["n_docs"]):
            yield None if self.null[k] else int(self.doc_ids[k]), int(self.starts[k]), int(self.lengths[k]), self.ids(k)


def _opened(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


def write_token_files(df: DataFrame, folder: str, tokenizer: str, end_id: int, *, mode: str = "bit", block_ids: int = 65536, level: int = 3, chars_per_file: int = 24_000_000) -> DataFrame:
    """Encode documents (doc_id, text) and write them to files in ascending doc_id order; returns the manifest.

    Files hold ranges of doc_id; a part's number gives its place in the order.
    """
    spark = df.sparkSession
    small_batches(spark)
    # The place in order also takes a hash of the text, so many rows of one id still split over files.
    df = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("_h", F.xxhash64("text"))
    parts = max(1, -(-input_size(df) // chars_per_file))
    ordered = df.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "_h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_h", "text")
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, sink = TaskContext.get().partitionId(), None, None
        for b in batches_of(batches):
            if writer is None:
                fs, base = _opened(folder)
                fs.create_dir(base, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex[:12]}.planes"
                sink = fs.open_output_stream(f"{base}/{name}")
                writer = PlaneWriter(sink, block_ids, mode, level)
            for doc_id, ids in zip(b.column(0).to_pylist(), encoder(tokenizer).encode_all(as_texts(b.column(1)))):
                writer.add(doc_id, ids + end)
        if writer is not None:
            n = writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name], "n_docs": [len(writer.docs)], "n_tokens": [writer.n_tokens], "n_bytes": [n]})

    return ordered.select("doc_id", "text").mapInArrow(write, MANIFEST)


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Documents of the manifest's files: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""
    # A row for each file comes to the driver, none for documents.
    files = sorted((r.part, r.file, r.n_tokens) for r in manifest.select("part", "file", "n_tokens").collect())
    rows, before = [], 0
    for _, name, n in files:
        rows.append((name, before))
        before += n
    if not rows:
        return spark.createDataFrame([], DOCUMENTS)
    index = spark.createDataFrame(rows, "file string, before long").repartition(len(rows))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _opened(folder)
        for b in batches_of(batches):
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_file(f"{base}/{name}") as source:
                    held, size = [], 0
                    for doc_id, at, n, ids in PlaneReader(source).documents():
                        held.append((doc_id, start + at, n, ids))
                        size += len(ids)
                        if size > 8_000_000:
                            yield _documents(held)
                            held, size = [], 0
                    if held:
                        yield _documents(held)

    return index.mapInArrow(read, DOCUMENTS)


def _documents(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


def token_files(documents: DataFrame, tokenizer: str, end_id: int, **options) -> DataFrame:
    """Write documents to plane files in the shared folder, and read them back."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "token_files")
    folder = f"{scratch.path}/files"
    manifest = scratch.table(write_token_files(documents, folder, tokenizer, end_id, **options), "manifest")
    return read_token_files(spark, folder, manifest)
