"""Helpers shared by the training-data operators: scratch tables, batches, words, hashes."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch of whole texts; a batch of very long texts stays within a worker's memory.
TEXT_BATCH_ROWS = 512
SEED = 42


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, by any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Bound the rows of an Arrow batch, unless the session bounds them lower."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def scratch_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; in local mode, where it is unset, one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = held.get() if held.isDefined() else None
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="cloakline-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """A folder of intermediate tables in the shared folder. Tables written here cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str) -> None:
        """Delete a table that no later step reads."""
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def split_of(column: str, parts: int) -> Column:
    """crc32 of an id's text modulo parts; a null id gives null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def held_out(column: str, parts: int, part: int) -> Column:
    """True where the id falls in the held-out part; a null id is never held out."""
    return F.coalesce(split_of(column, parts) == part, F.lit(False))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    """Texts of a column, cast to strings; null counts as empty."""
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.string())
    return [x or "" for x in column.to_pylist()]


def words_of(text: bytes) -> list[bytes]:
    """A-Z lower-cased words: runs of bytes other than space and 09-0D."""
    return text.lower().split()


def crc32_u32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


class Lexicon(dict):
    """Words seen by one worker, numbered from 0, with their 64-bit hashes; emptied between batches once it holds `most` words."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most, self.hashes, self.room, self.filled = most, [], np.zeros(1024, np.uint64), 0

    def __missing__(self, word: bytes | str) -> int:
        self[word] = n = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word, SEED))
        return n

    def full(self) -> bool:
        return len(self.hashes) >= self.most

    def reset(self) -> None:
        self.clear()
        self.hashes.clear()
        self.filled = 0

    def array(self) -> np.ndarray:
        """Hashes by number; grows in place."""
        n = len(self.hashes)
        if n > len(self.room):
            self.room = np.concatenate((self.room[: self.filled], np.zeros(2 * n - self.filled, np.uint64)))
        if n > self.filled:
            self.room[self.filled : n] = np.array(self.hashes[self.filled :], np.uint64)
            self.filled = n
        return self.room[:n]

    def ids(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _PHI = np.uint64(33), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a pair in order, from the hashes of its parts."""
    return mix(left * _PHI + right)


def shingle_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; of the whole sequence if it is shorter; none for no words."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    out = hashes[: len(hashes) - n + 1]
    for k in range(1, n):
        out = chain(out, hashes[k : len(hashes) - n + 1 + k])
    return out


def sum_pairs(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order], first)


@contextlib.contextmanager
def quiet():
    """Numpy's unsigned arithmetic wraps on purpose."""
    with np.errstate(over="ignore"):
        yield


def batches_of(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that have rows."""
    return (b for b in tables if b.num_rows)


def input_size(df: DataFrame, column: str = "text") -> int:
    """Characters of a column over the whole table, to size partitions by."""
    return int(df.agg(F.sum(F.length(column))).first()[0] or 0)
