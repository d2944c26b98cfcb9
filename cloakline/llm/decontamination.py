"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check.

Texts and benchmark items become lower-cased words (runs of letters and digits) and word shingles. A window of an item's
size slides over the document by one word. Its SimHash is looked up in an index of the items' fingerprints: 64 bits in
`blocks` blocks, each item entered under every value within `reach` bits of its own in each block, so that every item
within radius blocks * (reach + 1) - 1 shares a block value with the window. Candidates are then compared exactly, by
weighted Jaccard similarity of their shingles (a shingle weighs as often as it occurs).

Windows that can't reach the similarity are passed over without a fingerprint: similarity J needs at least
2 J / (1 + J) of a window's shingles to be shingles of some item. That leaves out no window that the check would accept.

Items are broadcast in groups of at most `group_items`; more items take more passes over the documents.

Defined cases: null or empty text, and items without words, match nothing; an item or a text shorter than a shingle is
one shingle; a text shorter than an item is one window; repeated documents or items are matched each; no items leave
every document as it is; other columns are ignored or kept as they are.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Lexicon, as_texts, batches_of, quiet, shingle_hashes, small_batches

WORD = re.compile(r"[^\W_]+")
#: Bits of the first look at a shingle.
GATE = 20


def simhash(hashes: np.ndarray) -> np.uint64:
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(hashes), bitorder="little").view(np.uint64)[0]


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags."""
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


@dataclass
class Item:
    key: int
    size: int
    bag: Counter
    print: np.uint64


class ItemIndex:
    """Items by size of their shingles and of their windows, with the multi-index of their fingerprints."""

    def __init__(self, items: list[tuple[int, str]], shingle: int = 5, blocks: int = 8, reach: int = 2):
        self.blocks, self.radius = blocks, blocks * (reach + 1) - 1
        self.width = 64 // blocks
        lexicon, self.items = Lexicon(), []
        for key, text in items:
            ids = lexicon.ids(WORD.findall((text or "").lower()))
            if len(ids):
                with quiet():
                    h = shingle_hashes(lexicon.array()[ids], shingle)
                self.items.append(Item(key, len(ids), Counter(h.tolist()), simhash(h)))
        flips = [sum(1 << b for b in c) for r in range(reach + 1) for c in itertools.combinations(range(self.width), r)]
        # (shingle words, window words) -> block values -> items
        self.index: dict[tuple[int, int], dict[tuple[int, int], list[int]]] = defaultdict(lambda: defaultdict(list))
        for n, item in enumerate(self.items):
            own = self.index[min(shingle, item.size), item.size]
            for block in range(blocks):
                value = self.value(int(item.print), block)
                for f in flips:
                    own[block, value ^ f].append(n)
        self.index = {k: dict(v) for k, v in self.index.items()}
        self.shingles, self.gates = {}, {}
        for k in {k for k, _ in self.index}:
            known = np.unique(np.array([h for x in self.items if min(shingle, x.size) == k for h in x.bag], np.uint64))
            gate = np.zeros(1 << GATE, bool)
            gate[(known >> np.uint64(64 - GATE)).astype(np.int64)] = True
            self.shingles[k], self.gates[k] = known, gate

    def value(self, fingerprint: int, block: int) -> int:
        return fingerprint >> (block * self.width) & ((1 << self.width) - 1)

    def members(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """Which hashes are shingles of an item."""
        out = self.gates[k][(hashes >> np.uint64(64 - GATE)).astype(np.int64)]
        at = np.flatnonzero(out)
        if len(at):
            known = self.shingles[k]
            place = np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)
            out[at] = known[place] == hashes[at]
        return out

    def matches(self, hashes: np.ndarray, least: float) -> list[tuple[int, int, int, int, float]]:
        """(item, first word, words, distance, similarity) of the best window for each item that a text holds; hashes are of its words."""
        best: dict[int, tuple[int, int, int, int, float]] = {}
        n = len(hashes)
        for k in sorted(self.shingles):
            with quiet():
                own = shingle_hashes(hashes, k)
            if not len(own) or not (mask := self.members(own, k)).any():
                continue
            reached = np.concatenate(([0], np.cumsum(mask)))
            ones = None
            for (shingle, size), index in self.index.items():
                if shingle != k:
                    continue
                count = min(len(own), size - k + 1)
                starts = np.arange(len(own) - count + 1)
                # Shared shingles that similarity `least` takes, of a window with as many shingles as the item or fewer.
                need = least / (1 + least) * (count + size - k + 1)
                starts = starts[reached[starts + count] - reached[starts] >= need - 1e-9]
                if not len(starts):
                    continue
                if ones is None:
                    bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    ones = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, 0, dtype=np.int32)))
                prints = np.packbits((ones[starts + count] - ones[starts]) * 2 > count, axis=1, bitorder="little").view(np.uint64)[:, 0]
                for s, fp in zip(starts.tolist(), prints.tolist()):
                    near = {x for block in range(self.blocks) for x in index.get((block, self.value(fp, block)), ())}
                    bag = None
                    for x in near:
                        item = self.items[x]
                        far = (fp ^ int(item.print)).bit_count()
                        if far > self.radius:
                            continue
                        bag = bag or Counter(own[s : s + count].tolist())
                        alike = similarity(bag, item.bag)
                        if alike >= least - 1e-12 and (x not in best or alike > best[x][4]):
                            best[x] = (item.key, s, min(size, n), far, alike)
        return [best[x] for x in sorted(best)]


class Items:
    """A group of items, as it is broadcast; its index is built once in each worker."""

    def __init__(self, items: list[tuple[int, str]], shingle: int):
        self.items, self.shingle, self.built = items, shingle, None

    def index(self) -> ItemIndex:
        self.built = self.built or ItemIndex(self.items, self.shingle)
        return self.built


MATCHES = "array<struct<item_id:long,start_word:long,n_words:long,distance:int,similarity:double>>"


def with_matches(documents: DataFrame, items: list[tuple[int, str]], least: float, shingle: int) -> DataFrame:
    """own (each row, as a struct) and `matches`, for one group of items."""
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(Items(items, shingle))
    text = documents.columns.index("text")
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("distance", pa.int32()), ("similarity", pa.float64())]))
    fields = ("item_id", "start_word", "n_words", "distance", "similarity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for b in batches_of(batches):
            index = shared.value.index()
            if lexicon.full():
                lexicon.reset()
            found = []
            for t in as_texts(b.column(0).field(text)):
                ids = lexicon.ids(WORD.findall(t.lower()))
                found.append([dict(zip(fields, m)) for m in index.matches(lexicon.array()[ids], least)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, arrow)], names=["own", "matches"])

    return documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("own")).mapInArrow(run, StructType().add("own", documents.schema).add(StructType.fromDDL(f"matches {MATCHES}")[0]))


def item_groups(items: DataFrame, group_items: int) -> Iterator[list[tuple[int, str]]]:
    """Items (item_id, text) in groups of about group_items, each read when its turn comes."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    groups = -(-items.count() // group_items)
    for g in range(groups):
        yield [tuple(r) for r in items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g).orderBy("item_id", "text").collect()]


def leaks(documents: DataFrame, items: DataFrame, *, least: float = 0.8, shingle: int = 5, group_items: int = 10_000) -> DataFrame:
    """doc_id, item_id, start_word, n_words, distance, similarity: the best window of each document for each item that it holds."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for group in item_groups(items, group_items):
        own = with_matches(rows, group, least, shingle).select("own.doc_id", F.inline("matches"))
        out = own if out is None else out.union(own)
    if out is None:
        out = documents.sparkSession.createDataFrame([], "doc_id long, item_id long, start_word long, n_words long, distance int, similarity double")
    return out


def decontaminate(documents: DataFrame, items: DataFrame, *, least: float = 0.8, shingle: int = 5, group_items: int = 10_000) -> DataFrame:
    """The documents that hold no item, as they are."""
    columns = documents.columns
    for group in item_groups(items, group_items):
        documents = with_matches(documents, group, least, shingle).filter(F.size("matches") == 0).select(*(F.col("own").getField(c).alias(c) for c in columns))
    return documents
