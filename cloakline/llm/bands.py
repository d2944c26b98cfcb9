"""Sets of word shingles: wide SimHash fingerprints with their grid cells, and the exact check of links.

Two texts of Jaccard similarity 0.8 differ in about 15 % of a fingerprint's bits, 10 of 64, which no grid on choices of
segment groups reaches: its choices grow as the groups over the radius. So a set has a fingerprint of 1024 bits here. Its
segments (of one bit, as the narrowest tell most) are dealt to 64 groups, twice, and the counts of each group's
segments are a cell. Two fingerprints of 63 or fewer differing bits have a group in common in each dealing; those of 15 %
agree in 4.7 of the 64 groups on the average, and hardly ever in none of the 128 (measured in a test). Sets of few shingles
differ in more bits, so they are dealt ten times.

Links are decided by the exact Jaccard similarity of the two shingle sets. Components of candidates meet in one task
each; components of more than `most` texts are cut into chunks, and each pair of chunks is a task of its own.

`minima` and `band_keys` (minimal hashes) are what these cells are compared with in tests; no query uses them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SEED, Lexicon, as_bytes, batches_of, chain, mix, quiet, shingle_hashes, small_batches, words_of

BANDS, ROWS = 16, 4
_DRAWN = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS), np.uint64)
FACTORS, OFFSETS = _DRAWN[0] | np.uint64(1), _DRAWN[1]

#: 64-bit words of a wide fingerprint, those that a cell's row has, groups of its segments in a dealing, dealings, and those of sets of at most FEW shingles.
WIDE, SHOWN, GROUPS, DEALINGS, MORE_DEALINGS, FEW = 16, 3, 64, 2, 10, 64
TWISTS = np.random.default_rng(SEED + 1).integers(0, 2**64, WIDE, np.uint64)
DEALT = np.stack([np.random.default_rng(SEED + 2 + k).permutation(64 * WIDE) for k in range(MORE_DEALINGS)])


def shingle_set(text: bytes, lexicon: Lexicon, shingle: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    if lexicon.full():
        lexicon.reset()
    ids = lexicon.ids(words_of(text))
    if not len(ids):
        return np.zeros(0, np.uint64)
    with quiet():
        return np.unique(shingle_hashes(lexicon.array()[ids], shingle))


def minima(own: np.ndarray) -> np.ndarray:
    """The minimal hashes of a set; of an empty one, the greatest number each."""
    out = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    with quiet():
        for at in range(0, len(own), 4096):
            out = np.minimum(out, (own[at : at + 4096, None] * FACTORS + OFFSETS).min(0))
    return out


def band_keys(lowest: np.ndarray) -> np.ndarray:
    """A key for each band."""
    with quiet():
        keys = np.arange(BANDS, dtype=np.uint64)
        for k in range(ROWS):
            keys = chain(keys, lowest.reshape(BANDS, ROWS)[:, k])
        return keys


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted sets; empty ones are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def text_print(own: np.ndarray) -> np.uint64:
    """SimHash of a set of shingles: a bit is 1 if it is set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(own), 1 << 16):
        ones += np.unpackbits(own[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(own), bitorder="little").view(np.uint64)[0]


def wide_print(own: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingles in WIDE words: a bit is 1 if it is set in over half of them; at half, as in the shingle that comes first in an order of each word's own."""
    ones, least, first = np.zeros(64 * WIDE, np.int64), np.full(WIDE, 2**64 - 1, np.uint64), np.zeros(WIDE, np.uint64)
    for at in range(0, len(own), 4080):
        with quiet():
            h = mix(own[at : at + 4080, None] ^ TWISTS)
            rank = h * FACTORS[0]
        place = rank.argmin(0)
        lowest, words = np.take_along_axis(rank, place[None], 0)[0], np.take_along_axis(h, place[None], 0)[0]
        least, first = np.minimum(least, lowest), np.where(lowest <= least, words, first)
        bits = np.unpackbits(h.view(np.uint8), axis=1, bitorder="little")
        for k in range(0, len(bits), 255):  # sums of 255 bits stay within a byte
            ones += bits[k : k + 255].sum(0, dtype=np.uint8)
    over = np.packbits(2 * ones > len(own), bitorder="little").view(np.uint64)
    half = np.packbits(2 * ones == len(own), bitorder="little").view(np.uint64)
    return over | (half & first)


def wide_cells(prints: np.ndarray, dealings: int = DEALINGS) -> np.ndarray:
    """Keys of the grid cells of each fingerprint, a key for each group of segments of each dealing: the group's number, then its segments' counts."""
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), -1), axis=1, bitorder="little")
    counts = np.packbits(bits[:, DEALT[:dealings].ravel()].reshape(len(prints), dealings * GROUPS, -1), axis=2, bitorder="little")
    return counts.view("<u2")[:, :, 0].astype(np.int64) | np.arange(dealings * GROUPS, dtype=np.int64) << 16


def sketches(documents: DataFrame, shingle: int, keep: tuple[str, ...]) -> DataFrame:
    """node (hash of the set), prints (its wide SimHash), size (its shingles) and the columns to keep of each document (first text, then the others)."""
    small_batches(documents.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for b in batches_of(batches):
            nodes, prints, sizes = [], [], []
            for text in as_bytes(b.column(0)):
                own = shingle_set(text, lexicon, shingle)
                nodes.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                prints.append(wide_print(own).view(np.int64))
                sizes.append(len(own))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(prints) + 1) * WIDE, pa.int32()), pa.array(np.concatenate(prints)))
            yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), lists, pa.array(sizes, pa.int64()), *b.columns[1:]], names=["node", "prints", "size", *keep])

    rows = documents.select(F.col("text").cast("string").alias("text"), *keep)
    return rows.mapInArrow(run, ", ".join(["node long, prints array<long>, size long", *(f"`{c}` {kinds[c]}" for c in keep)]))


def keyed(nodes: DataFrame) -> DataFrame:
    """key, node, and the first SHOWN words of its fingerprint, for each cell of each node (node, prints, size)."""
    names = ["key", "node", *(f"fp{k}" for k in range(SHOWN))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            all_nodes, few = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False) <= FEW
            all_prints = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(all_nodes), WIDE)
            for which, dealings in ((few, MORE_DEALINGS), (~few, DEALINGS)):
                own, prints, n = all_nodes[which], all_prints[which], dealings * GROUPS
                step = 65_536 // n
                for at in range(0, len(own), step):
                    part = prints[at : at + step]
                    cols = (wide_cells(part, dealings).ravel(), np.repeat(own[at : at + step], n), *(np.repeat(part[:, k], n) for k in range(SHOWN)))
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=names)

    return nodes.select("node", "prints", "size").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def reached(n: int, linked) -> list[tuple[int, int]]:
    """Links that connect 0 to n - 1 as linked(one, many) does, which gives those of many that are linked to one: each is asked once, about those not met yet."""
    left, out = np.arange(n), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            one = queue.pop()
            found = linked(one, left)
            if len(found):
                out.extend((one, int(x)) for x in found)
                queue.extend(found.tolist())
                left = np.setdiff1d(left, found, assume_unique=True)
    return out


def groups_of(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[int, bool, list[list[pa.Array]]]]:
    """Slices of sorted batches by the value of their first column: that value, whether the group goes on from the piece
    before, and the other columns. A group comes in pieces of about `most` rows; groups of one row in a batch's middle are left out."""
    held_key, held, size, again = None, [], 0, False
    for b in batches_of(batches):
        keys = b.column(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate((np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        at = 0
        for end in ends.tolist():
            if end - at > 1 or at == 0 or end == len(keys):
                if keys[at] != held_key or size >= most:
                    if held:
                        yield held_key, again, held
                    again = keys[at] == held_key
                    held_key, held, size = keys[at], [], 0
                held.append([c.slice(at, end - at) for c in b.columns[1:]])
                size += end - at
            at = end
    if held:
        yield held_key, again, held


def exact_links(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Links that connect what pairs of sets of similarity `least` or more connect."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1] if sizes.sum() else np.zeros(0, np.int64)
    starts = np.concatenate(([0], np.cumsum(sizes)))
    marked = np.zeros(int(flat.max()) + 1 if len(flat) else 0, bool)

    def linked(one: int, many: np.ndarray) -> np.ndarray:
        low, high = sizes[one] * least - 1e-9, sizes[one] / least + 1e-9
        many = many[(sizes[many] >= low) & (sizes[many] <= high)]
        if not sizes[one] or not len(many):
            return many  # empty sets are equal
        own = flat[starts[one] : starts[one + 1]]
        marked[own] = True
        both = np.zeros(len(many), np.int64)
        step = max(1, 4_000_000 // int(sizes[many].max()))
        for at in range(0, len(many), step):
            part = many[at : at + step]
            n = sizes[part]
            first = np.concatenate(([0], np.cumsum(n)[:-1]))
            places = np.arange(int(n.sum())) + np.repeat(starts[part] - first, n)
            both[at : at + step] = np.add.reduceat(marked[flat[places]].astype(np.int64), first)
        marked[own] = False
        return many[both >= least * (sizes[one] + sizes[many] - both) - 1e-9]

    return reached(len(sets), linked)


def checked_links(texts: DataFrame, shingle: int, least: float) -> DataFrame:
    """Links a, b between nodes of similarity `least` or more, enough to connect what such pairs connect within a block; texts has block, node and text."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon()
        for _, _, parts in groups_of(batches, 1 << 62):  # a block is bounded by its chunks
            order, sets = [], []
            for nodes, text in parts:
                for node, t in zip(nodes.to_pylist(), as_bytes(text)):
                    if not order or order[-1] != node:  # a repeated row; they are sorted
                        order.append(node)
                        sets.append(shingle_set(t, lexicon, shingle))
            links = exact_links(sets, least) if len(sets) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([order[x] for x, _ in links], pa.int64()), pa.array([order[y] for _, y in links], pa.int64())], names=["a", "b"])

    return texts.repartition("block").sortWithinPartitions("block", "node").mapInArrow(run, "a long, b long")
