"""Hierarchical multi-length packing of token ids into training sequences.

Documents are routed to tiers of context sizes (powers of two). Whole windows of the longest tier are cut off first;
what remains goes to the smallest tier that holds it. From the longest tier down, each window takes its own tier's piece
and its gap is filled from this and shorter tiers: with the largest piece that fits, then by cutting one. So a window is
always full; only what is left at the end of a task is cut at powers of two, which need no padding either. Within a
tier, windows are dealt to step groups of equal tokens in snake order of their attention cost.

Work is local to a task: documents stream through, no shuffle, and memory holds the pieces of one flush.

Defined cases: null or empty text is a document of the end id only; repeated rows are packed each; null ids stay null;
other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_texts, batches_of, small_batches
from .tokens import encoder

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, ids binary"
#: Sequence ids of a task start at its number times this.
PER_TASK = 1 << 40


class Piece:
    __slots__ = ("doc", "ids", "length", "start", "total")

    def __init__(self, doc, start: int, length: int, total: int, ids: bytes):
        self.doc, self.start, self.length, self.total, self.ids = doc, start, length, total, ids

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, n, self.total, self.ids[: 4 * n]), Piece(self.doc, self.start + n, self.length - n, self.total, self.ids[4 * n :])


class Packer:
    """Packs the pieces of one task. `tiers` are powers of two, longest first."""

    def __init__(self, tiers: tuple[int, ...] = (1024, 512, 256, 128)):
        if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers), reverse=True):
            raise ValueError("tiers are powers of two, longest first")
        self.tiers = tiers
        # By tier: pieces that belong there, in order of length.
        self.waiting: dict[int, list[Piece]] = {t: [] for t in tiers}
        self.done: list[tuple[int, list[Piece]]] = []

    def _route(self, piece: Piece) -> None:
        tier = next(t for t in reversed(self.tiers) if piece.length <= t)
        bisect.insort(self.waiting[tier], piece, key=lambda p: p.length)

    def add(self, doc, ids: bytes) -> None:
        n, top = len(ids) // 4, self.tiers[0]
        for at in range(0, n - n % top, top):
            self.done.append((top, [Piece(doc, at, top, n, ids[4 * at : 4 * (at + top)])]))
        if n % top:
            at = n - n % top
            self._route(Piece(doc, at, n - at, n, ids[4 * at :]))

    def _fill(self, gap: int, level: int) -> list[Piece] | None:
        """Pieces that fill a gap exactly, from this tier and shorter ones; None if there aren't enough, and then nothing is taken."""
        if sum(p.length for t in self.tiers[level:] for p in self.waiting[t][: gap + 1]) < gap:
            return None
        out = []
        while gap:
            best = None
            for t in self.tiers[level:]:
                k = bisect.bisect_right(self.waiting[t], gap, key=lambda p: p.length)
                if k:
                    best = self.waiting[t].pop(k - 1)
                    break
            if best is None:  # every piece is longer than the gap: the shortest is cut
                t = next(t for t in reversed(self.tiers[level:]) if self.waiting[t])
                best, rest = self.waiting[t].pop(0).cut(gap)
                self._route(rest)
            out.append(best)
            gap -= best.length
        return out

    def flush(self, last: bool = False) -> list[tuple[int, list[Piece]]]:
        """Full windows so far; at the end all that is left too."""
        for level, tier in enumerate(self.tiers):
            own = self.waiting[tier]
            while own:
                first = own.pop()
                rest = self._fill(tier - first.length, level)
                if rest is None:
                    self._route(first)
                    break
                self.done.append((tier, [first, *rest]))
        if last:
            left = [p for t in self.tiers for p in self.waiting[t]]
            self.waiting = {t: [] for t in self.tiers}
            total = sum(p.length for p in left)
            size = self.tiers[0]
            while total:
                while size > total:
                    size //= 2
                window, gap = [], size
                while gap:
                    p = left.pop(0)
                    if p.length > gap:
                        p, rest = p.cut(gap)
                        left.insert(0, rest)
                    window.append(p)
                    gap -= p.length
                self.done.append((size, window))
                total -= size
        out, self.done = self.done, []
        return out


def step_groups(windows: list[tuple[int, list[Piece]]], step_tokens: int) -> list[int]:
    """A group for each window: windows of one tier, of about step_tokens, with like attention cost (sum of squared piece lengths)."""
    groups, first = [0] * len(windows), 0
    for tier in sorted({t for t, _ in windows}, reverse=True):
        own = [k for k, (t, _) in enumerate(windows) if t == tier]
        n = -(-len(own) * tier // step_tokens)
        own.sort(key=lambda k: (-sum(p.length**2 for p in windows[k][1]), k))
        for place, k in enumerate(own):
            turn, at = divmod(place, n)
            groups[k] = first + (at if turn % 2 == 0 else n - 1 - at)
        first += n
    return groups


def pack(documents: DataFrame, tokenizer: str, *, end_id: int = 0, tiers: tuple[int, ...] = (1024, 512, 256, 128), step_tokens: int = 8192, flush_tokens: int = 1_000_000) -> DataFrame:
    """Pieces of packed documents (doc_id, text): where each lies in its document and its sequence, and its ids.

    A sequence's pieces are gapless from offset 0; its length is always a power of two, at most tiers[0].
    """
    small_batches(documents.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(tiers)
        sequence = group = TaskContext.get().partitionId() * PER_TASK
        held = 0

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, group
            windows = packer.flush(last)
            if not windows:
                return
            groups = step_groups(windows, step_tokens)
            rows = []
            for (tier, pieces), g in zip(windows, groups):
                offset = 0
                for p in pieces:
                    rows.append((p.doc, p.start, p.length, p.total, sequence, offset, tier, group + g, p.ids))
                    offset += p.length
                sequence += 1
            group += max(groups) + 1
            cols = list(zip(*rows))
            kinds = [pa.int64()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in PIECES.split(", ")])

        for b in batches_of(batches):
            for doc, ids in zip(b.column(0).to_pylist(), encoder(tokenizer).encode_all(as_texts(b.column(1)))):
                packer.add(doc, ids + end)
                held += len(ids) // 4 + 1
                if held >= flush_tokens:
                    yield from out(False)
                    held = 0
        yield from out(True)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)
