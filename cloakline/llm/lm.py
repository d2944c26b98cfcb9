"""Language-model scoring from a log-frequency Bloom filter.

N-grams (words and pairs) are counted over all training text. The filter holds, for an n-gram with count c, the levels
1 to 1 + floor(log2 c), each as an element of its own; a lookup probes level after level until one is missing, and the
last level found is the quantised count. False positives can only raise it. The filter is cut by hash into shards that
are built where their n-grams were counted; each level of an n-gram sets BITS bits of one 64-bit word, so a probe
touches one word.

Shards go to the workers by broadcast in groups of at most `group_bytes`. A pair lives in one shard, so where there are
several groups each is one pass over the documents that adds the pairs it holds; words' levels, which every pair needs,
come first in the same way. Where that would take more than `most_passes`, no shard is broadcast: texts are dealt to
chunks of `chunk_tokens`, each chunk asks every shard once for its distinct n-grams, the probes happen beside the shard,
and the answers meet their chunk. That shuffles texts and distinct n-grams once, however large the filter is, and gives
the same scores; a frequent pair is asked for once a chunk.

The model is a Dirichlet-smoothed bigram: P(w | v) = (c(v w) + mu P(w)) / (c(v) + mu), with P(w) from words' counts by
adding a half; each count is its level's middle. The text's first token follows the end token.

The exact base score needs words' exact counts: the most frequent `head_words` are broadcast, and what is left of a text
is joined by hash (words outside the head are rare, so no key of the join is hot).

Defined cases: null or empty text is the end token alone; null ids are training rows; repeated rows are scored each;
with no training row counts are zero and the scores stay finite; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import SEED, Lexicon, Scratch, as_bytes, batches_of, chain, input_size, mix, quiet, small_batches, sum_pairs, words_of

#: Hash of the end token: of a byte that no word can be.
END = np.uint64(xxhash.xxh64_intdigest(b"\n", SEED))
WORDS, PAIRS = 1, 2
#: Bits set for a level of an n-gram, and filter bits for it.
BITS, SPACE = 4, 10
#: N-grams in a row of the shuffle.
PACKED = 1 << 14
#: Tokens of texts that are looked up together.
TOGETHER = 1 << 16
LEVEL = np.uint64(0x9E3779B97F4A7C15)


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c) for positive counts."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def middles() -> np.ndarray:
    """The count that stands for each level: 0, 1, and the geometric middle of the level's range from there."""
    low = 2.0 ** (np.arange(64) - 1)
    out = np.sqrt(low * (2 * low - 1))
    out[:2] = 0, 1
    return out


def probes(keys: np.ndarray, level: int, words: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The filter word of a level of each n-gram, and the bits that it sets there."""
    h = mix(keys + LEVEL * np.uint64(level))
    place = ((h >> np.uint64(32)) * np.asarray(words, np.uint64) >> np.uint64(32)).astype(np.int64)
    mask = np.zeros(len(keys), np.uint64)
    for k in range(BITS):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return place, mask


def build(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The filter words of a shard."""
    levels = level_of(counts)
    words = max(1, -(-int(levels.sum()) * SPACE // 64))
    out = np.zeros(words, np.uint64)
    for level in range(1, int(levels.max(initial=0)) + 1):
        place, mask = probes(keys[levels >= level], level, words)
        order = np.argsort(place, kind="stable")
        place = place[order]
        first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        out[place[first]] |= np.bitwise_or.reduceat(mask[order], first)
    return out


class Filter:
    """A group of shards: looks up quantised counts of the n-grams that these shards hold."""

    def __init__(self, shards: dict[int, bytes], total: int):
        self.total = total
        self.size, self.first = np.zeros(total, np.uint64), np.full(total, -1, np.int64)
        at = 0
        for k in sorted(shards):
            self.first[k], self.size[k] = at, len(shards[k]) // 8
            at += len(shards[k]) // 8
        self.words = np.frombuffer(b"".join(shards[k] for k in sorted(shards)), np.uint64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels of n-grams; 0 if never seen, -1 if another group holds the shard."""
        with quiet():
            shard = (keys % np.uint64(self.total)).astype(np.int64)
            out = np.where(self.first[shard] >= 0, 0, -1).astype(np.int8)
            live = np.flatnonzero(out == 0)
            level = 1
            while len(live):
                k, s = keys[live], shard[live]
                place, mask = probes(k, level, self.size[s])
                live = live[self.words[self.first[s] + place] & mask == mask]
                out[live] = level
                level += 1
        return out


class Answers:
    """Levels that shards have given."""

    def __init__(self, keys: np.ndarray, levels: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.given = keys[order], levels[order]

    def levels(self, keys: np.ndarray) -> np.ndarray:
        return exact(self.keys, self.given, keys)


def packed(keys: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """Distinct n-grams by shard, at most PACKED at a time."""
    keys = np.unique(keys)
    shard = (keys % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    shard, keys = shard[order], keys[order]
    first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
    for x, y in zip(first.tolist(), [*first[1:].tolist(), len(shard)]):
        for a in range(x, y, PACKED):
            yield int(shard[x]), keys[a : min(a + PACKED, y)].tobytes()


def hashes_of(words: list[bytes], lexicon: Lexicon) -> np.ndarray:
    """Hashes of a text's tokens: its words, then the end."""
    ids = lexicon.ids(words)
    return np.append(lexicon.array()[ids], END)


def pair_keys(h: np.ndarray) -> np.ndarray:
    """Hashes of a text's pairs: the end and its first token, and so on. Each text ends with the end, so texts in a row have the pairs that each has alone."""
    return chain(np.concatenate(([END], h[:-1])), h)


def together(sizes: list[int], most: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Runs of texts, as first and last but one, of at most `most` tokens; one text at least."""
    first, held = 0, 0
    for k, n in enumerate(sizes):
        if k > first and held + n > most:
            yield first, k
            first, held = k, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def looked_up(texts: list[np.ndarray], levels_of) -> list[np.ndarray]:
    """Levels of each text's n-grams, asked for many texts at once: a call costs more than the few hundred probes of a text."""
    out = []
    for x, y in together([len(h) for h in texts]):
        out.extend(np.split(levels_of(np.concatenate(texts[x:y])), np.cumsum([len(h) for h in texts[x : y - 1]])))
    return out


def count_ngrams(training: DataFrame, shards: int, parts: int) -> DataFrame:
    """Shards of counted n-grams over all training texts: rows of kind, shard, the filter's words, and for words their hashes and counts.

    A task sums what it reads; then a shard's n-grams meet in one task.
    """
    small_batches(training.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, held, n = Lexicon(), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            own_words = np.concatenate(held)
            held.clear()
            for kind in (WORDS, PAIRS):
                with quiet():
                    keys = own_words if kind == WORDS else pair_keys(own_words)
                keys, counts = sum_pairs(keys, np.ones(len(keys), np.int64))
                shard = (keys % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                shard, keys, counts = shard[order], keys[order], counts[order].astype("<u4")
                first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
                cuts = [(a, min(a + PACKED, y)) for x, y in zip(first.tolist(), [*first[1:].tolist(), len(shard)]) for a in range(x, y, PACKED)]
                # A shard's n-grams, packed: rows of single n-grams cost more than their counting, rows of megabytes the JVM's heap.
                for at in range(0, len(cuts), 64):
                    own = cuts[at : at + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(shard[x]) for x, _ in own], pa.int32()), pa.array([kind] * len(own), pa.int8()), pa.array([keys[x:y].tobytes() for x, y in own], pa.binary()), pa.array([counts[x:y].tobytes() for x, y in own], pa.binary())],
                        names=["shard", "kind", "h", "n"],
                    )

        for b in batches_of(batches):
            if lexicon.full():
                lexicon.reset()
            for text in as_bytes(b.column(0)):
                h = hashes_of(words_of(text), lexicon)
                held.append(h)
                n += len(h)
                if n > 1_500_000:
                    yield from out()
                    n = 0
        if n:
            yield from out()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        for b in batches_of(batches):
            for shard, kind, h, n in zip(*(c.to_pylist() for c in b.columns)):
                held.setdefault((shard, kind), []).append((np.frombuffer(h, np.uint64), np.frombuffer(n, "<u4")))
        while held:
            (shard, kind), own = held.popitem()
            keys, counts = sum_pairs(np.concatenate([x for x, _ in own]), np.concatenate([x for _, x in own]).astype(np.int64))
            del own
            with quiet():
                words = build(keys, counts)
            empty = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([kind], pa.int8()), pa.array([words.tobytes()], pa.binary()), pa.array([keys.view(np.int64) if kind == WORDS else empty], pa.list_(pa.int64())), pa.array([counts if kind == WORDS else empty], pa.list_(pa.int64())), pa.array([int(counts.sum())])],
                names=["shard", "kind", "bits", "keys", "counts", "total"],
            )

    counted = training.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "shard int, kind byte, h binary, n binary")
    return counted.repartition(parts, "shard").mapInArrow(gather, "shard int, kind byte, bits binary, keys array<long>, counts array<long>, total long")


def groups_of(sizes: list[tuple[int, int]], most: int) -> list[list[int]]:
    """Shards in runs of at most `most` bytes, one shard at least."""
    out, room = [], 0
    for shard, size in sorted(sizes):
        if not out or size > room:
            out.append([])
            room = most
        out[-1].append(shard)
        room -= size
    return out


def score_texts(documents: DataFrame, training: DataFrame, *, mu: float = 300.0, head_words: int = 1 << 19, group_bytes: int = 128 << 20, chars_per_shard: int = 8_000_000, most_passes: int = 8, chunk_tokens: int = 500_000) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10 probability) of every row of documents (doc_id, text)."""
    spark = documents.sparkSession
    small_batches(spark)
    sc = spark.sparkContext
    scratch = Scratch(spark, "lm")
    shards = max(1, -(-input_size(training) // chars_per_shard))
    table = scratch.table(count_ngrams(training, shards, max(1, -(-shards // 2))), "ngrams")
    words = table.filter(F.col("kind") == WORDS)
    counts = words.select(F.explode(F.arrays_zip("keys", "counts")).alias("x")).select(F.col("x.keys").alias("h"), F.col("x.counts").alias("c"))
    total, distinct = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()
    bottom = float(np.log10(total + 0.5 * (distinct + 1)))
    # The head, at most head_words hashes and counts, is a bounded broadcast; the line is a count, so no count is split.
    line = 1
    if distinct > head_words:
        tally = counts.groupBy(F.log2("c").cast("int").alias("b")).count().collect()
        more, line = 0, 1
        for r in sorted(tally, key=lambda r: -r.b):
            more += r["count"]
            if more > head_words:
                line = 2 ** (r.b + 1)
                break
    head = counts.filter(F.col("c") >= line).toArrow()
    keys = head.column("h").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    shared_head = sc.broadcast((keys[order], head.column("c").to_numpy()[order]))

    spent = []  # broadcasts that no later step reads

    def load(kind: int, group: list[int]):
        rows = table.filter((F.col("kind") == kind) & F.col("shard").isin(group)).select("shard", "bits").toArrow()
        spent.append(sc.broadcast(Filter(dict(zip(rows.column("shard").to_pylist(), rows.column("bits").to_pylist())), shards)))
        return spent[-1]

    def written(rows: DataFrame, name: str, before: str | None = None) -> DataFrame:
        """A pass's rows, as a table: its filters leave the workers' memory, and the table before goes."""
        rows = scratch.table(rows, name)
        while spent:
            spent.pop().destroy()
        if before:
            scratch.drop(before)
        return rows

    sizes = {kind: [(r.shard, r.size) for r in table.filter(F.col("kind") == kind).select("shard", F.length("bits").alias("size")).collect()] for kind in (WORDS, PAIRS)}
    groups = {kind: groups_of(sizes[kind], group_bytes) for kind in (WORDS, PAIRS)}
    middle, floor_p = middles(), 0.5 / (total + 0.5 * (distinct + 1))

    def pair_scores(texts: list[np.ndarray], levels: list[np.ndarray], filters) -> list[float]:
        """For each text, the sum of the log probabilities of the tokens whose pair a group holds."""
        out = []
        for x, y in together([len(h) for h in texts]):
            h, c = np.concatenate(texts[x:y]), middle[np.maximum(np.concatenate(levels[x:y]), 0)]
            with quiet():
                pair = filters.levels(pair_keys(h)) if filters else np.zeros(len(h), np.int8)
            before = np.concatenate((c[-1:], c[:-1]))  # the end's count stands at each text's end
            joint = np.minimum(middle[np.maximum(pair, 0)], np.minimum(before, c))
            p = (joint + mu * np.maximum(c + 0.5, 0.5) / 0.5 * floor_p) / (before + mu)
            held = pair >= 0
            ends = np.cumsum(np.concatenate(([0], np.add.reduceat(held, np.cumsum([0, *(len(t) for t in texts[x : y - 1])]), dtype=np.int64))))
            logs = np.log10(p[held])
            out.extend(float(logs[a:b].sum()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()))
        return out

    def first_pass(filters, pairs, fused: bool, last: bool) -> DataFrame:
        """Token counts, the head's part of the base, what is left for the join, and words' levels as far as this group knows them; if fused, the first group of pairs is scored at once."""
        names = ["doc_id", "text", "n_tokens", "n_known", "base", "left", "times", "levels", "score"]
        kinds = {"doc_id": "long", "text": "string", "n_tokens": "long", "n_known": "long", "base": "double", "left": "array<long>", "times": "array<long>", "levels": "binary", "score": "double"}
        if last:
            names = [n for n in names if n not in ("text", "levels")]

        split = line > 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            head_keys, head_counts = shared_head.value
            levels_of = filters.value.levels if filters else lambda h: np.zeros(len(h), np.int8)
            end = np.array([END])
            end_count, end_level = exact(head_keys, head_counts, end), levels_of(end)
            lexicon = Lexicon()
            known_counts, known_levels, known = np.zeros(1024, np.int64), np.zeros(1024, np.int8), 0
            for b in batches_of(batches):
                if lexicon.full():
                    lexicon.reset()
                    known = 0
                cut = [lexicon.ids(words_of(text)) for text in as_bytes(b.column(1))]
                h = lexicon.array()
                if len(h) > len(known_counts):
                    known_counts, known_levels = np.resize(known_counts, 2 * len(h)), np.resize(known_levels, 2 * len(h))
                new = h[known:]  # counts and levels of words met for the first time
                known_counts[known : len(h)], known_levels[known : len(h)] = exact(head_keys, head_counts, new), levels_of(new)
                known = len(h)
                rows, owns, all_levels = [], [np.append(h[ids], END) for ids in cut], [np.append(known_levels[ids], end_level) for ids in cut]
                scores = pair_scores(owns, all_levels, pairs.value if pairs else None) if fused else [0.0] * len(cut)
                for ids, own, levels, score in zip(cut, owns, all_levels, scores):
                    c = np.append(known_counts[ids], end_count)
                    left = own[c == 0] if split else np.zeros(0, np.uint64)
                    left, times = sum_pairs(left, np.ones(len(left), np.int64))
                    seen = c[c > 0]
                    rows.append((len(c), len(seen), float(np.log10(seen + 0.5).sum()), left.view(np.int64), times, levels.tobytes(), score))
                cols = list(zip(*rows))
                arrow = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.float64()]
                arrays = {"doc_id": b.column(0), "text": b.column(1)} | {n: pa.array(list(x), k) for n, x, k in zip(("n_tokens", "n_known", "base", "left", "times", "levels", "score"), cols, arrow)}
                yield pa.RecordBatch.from_arrays([arrays[n] for n in names], names=names)

        return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names))

    def more_levels(df: DataFrame, filters) -> DataFrame:
        at = df.columns.index("levels")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon = Lexicon()
            for b in batches_of(batches):
                if lexicon.full():
                    lexicon.reset()
                found = looked_up([hashes_of(words_of(t), lexicon) for t in as_bytes(b.column(1))], filters.value.levels)
                out = [np.maximum(np.frombuffer(old, np.int8), new).tobytes() for new, old in zip(found, b.column(at).to_pylist())]
                yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(out, pa.binary()), *b.columns[at + 1 :]], names=b.schema.names)

        return df.mapInArrow(run, df.schema)

    def add_pairs(df: DataFrame, filters, last: bool) -> DataFrame:
        """Adds the log probabilities of the tokens whose pair this group holds."""
        names = [c for c in df.columns if not (last and c in ("text", "levels"))]
        at, held = df.columns.index("score"), df.columns.index("levels")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon = Lexicon()
            for b in batches_of(batches):
                if lexicon.full():
                    lexicon.reset()
                texts, levels = [hashes_of(words_of(t), lexicon) for t in as_bytes(b.column(1))], [np.frombuffer(x, np.int8) for x in b.column(held).to_pylist()]
                more = pair_scores(texts, levels, filters.value if filters else None)
                out = [score + added for score, added in zip(b.column(at).to_pylist(), more)]
                arrays = {n: x for n, x in zip(b.schema.names, b.columns)} | {"score": pa.array(out, pa.float64())}
                yield pa.RecordBatch.from_arrays([arrays[n] for n in names], names=names)

        return df.mapInArrow(run, df.select(*names).schema)

    def beside_shards(rows: DataFrame) -> DataFrame:
        """Scores of texts where no group of shards goes to the workers."""
        at = {c: k for k, c in enumerate(rows.columns)}

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunk, held = TaskContext.get().partitionId() << 32, 0
            for b in batches_of(batches):
                own = []
                for n in b.column(at["n_tokens"]).to_pylist():
                    if held and held + n > chunk_tokens:
                        chunk, held = chunk + 1, 0
                    held += n
                    own.append(chunk)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int64())], names=[*b.schema.names, "chunk"])

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lexicon, now = Lexicon(), None
            wanted: list[np.ndarray] = []

            def out() -> Iterator[pa.RecordBatch]:
                if not wanted:
                    return
                h = np.concatenate(wanted)
                wanted.clear()
                for kind in (WORDS, PAIRS):
                    with quiet():
                        rows = list(packed(h if kind == WORDS else pair_keys(h), shards))
                    for k in range(0, len(rows), 64):
                        own = rows[k : k + 64]
                        yield pa.RecordBatch.from_arrays([pa.array([now] * len(own), pa.int64()), pa.array([kind] * len(own), pa.int8()), pa.array([x for x, _ in own], pa.int32()), pa.array([h for _, h in own], pa.binary())], names=["chunk", "kind", "shard", "h"])

            for b in batches_of(batches):
                if lexicon.full():
                    lexicon.reset()
                for text, chunk in zip(as_bytes(b.column(0)), b.column(1).to_pylist()):
                    if chunk != now:
                        yield from out()
                        now = chunk
                    wanted.append(hashes_of(words_of(text), lexicon))
            yield from out()

        def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
            asked_h = asked.column("h").to_pylist()
            shard = Filter({0: own.column("bits")[0].as_py()}, 1) if own.num_rows else None
            found = [(shard.levels(np.frombuffer(h, np.uint64)) if shard else np.zeros(len(h) // 8, np.int8)).astype(np.int8).tobytes() for h in asked_h]
            return pa.table([asked.column("chunk"), asked.column("kind"), asked.column("h"), pa.array(found, pa.binary())], names=["chunk", "kind", "h", "given"])

        kept = [c for c in rows.columns if c not in ("text", "levels", "score")]

        def finish(texts: pa.Table, answers: pa.Table) -> pa.Table:
            known = {}
            for kind in (WORDS, PAIRS):
                own = [(h, g) for k, h, g in zip(*(answers.column(c).to_pylist() for c in ("kind", "h", "given"))) if k == kind]
                known[kind] = Answers(np.frombuffer(b"".join(h for h, _ in own), np.uint64), np.frombuffer(b"".join(g for _, g in own), np.int8))
            lexicon = Lexicon()
            own = [hashes_of(words_of(text), lexicon) for text in as_bytes(texts.column("text").combine_chunks())]
            scores = pair_scores(own, looked_up(own, known[WORDS].levels), known[PAIRS])
            return pa.table([*(texts.column(c) for c in kept), pa.array(scores, pa.float64())], names=[*kept, "score"])

        chunks = written(rows.mapInArrow(deal, StructType([*rows.schema.fields, StructField("chunk", LongType())])), "chunks")
        asked = chunks.select("text", "chunk").mapInArrow(ask, "chunk long, kind byte, shard int, h binary")
        filters = table.select("kind", "shard", "bits")
        answers = asked.groupBy("kind", "shard").cogroup(filters.groupBy("kind", "shard")).applyInArrow(answer, "chunk long, kind byte, h binary, given binary")
        return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, StructType([f for f in rows.schema.fields if f.name in kept] + [StructField("score", DoubleType())]))

    word_groups, pair_groups = groups[WORDS] or [None], groups[PAIRS] or [None]

    def loaded(kind: int, group: list[int] | None):
        return load(kind, group) if group is not None else None

    last = None
    if len(word_groups) + len(pair_groups) - 1 > most_passes:
        rows = beside_shards(first_pass(None, None, False, False))
        last = "chunks"
    else:
        fused = len(word_groups) == 1
        rows = first_pass(loaded(WORDS, word_groups[0]), loaded(PAIRS, pair_groups[0]) if fused else None, fused, fused and len(pair_groups) == 1)
        for k, group in enumerate(word_groups[1:]):
            rows = written(rows, f"words{k}", last)
            last = f"words{k}"
            rows = more_levels(rows, load(WORDS, group))
        for k, group in enumerate(pair_groups):
            if k or not fused:
                rows = written(rows, f"pairs{k}", last)
                last = f"pairs{k}"
                rows = add_pairs(rows, loaded(PAIRS, group), k == len(pair_groups) - 1)
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()), "scored", last)
    shared_head.destroy()
    if line > 1:
        left = rows.filter(F.size("left") > 0).select("uid", F.explode(F.arrays_zip("left", "times")).alias("x")).select("uid", F.col("x.left").alias("h"), F.col("x.times").alias("times"))
        found = left.join(counts.filter(F.col("c") < line), "h").groupBy("uid").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 0.5)).alias("added"))
        rows = rows.join(found, "uid", "left")
    else:
        rows = rows.withColumn("more", F.lit(0).cast("long")).withColumn("added", F.lit(0.0))
    known = F.col("n_known") + F.coalesce("more", F.lit(0))
    return rows.select(
        "doc_id",
        "n_tokens",
        known.alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("added", F.lit(0.0)) + (F.col("n_tokens") - known) * float(np.log10(0.5)) - F.col("n_tokens") * F.lit(bottom)).alias("base_score"),
        "score",
    )


def exact(keys: np.ndarray, counts: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Counts of wanted keys in a sorted table; 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, counts[at], 0)
