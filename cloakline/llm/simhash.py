"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact check, components.

A fingerprint's bit is 1 if it is set in over half of the hashes of the text's word shingles. The 64 bits are cut into
segments and a fingerprint is mapped to its segments' bit counts. Manhattan distance between two such vectors never
exceeds the Hamming distance of the fingerprints, so it is a lower bound. The segments are dealt to `groups` groups;
of two vectors within distance `radius`, at least groups - radius groups are equal, so both lie in one grid cell of
some choice of that many groups. Cells are joined by their key; inside a cell the Manhattan bound goes first, then the
exact distance, and no more links leave the cell than connect it, never all pairs.

Only distinct fingerprints are joined, each once with the smallest id of its copies. A cell of more than `cell_rows`
fingerprints (many near copies of one text) is not compared in one place at radius 2: its fingerprints are joined by the
points halfway between them instead (see `halfway`), where a group holds no more than 65 fingerprints. Components
come from alternating star contractions over tables in the shared folder.

Defined cases: null or empty text, or text without words, has fingerprint zero, linked like any other; null ids never
become a component's id unless all its ids are null; repeated rows are copies; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bands
from .common import SEED, Scratch, as_bytes, batches_of, chain, mix, quiet, small_batches, words_of


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles; zero for no words."""
    words = words_of(text)
    if not words:
        return 0
    n, hashed, join = min(shingle, len(words)), xxhash.xxh64_intdigest, b" ".join
    counts, total = np.zeros(64, np.int64), len(words) - n + 1
    for at in range(0, total, 1 << 16):
        part = words[at : min(at + (1 << 16), total) + n - 1]
        h = np.fromiter((hashed(join(x), SEED) for x in zip(*(part[k:] for k in range(n)))), np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(counts * 2 > total, bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(documents: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fingerprint fp (as a signed long) and the columns to keep of each document."""
    small_batches(documents.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            fps = np.array([fingerprint(t, shingle) for t in as_bytes(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps), *b.columns[2:]], names=["doc_id", "fp", *keep])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *keep)
    return rows.mapInArrow(run, ", ".join(["doc_id long, fp long", *(f"`{c}` {kinds[c]}" for c in keep)]))


def bit_counts(fps: np.ndarray, width: int) -> np.ndarray:
    """Bit counts of the segments of `width` bits of each fingerprint."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(len(fps), 64 // width, width).sum(2, dtype=np.uint8)


def cells(fps: DataFrame, radius: int, groups: int, width: int) -> DataFrame:
    """Keys of the grid cells of each fingerprint: a key for each choice of groups - radius groups of segments, the choice's number in the lowest byte."""
    if groups <= radius:
        raise ValueError("more groups than the radius are needed")
    parts = np.array_split(np.arange(64 // width), groups)
    chosen = list(itertools.combinations(range(groups), groups - radius))
    if len(chosen) > 256:
        raise ValueError("a key has room for 256 choices")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            for at in range(0, b.num_rows, 8192):
                own = b.column(0).to_numpy(zero_copy_only=False)[at : at + 8192].view(np.uint64)
                counts = bit_counts(own, width).astype(np.uint64)
                with quiet():
                    by_group = []
                    for p in parts:
                        h = np.zeros(len(own), np.uint64)
                        for k in p:
                            h = h * np.uint64(width + 1) + counts[:, k]
                        by_group.append(mix(h))
                    keys = []
                    for n, c in enumerate(chosen):
                        h = np.full(len(own), n, np.uint64)
                        for g in c:
                            h = chain(h, by_group[g])
                        keys.append(h << np.uint64(8) | np.uint64(n))  # the choice can be read from the key
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(own, len(keys)).view(np.int64))], names=["key", "fp"])

    return fps.mapInArrow(run, "key long, fp long")


def forest(fps: np.ndarray, radius: int, width: int) -> list[tuple[int, int]]:
    """Links among a cell's distinct fingerprints that connect all that are linked there; about as many as fingerprints.

    A pivot is linked to all within the radius of it. What else these can be linked to lies within twice the radius of
    the pivot, and is compared with them; then they are done with. Near copies of one text go in a few pivots.
    """
    counts, out = bit_counts(fps, width).astype(np.int16), []
    left = np.arange(len(fps))

    def near(one: int, many: np.ndarray, reach: int) -> np.ndarray:
        """Those of many within reach: the Manhattan bound, then the exact distance."""
        many = many[np.abs(counts[many] - counts[one]).sum(1) <= reach]
        return many[np.bitwise_count(fps[many] ^ fps[one]) <= reach]

    while len(left) > 1:
        pivot, left = int(left[0]), left[1:]
        around = near(pivot, left, 2 * radius)
        star = around[np.bitwise_count(fps[around] ^ fps[pivot]) <= radius]
        out.extend((pivot, int(x)) for x in star)
        outside = np.setdiff1d(around, star, assume_unique=True)
        for x in outside.tolist():
            linked = near(x, star, radius)
            if len(linked):
                out.append((x, int(linked[0])))
        left = np.setdiff1d(left, star, assume_unique=True)
    return out


def cell_links(keyed: DataFrame, radius: int, groups: int, width: int, cell_rows: int) -> DataFrame:
    """Links a, b found in cells; fingerprints of cells that are too large come as a alone, once a task.

    Two fingerprints that agree in more groups than a choice has meet in several cells. A cell leaves out a link that the
    cell of an earlier choice has too: that one connects the two as well, as a forest connects all that are linked in it.
    """
    parts = np.array_split(np.arange(64 // width), groups)
    chosen = list(itertools.combinations(range(groups), groups - radius))

    def first_seen(fps: np.ndarray, found: list[tuple[int, int]], choice: int) -> list[tuple[int, int]]:
        if not found:
            return []
        a, b = fps[[x for x, _ in found]], fps[[y for _, y in found]]
        same = bit_counts(a, width) == bit_counts(b, width)
        agree = np.stack([same[:, p].all(1) for p in parts], 1)
        earliest = np.cumsum(agree, 1) <= groups - radius
        wanted = np.isin(np.arange(groups), chosen[choice])
        keep = ((agree & earliest) == wanted).all(1)
        return list(zip(a[keep].view(np.int64).tolist(), b[keep].view(np.int64).tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        large: set[int] = set()
        links: list[tuple[int, int | None]] = []
        held_key, held, size, over = None, [], 0, False

        def close() -> None:
            if not over and size > 1:
                fps = np.unique(np.concatenate(held))
                links.extend(first_seen(fps, forest(fps, radius, width), int(held_key) & 255))

        def out() -> pa.RecordBatch:
            a, b = zip(*links)
            links.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches_of(batches):
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            ends = np.concatenate((np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
            at = 0
            for end in ends.tolist():
                if end - at == 1 and at and end < len(keys):  # a cell of one
                    at = end
                    continue
                if keys[at] != held_key:
                    close()
                    held_key, held, size, over = keys[at], [], 0, False
                part = fps[at:end]
                size += len(part)
                if size > cell_rows and radius == 2:
                    over = True
                if over:
                    for x in [*held, part]:
                        new = set(x.view(np.int64).tolist()) - large
                        if len(large) < 1_000_000:
                            large |= new
                        links.extend((v, None) for v in new)
                    held = []
                else:
                    held.append(part)
                at = end
            if len(links) > 50_000:
                yield out()
        close()
        if links:
            yield out()

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def halfway(fps: DataFrame) -> DataFrame:
    """Links among fingerprints at radius 2: two are linked if and only if both are within one bit of some point, so a star of those at each point is enough."""
    flips = np.array([0, *(1 << b for b in range(64))], np.uint64)

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            own = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            step = max(1, 500_000 // len(flips))
            for at in range(0, len(own), step):
                part = own[at : at + step]
                yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ flips[None, :]).ravel().view(np.int64)), pa.array(np.repeat(part, len(flips)).view(np.int64))], names=["point", "fp"])

    own = fps.mapInArrow(points, "point long, fp long").groupBy("point").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    return own.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a < b").distinct()


#: Parts that a key's rows are dealt to where a small table is joined to them.
SALTS = 16


def row_hashes(rows: DataFrame) -> Column:
    """128 bits of a row's columns, as its identity."""
    parts = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() or f.dataType.simpleString() == "variant" else F.col(f"`{f.name}`") for f in rows.schema.fields]
    # A null counts: xxhash64 alone passes over it.
    empty = F.concat_ws("", *(F.when(p.isNull(), F.lit("0")).otherwise(F.lit("1")) for p in parts))
    return F.struct(F.xxhash64(F.lit("row"), empty, *parts).alias("a"), F.xxhash64(F.lit("identity"), *reversed(parts), empty).alias("b"))


def contracted(links: DataFrame, most: int = 500_000) -> DataFrame:
    """Links a > b that connect what the links of a task connect: each node to the smallest that it reaches there. A task holds at most about `most` nodes and gives out what it holds in between."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            root = x
            while (y := up.setdefault(root, root)) != root:
                root = y
            while up[x] != root:
                up[x], x = root, up[x]
            return root

        def out() -> pa.RecordBatch:
            pairs = [(x, top(x)) for x in list(up)]
            a, b = zip(*[(x, y) for x, y in pairs if x != y] or [((), ())])
            up.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches_of(batches):
            for x, y in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = top(x), top(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) > most:
                yield out()
        if up:
            yield out()

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def state_of(links: DataFrame) -> tuple:
    """A digest of a table of links."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(scratch: Scratch, links: DataFrame, name: str = "stars") -> DataFrame:
    """node, root: the smallest node that each linked node reaches. Each task contracts its own links first; what is left goes through alternating large and small stars."""
    edges, k = scratch.table(contracted(links).distinct(), f"{name}0"), 0
    done = state_of(edges)
    while True:
        # Large star: a node's larger neighbours go to the smallest of its neighbourhood.
        both = edges.union(edges.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.toDF("a", "b")).filter("a <> b").distinct()
        new = scratch.table(small, f"{name}{k + 1}")
        state = state_of(new)
        scratch.drop(f"{name}{k}")
        if state == done or not state[0]:
            return new.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges, done, k = new, state, k + 1


def near_duplicates(documents: DataFrame, *, shingle: int = 3, radius: int = 2, groups: int = 4, width: int = 2, cell_rows: int = 1024, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (signed long), component_id (the smallest doc_id that links of at most `radius` differing bits reach), group (the component's own key) and the columns to keep."""
    scratch = Scratch(documents.sparkSession, "simhash")
    docs = scratch.table(fingerprints(documents, shingle, keep), "fps")
    nodes = scratch.table(docs.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    found = scratch.table(cell_links(cells(nodes.select("fp"), radius, groups, width), radius, groups, width, cell_rows), "links")
    links = found.filter("b is not null")
    large = found.filter("b is null").select(F.col("a").alias("fp")).distinct()
    if not large.isEmpty():
        links = links.union(halfway(large))
    roots = components(scratch, links)
    # Linked fingerprints only; a root's own row is added. A root that a third of all rows share is dealt to salts.
    linked = roots.union(roots.select("root", "root")).distinct().join(nodes.withColumnRenamed("fp", "node"), "node")
    ids = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    salts = F.explode(F.array(*(F.lit(k).cast("long") for k in range(SALTS))))
    shared = linked.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))).join(ids.withColumn("salt", salts), ["root", "salt"]).select(F.col("node").alias("fp"), "root", "component_id")
    # Copies of a fingerprint without links; those that stand alone need no join. AQE splits a fingerprint that many documents share.
    copies = nodes.filter("n > 1").join(shared.select("fp"), "fp", "left_anti").select("fp", F.col("fp").alias("root"), F.col("first").alias("component_id"))
    shared = shared.union(copies)
    shared = scratch.table(shared, "shared")
    return docs.join(shared, "fp", "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("root", "fp").alias("group"), *keep)


def near_pairs(keyed: DataFrame, radius: int, width: int, cell_rows: int, small: int = 32) -> DataFrame:
    """Candidate links a, b between nodes of a cell (key, node, words of a fingerprint): the Manhattan bound of the bit counts,
    then the exact distance. All nodes of a cell of cell_rows or more are linked to its first, for the exact check to decide.

    Cells of at most `small` rows are compared many at once, a row with the next one, the one after that, and so on.
    """

    def near(x: np.ndarray, y: np.ndarray, fps: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Which rows x are near to the rows y of the same places, or to one row y."""
        out = np.abs(counts[x] - counts[y]).sum(-1, dtype=np.int16) <= radius
        out[out] = np.bitwise_count(fps[x[out]] ^ (fps[y[out]] if np.ndim(y) else fps[y])).sum(1) <= radius
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, going_on = [], 0, None  # going_on: key and first node of a cell of which a piece was compared

        def links(keys: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Links of whole cells; the first and last may be pieces of one."""
            nonlocal going_on
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            sizes = np.diff(np.concatenate((starts, [len(keys)])))
            if going_on and keys[0] == going_on[0]:
                yield np.full(sizes[0], going_on[1], np.int64), nodes[: sizes[0]]
                starts, sizes = starts[1:], sizes[1:]
            large = (sizes > small) | (sizes >= cell_rows)
            wanted = np.repeat((sizes > 1) & ~large, sizes)
            at = np.flatnonzero(np.concatenate((np.zeros(len(keys) - len(wanted), bool), wanted)))
            own = fps[at]
            counts = bit_counts(own.reshape(-1), width).reshape(len(own), 64 * own.shape[1] // width).astype(np.int8)
            for step in range(1, small):
                x = np.flatnonzero(keys[at[step:]] == keys[at[:-step]])
                if not len(x):
                    break
                for part in np.array_split(x, -(-len(x) // 20_000)):
                    part = part[near(part, part + step, own, counts)]
                    yield nodes[at[part]], nodes[at[part + step]]
            for start, n in zip(starts[large].tolist(), sizes[large].tolist()):
                if n >= cell_rows:
                    yield np.full(n - 1, nodes[start], np.int64), nodes[start + 1 : start + n]
                    continue
                own = fps[start : start + n]
                counts = bit_counts(own.reshape(-1), width).reshape(len(own), 64 * own.shape[1] // width).astype(np.int8)
                found = bands.reached(n, lambda one, many: many[near(many, one, own, counts)])
                if found:
                    x, y = np.array(found).T
                    yield nodes[start + x], nodes[start + y]

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size, going_on
            keys, nodes, *words = (np.concatenate(x) for x in zip(*held))
            fps = np.stack(words, 1).view(np.uint64)
            # The last cell may go on in the next batch.
            cut = len(keys) if last else int(np.searchsorted(keys, keys[-1]))
            whole = len(keys) - cut >= cell_rows
            end = len(keys) if whole else cut
            if end:
                found = list(links(keys[:end], nodes[:end], fps[:end]))
                if whole and not (going_on and going_on[0] == keys[-1]):
                    going_on = (keys[-1], int(nodes[cut]))
                if found:
                    x, y = (np.concatenate([f[k] for f in found]) for k in range(2))
                    for at in range(0, len(x), 50_000):
                        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 50_000]), pa.array(y[at : at + 50_000])], names=["a", "b"])
            held = [(keys[end:], nodes[end:], *(w[end:] for w in words))] if end < len(keys) else []
            size = 0

        for batch in batches_of(batches):
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            size += batch.num_rows
            if size >= 50_000:
                yield from flush(False)
        if held:
            yield from flush(True)

    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def one_of_each(documents: DataFrame, *, shingle: int = 5, least: float = 0.8, radius: int = 64, width: int = 2, cell_rows: int = 100_000, chunk: int = 20_000) -> DataFrame:
    """One document of each group of near duplicates, with its columns: texts whose sets of five-word shingles have a
    Jaccard similarity of `least` or more are linked. The document with the smallest doc_id stays (null last), of equal
    ids the one with the smallest hash of its row; rows that are equal in every column are one document.

    Cells are groups of segments of a wide fingerprint of the set (see bands.py); in a cell the bit counts of its first 192
    bits bound the distance, then these bits decide at `radius`, and of the candidates left the shingle sets decide.
    """
    scratch = Scratch(documents.sparkSession, "simhash")
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("_own"), row_hashes(documents).alias("_row"), "doc_id", F.col("text").cast("string").alias("text")).select("*", "_row.a", "_row.b")
    place = F.struct(F.col("doc_id").isNull().alias("empty"), F.col("doc_id").cast("long").alias("id"), F.col("_row").alias("row"))
    found = scratch.table(bands.sketches(rows.select("text", place.alias("place")), shingle, ("place",)), "sketches")
    # Equal sets are one node.
    nodes = scratch.table(found.groupBy("node").agg(F.min("place").alias("first"), F.first("prints").alias("prints"), F.first("size").alias("size")), "nodes")
    # A set of n shingles has a similarity of n / (n + 1) at most to another one.
    links = scratch.table(near_pairs(bands.keyed(nodes.filter(F.col("size") * (1 - least) >= least - 1e-6)), radius, width, cell_rows), "links")
    alike = components(scratch, links, "candidates")
    # A component's smallest node is its root and has no row of its own.
    alike = scratch.table(alike.union(alike.select("root", "root")).distinct().join(nodes.select("node", "first.row"), "node"), "alike")
    # Roots of more than a chunk of nodes: one for each `chunk` nodes at most.
    large = alike.groupBy("root").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")).filter("chunks > 1")
    own = F.pmod(F.xxhash64("node"), F.coalesce("chunks", F.lit(1))).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1), lambda c: F.xxhash64("root", F.least(c, F.col("own")), F.greatest(c, F.col("own"))))
    # Texts are joined by sorting at every size: what is joined to them grows with the input.
    blocks = scratch.table(alike.join(F.broadcast(large), "root", "left").withColumn("own", own).select("row.a", "row.b", "node", pairs.alias("blocks")), "blocks")
    texts = rows.select("a", "b", "text").join(blocks.hint("merge"), ["a", "b"]).select(F.explode("blocks").alias("block"), "node", "text")
    sure = components(scratch, scratch.table(bands.checked_links(texts, shingle, least), "checked"), "sure")
    sure = sure.union(sure.select("root", "root")).distinct().join(nodes.select("node", "first"), "node")
    kept = sure.groupBy("root").agg(F.min("first").alias("kept"))
    salt = F.pmod(F.xxhash64("node"), F.lit(SALTS))
    salts = F.explode(F.array(*(F.lit(k).cast("long") for k in range(SALTS))))
    dropped = sure.withColumn("salt", salt).join(kept.withColumn("salt", salts), ["root", "salt"]).filter("first <> kept").select("first.row.a", "first.row.b")
    # Further documents of a node go too.
    copies = found.select("node", F.col("place.row").alias("_row")).join(nodes.select("node", "first.row"), "node").filter("_row <> row").select("_row.a", "_row.b")
    gone = scratch.table(dropped.union(copies).distinct(), "gone")
    for name in ("sketches", "nodes", "links", "alike", "blocks", "checked"):
        scratch.drop(name)
    # Rows that are equal in every column meet in the join's order, so their first is taken without another shuffle.
    left = rows.select("a", "b", "_own").join(gone.hint("merge"), ["a", "b"], "left_anti")
    once = left.withColumn("_nth", F.row_number().over(Window.partitionBy("a", "b").orderBy("a", "b"))).filter("_nth = 1")
    return once.select(*(F.col("_own").getField(c).alias(c) for c in documents.columns))
