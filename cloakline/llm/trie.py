"""Conversation prefix trie: the Cartesian tree over the LCP array of the sorted conversations, all nearest smaller values found in blocks.

Each turn is the MD5 of its role and text; a conversation's key is the row of them up to the first that no other conversation has at that
place, since nothing behind it is shared (those turns become single nodes at once, where they lie). Keys are sorted by ranges, ties
by conv_id, so a block of the sorted list is a partition, and a group of equal conversations spans as many as it needs. Within a
block, the nearest smaller values on both sides of each LCP value give the interval of a node; equal values of one interval are one
node, depths between a node and its parent are added, and counts are sums over intervals. A node whose interval reaches a block's edge
at a depth that the neighbour shares is open: the block says what it holds of it. Open parts are put together over the blocks by
the LCPs at their edges and the blocks' least LCPs (a node goes through a block whose least value isn't below its depth); these are as many
as blocks times shared depths at the edges, numbers only, and meet on the driver. The conv_ids that end at an open node are hashed in a stream.

Nulls: a null role or text is empty, a null turn comes first; rows without a conv_id belong to no conversation and take no part. Ties and
repeated rows: see turns.py. An empty table gives no nodes. Extra columns are ignored. A key's length is bounded by the turns that some
other conversation has at the same places, not by the conversation's."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .turns import conversation_rows, numbered, parts_of

WIDTH = 16  # bytes of a turn in a key
NOTHING = hashlib.sha256(b"").hexdigest()
BLOCK_BYTES = 32_000_000

NODE = [("open", pa.bool_()), ("block", pa.int32()), ("side", pa.string()), ("through", pa.bool_()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_side", pa.string()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("ends", pa.string()), ("chars", pa.int64())]
NODE_SQL = "open boolean, block int, side string, through boolean, conv_id long, depth long, parent_conv_id long, parent_side string, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, chars long"
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def lcp(a: bytes, b: bytes) -> int:
    """Turns that two keys begin with in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    low, high = 0, n // WIDTH  # the first `low` are equal, not the first `high`
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[: middle * WIDTH] == b[: middle * WIDTH] else (low, middle)
    return low


def nearest_smaller(values: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each value the place of the nearest smaller one before it (-1: none) and behind it (len: none)."""
    n = len(values)
    before, behind, stack = np.full(n, -1, np.int64), np.full(n, n, np.int64), []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            behind[stack.pop()] = i
        # Equal ones stay on the stack; the smaller one is below them.
        before[i] = stack[-1] if stack and values[stack[-1]] < v else before[stack[-1]] if stack else -1
        stack.append(i)
    return before, behind


def solve_block(convs: np.ndarray, keys: list[bytes], chars: list, totals: np.ndarray, left: int, right: int) -> tuple[dict, dict]:
    """Closed nodes and open parts of one block. convs, keys, chars, totals: of its conversations in order; left, right: turns that the first
    and last have in common with the block before and behind (0 at the ends of the list: the root is open everywhere)."""
    n = len(keys)
    sizes = np.array([len(k) // WIDTH for k in keys], np.int64)
    values = [left, *(lcp(a, b) for a, b in zip(keys, keys[1:])), right]
    before, behind = nearest_smaller(values)
    v = np.array(values, np.int64)
    ends_here = totals == sizes

    # Intervals of rows [l, r]: inner LCP values with a smaller one on both sides, and conversations that go on alone.
    inner = np.flatnonzero((before >= 0) & (behind <= n))
    inner = inner[(inner > 0) & (inner < n)]
    spans, which = np.unique(np.stack((before[inner], behind[inner]), 1), axis=0, return_inverse=True) if len(inner) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))
    deep = np.zeros(len(spans), np.int64)
    deep[which.ravel()] = v[inner]
    closed_at = np.full(n + 1, -1, np.int64)  # the closed node that an LCP value stands for
    closed_at[inner] = which.ravel()
    alone = np.flatnonzero(sizes > np.maximum(v[:-1], v[1:]))
    l, r = np.concatenate((spans[:, 0], alone)), np.concatenate((spans[:, 1] - 1, alone))
    deep = np.concatenate((deep, sizes[alone]))
    above = np.maximum(v[l], v[r + 1])  # the parent's depth
    parent_at = np.where(v[l] >= v[r + 1], l, r + 1)  # an LCP value that stands for the parent
    least = np.minimum.reduceat(np.append(convs, np.iinfo(np.int64).max), np.stack((l, r + 1), 1).ravel())[::2] if len(l) else l

    # One node for each depth from the parent's to the interval's own.
    steps = deep - above
    node = np.repeat(np.arange(len(l)), steps)
    depth = above[node] + 1 + (np.arange(len(node)) - np.repeat(np.cumsum(steps) - steps, steps))
    last_at = np.cumsum(steps) - 1  # the deepest one of each interval
    counts = r - l + 1
    length = np.fromiter((chars[a][d - 1] for a, d in zip(l[node].tolist(), depth.tolist())), np.int64, len(node))
    order = np.lexsort((depth, l[node]))
    sums = np.concatenate(([0], np.cumsum(((counts[node] - 1) * length)[order])))
    place = np.empty(len(node), np.int64)
    place[order] = np.arange(len(node))
    saved = sums[np.searchsorted(l[node][order], r[node], side="right")] - sums[place]
    same = np.zeros(n, bool)  # the same conversation as the one before
    same[1:] = (v[1:-1] == sizes[1:]) & (sizes[1:] == sizes[:-1])
    first = np.flatnonzero(~same)
    stop = np.append(first[1:], n)
    leaf = np.zeros(n + 1, np.int64)
    leaf[first + 1] = v[stop] < sizes[first]
    leaf = np.cumsum(leaf)
    leaves = (leaf[r + 1] - leaf[l])[node]
    children = np.ones(len(node), np.int64)
    children[last_at] = 0
    tails = np.flatnonzero(~ends_here)
    top = np.cumsum(steps) - steps
    parent = np.full(len(l), -1, np.int64)
    parent = closed_at[parent_at]
    np.add.at(children, last_at[parent[parent >= 0]], 1)
    owner = dict(zip(zip(l.tolist(), r.tolist()), last_at.tolist()))
    for i in tails.tolist():
        children[owner[i, i]] += 1

    # Conversations that end at a node stand at the head of its interval.
    ends = [NOTHING] * len(node)
    runs = {}
    for a, b in zip(first.tolist(), stop.tolist()):
        if ends_here[a]:
            runs[a] = (b, int(sizes[a]))
    for k, at in enumerate(last_at.tolist()):
        b, d = runs.get(int(l[k]), (0, -1))
        if d == deep[k]:
            ends[at] = hashlib.sha256(",".join(map(str, convs[l[k] : b].tolist())).encode()).hexdigest()

    parent_conv = np.repeat(least, steps)
    parent_conv[top] = np.where(parent >= 0, least[parent], 0)
    through = min(values)
    opens_left = before[parent_at] < 0  # else the parent, if open, is so to the right only
    side = np.where(parent >= 0, "", np.where(opens_left, "L", "R"))
    sides = np.full(len(node), "", object)
    sides[top] = side
    closed = {"conv_id": least[node], "depth": depth, "parent_conv_id": parent_conv, "parent_side": sides, "n_convs": counts[node], "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends": ends}

    # Open parts, with what closed nodes add to them.
    parts: dict = {}
    for d in range(left + 1):
        shorter = np.flatnonzero(v[1:n] < d)
        parts["L", d] = (0, int(shorter[0]) if len(shorter) else n - 1, d <= through)
    for d in range(right + 1):
        if d > through:
            shorter = np.flatnonzero(v[1:n] < d)
            parts["R", d] = (int(shorter[-1]) + 1 if len(shorter) else 0, n - 1, False)
    added = {p: [0, 0, 0] for p in parts}
    for k in np.flatnonzero(parent < 0).tolist():
        entry = added[str(side[k]), int(above[k])]
        entry[0] += 1
        entry[1] += int(leaves[top[k]])
        entry[2] += int(saved[top[k]])
    opened = []
    for (s, d), (a, b, goes_on) in parts.items():
        run, size = runs.get(a, (0, -1))
        piece = ",".join(map(str, convs[a : min(run, b + 1)].tolist())) if size == d else None
        opened.append({"side": s, "depth": d, "through": goes_on, "conv_id": int(convs[a : b + 1].min()), "n_convs": b - a + 1, "n_children": added[s, d][0], "n_leaves": added[s, d][1], "saved_tokens": added[s, d][2], "ends": piece, "chars": chars[a][d - 1] if d else 0})
    return closed, opened


def _solver(edges: dict[int, tuple[int, int]]):
    schema = pa.schema(NODE)

    def run(key, table):
        block = key[0].as_py()
        table = table.sort_by([("key", "ascending"), ("conv_id", "ascending")])
        convs = table.column("conv_id").to_numpy().astype(np.int64)
        closed, opened = solve_block(convs, table.column("key").to_pylist(), table.column("chars").to_pylist(), table.column("total").to_numpy().astype(np.int64), *edges[block])
        n = len(closed["depth"])
        columns = {"open": [False] * n, "block": [block] * n, "side": [None] * n, "through": [None] * n, "chars": [0] * n} | {k: list(x) if isinstance(x, np.ndarray) and x.dtype == object else x for k, x in closed.items()}
        nodes = pa.table([pa.array(columns[name], kind) for name, kind in NODE], schema=schema)
        return pa.concat_tables([nodes, pa.Table.from_pylist([{"open": True, "block": block} | p for p in opened], schema)])

    return run


def put_together(parts: list) -> tuple[list[tuple], list[tuple]]:
    """Open nodes from their parts, in the order of blocks: (part's block, side, depth, node's number), and the nodes' columns with their number."""
    groups, of, reach = [], {}, {}
    for p in sorted(parts, key=lambda p: (p.block, p.side, p.depth)):
        # reach: the open node at each depth at the right edge of the block before, or of this one.
        if p.side == "L" and p.depth in reach:
            g = reach[p.depth]
        else:
            g = len(groups)
            groups.append({"depth": p.depth, "conv_id": p.conv_id, "n_convs": 0, "n_children": 0, "n_leaves": 0, "saved": 0, "chars": p.chars, "up": None if not p.depth else of.get((p.block, p.side, p.depth - 1), of.get((p.block, "L", p.depth - 1)))})
        of[p.block, p.side, p.depth] = g
        if p.side == "L" and not p.through:
            reach.pop(p.depth, None)
        else:
            reach[p.depth] = g
        at = groups[g]
        at["conv_id"] = min(at["conv_id"], p.conv_id)
        for to, name in (("n_convs", "n_convs"), ("n_children", "n_children"), ("n_leaves", "n_leaves"), ("saved", "saved_tokens")):
            at[to] += p[name]
    for at in sorted(groups, key=lambda at: -at["depth"]):
        at["n_leaves"] = at["n_leaves"] if at["n_children"] else 1
        at["saved"] += (at["n_convs"] - 1) * at["chars"]
        if at["up"] is not None:
            up = groups[at["up"]]
            up["n_children"] += 1
            up["n_leaves"] += at["n_leaves"]
            up["saved"] += at["saved"]
    nodes = [(g, at["conv_id"], at["depth"], None if at["up"] is None else groups[at["up"]]["conv_id"], at["n_convs"], at["n_children"], at["n_leaves"], at["saved"]) for g, at in enumerate(groups)]
    return [(*k, g) for k, g in of.items()], nodes


def _hashes():
    schema = pa.schema([("node", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches):
        """Pieces come by node and block; one is held at a time."""
        held, state = None, None
        for batch in batches:
            for node, piece in zip(*(batch.column(c).to_pylist() for c in ("node", "ends"))):
                if node != held:
                    if state:
                        yield pa.RecordBatch.from_pylist([{"node": held, "ends_sha256": state.hexdigest()}], schema)
                    held, state, comma = node, hashlib.sha256(), ""
                state.update(f"{comma}{piece}".encode())
                comma = ","
        if state:
            yield pa.RecordBatch.from_pylist([{"node": held, "ends_sha256": state.hexdigest()}], schema)

    return run


def rebuilt_turns(rows: DataFrame, scratch: Scratch, parts: int | None = None, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conv_id, total) and (conv_id, depth, sym, chars) of conversations that begin with the first h turns of conversation c - c % every and go on with
    their own behind their first h; h is crc32 of the decimal conv_id modulo `most`."""
    rows = conversation_rows(rows.filter(F.col("conv_id").isNotNull()), "")
    turn = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    placed = scratch.table(numbered(rows.withColumns({"sym": turn, "chars": F.length("text")}), scratch, parts or parts_of(rows), ("sym", "chars")), "numbered")
    sizes = placed.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = sizes.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most, "base": F.col("conv_id") - F.col("conv_id") % every})
    bases = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = scratch.table(convs.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "convs")
    own = placed.join(convs, "conv_id").filter("pos > h").select("conv_id", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "sym", "chars")
    heads = placed.filter(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "sym", "chars")
    heads = heads.join(convs, "base").filter("pos <= h").select("conv_id", F.col("pos").alias("depth"), "sym", "chars")
    return convs.select("conv_id", "total"), scratch.table(own.unionByName(heads), "turns")


def trie(spark: SparkSession, convs: DataFrame, turns: DataFrame, scratch: Scratch, blocks: int | None = None) -> DataFrame:
    """One row a node. convs: conv_id, total (turns). turns: conv_id, depth (from 1), sym (32 hex digits, equal for equal turns), chars."""
    # As tables of their own, so that both sides of a join are shuffled for it and Spark can split a turn, or a conversation, that many rows have.
    shared = scratch.table(turns.groupBy("depth", "sym").agg(F.count("*").alias("met")).filter("met > 1"), "shared")
    alone = scratch.table(turns.join(shared, ["depth", "sym"], "left").filter("met IS NULL").groupBy("conv_id").agg(F.min("depth").alias("stop")), "alone")
    marked = scratch.table(turns.join(alone, "conv_id", "left"), "marked")
    kept = marked.filter("stop IS NULL OR depth <= stop").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "sym", "chars"))).alias("path"))
    items = convs.join(kept, "conv_id", "left").select("conv_id", "total", F.unhex(F.array_join(F.coalesce("path.sym", F.array().cast("array<string>")), "")).alias("key"), F.coalesce(F.col("path.chars"), F.array().cast("array<int>")).alias("chars"))
    items = scratch.table(items, "items")
    blocks = blocks or max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(items.agg(F.sum(F.length("key") + 64)).first()[0] or 0) // BLOCK_BYTES + 1)
    ordered = scratch.table(items.repartitionByRange(blocks, "key", "conv_id").withColumn("block", F.spark_partition_id()), "ordered")

    met = sorted(ordered.groupBy("block").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect(), key=lambda r: r.block)
    between = [0, *(lcp(bytes(a["last"]), bytes(b["first"])) for a, b in zip(met, met[1:])), 0]
    edges = {r.block: (between[k], between[k + 1]) for k, r in enumerate(met)}
    solved = scratch.table(ordered.groupBy("block").applyInArrow(_solver(edges), NODE_SQL), "solved")
    opened = solved.filter("open")
    of, nodes = put_together(opened.drop("ends").collect())
    of = spark.createDataFrame(of, "block int, side string, depth long, node long")
    crossing = spark.createDataFrame(nodes, "node long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")
    pieces = opened.filter("ends IS NOT NULL").join(F.broadcast(of), ["block", "side", "depth"]).select("node", "block", "ends")
    hashes = pieces.repartition("node").sortWithinPartitions("node", "block").mapInArrow(_hashes(), "node long, ends_sha256 string")
    crossing = crossing.join(hashes, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))).select(*RESULT)

    ups = of.join(spark.createDataFrame([n[:2] for n in nodes], "node long, up long"), "node").select("block", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), "up")
    closed = solved.filter("NOT open").join(F.broadcast(ups), ["block", "parent_side", "depth"], "left")
    closed = closed.withColumns({"parent_conv_id": F.when(F.col("parent_side") == "", F.col("parent_conv_id")).otherwise(F.col("up")), "ends_sha256": F.col("ends")}).select(*RESULT)

    end = F.col("depth") == F.col("total")
    tails = marked.filter("depth > stop").join(convs, "conv_id").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(end, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(end, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(NOTHING).alias("ends_sha256"))
    return crossing.unionByName(closed).unionByName(tails)


def conversation_trie(rows: DataFrame, parts: int | None = None, blocks: int | None = None) -> DataFrame:
    """The trie of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    scratch = Scratch(rows.sparkSession, "trie")
    convs, turns = rebuilt_turns(rows, scratch, parts)
    return trie(rows.sparkSession, convs, turns, scratch, blocks)
