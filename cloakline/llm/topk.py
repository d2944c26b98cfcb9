"""Exact top-k search by integer inner product: a KD-tree for each shard, best-first traversal, the k-th score handed on.

Vectors are dealt to shards by a coarse tree of median splits, fitted on a bounded sample (SAMPLE_ROWS rows, by hash of vec_id); every row
goes down it, and leaves with more than `shard_rows` rows (copies of one vector, say) are cut by hash of vec_id. Each shard gets a
KD-tree: median splits of the widest component, ties by vec_id, and for each node the tight box of its rows and their smallest vec_id.
A node's bound is the largest inner product that its box allows. A query first searches the shard that it lies in; its k-th score
there, with that row's vec_id, goes with it to the other shards, and only to those whose box can beat it. In a shard, nodes are met
best bound first until the bound (at equal bounds the smallest vec_id) can't beat the k-th. Queries and boxes meet in blocks by key; no
list of shards, queries or results is on the driver or broadcast.

A vector that is null or has a null or non-finite component takes no part, nor does a row without a vec_id. Vectors are compared with those of
their own length (empty ones score 0). Ties go to the smaller vec_id. Rows that share a vec_id are candidates each, but never for that
vec_id; as queries they share one list. Components and scores beyond a long stay at its ends. Extra columns are ignored."""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SAMPLE_ROWS = 8192  # rows that the coarse tree is fitted on
DEPTH = 12  # levels of the coarse tree at most; leaves are cut by hash beyond that
SHARD_ROWS = 16_384
LEAF_ROWS = 128
QUERY_ROWS = 512  # queries that meet a tree, or a block of boxes, at a time
BOXES = 1024  # boxes in a block
LONG = 2**63 - 1

SHARD = ["d", "leaf", "sub"]


def quantised(column: str, scale: int) -> Column:
    return F.transform(column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(column: str) -> Column:
    return F.col(column).isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    """A column of lists of d longs as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(len(column), d)


def exact(*arrays: np.ndarray):
    """The fastest number type in which inner products of these rows are exact."""
    most = max((int(a.shape[-1]) for a in arrays), default=0)
    for a in arrays:
        most *= max(abs(int(a.max())), abs(int(a.min()))) if a.size else 0
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else object


def fit_splits(sample: np.ndarray, depth: int) -> list[tuple[int, int]]:
    """Median splits as an implicit binary tree: (component, value), component -1 where a node isn't split."""
    splits = [(-1, 0)] * (2**depth - 1)
    held = {0: sample}
    for node in range(len(splits)):
        rows = held.pop(node, None)
        if rows is None or len(rows) < 2:
            continue
        c = int(np.argmax(rows.var(axis=0))) if rows.shape[1] else 0
        if not rows.shape[1] or rows[:, c].min() == rows[:, c].max():
            continue
        value = int(np.sort(rows[:, c])[(len(rows) - 1) // 2])
        if value == rows[:, c].max():
            value = int(rows[rows[:, c] < value, c].max())
        splits[node] = (c, value)
        left = rows[:, c] <= value
        held[2 * node + 1], held[2 * node + 2] = rows[left], rows[~left]
    return splits


def leaf_of(rows: np.ndarray, splits: list[tuple[int, int]]) -> np.ndarray:
    """The last node that each row meets."""
    at = np.zeros(len(rows), np.int64)
    if not splits:
        return at
    parts, values = (np.array(x) for x in zip(*splits))
    while True:
        inner = at < len(splits)
        inner[inner] = parts[at[inner]] >= 0
        if not inner.any():
            return at
        node = at[inner]
        at[inner] = 2 * node + 1 + (rows[np.flatnonzero(inner), parts[node]] > values[node])


class Tree:
    """A shard's KD-tree: rows in the order of its leaves, nodes with boxes. Children of node i are left[i] and right[i]; leaves have -1."""

    FIELDS = ("rows", "ids", "start", "stop", "left", "right", "low", "high", "least")

    def __init__(self, **fields):
        self.__dict__ |= fields

    @classmethod
    def build(cls, rows: np.ndarray, ids: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
        order, nodes, children = np.lexsort((ids,)), [], []
        todo = [(0, len(rows), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            here = rows[order[a:b]]
            low, high, n = here.min(axis=0), here.max(axis=0), len(nodes)
            nodes.append((a, b, low, high, ids[order[a:b]].min()))
            children.append([-1, -1])
            if parent >= 0:
                children[parent][side] = n
            if b - a > leaf_rows:
                c = int(np.argmax(high - low)) if rows.shape[1] else None
                key = here[:, c] if c is not None else np.zeros(b - a, np.int64)
                order[a:b] = order[a:b][np.lexsort((ids[order[a:b]], key))]
                middle = (a + b) // 2
                todo += [(a, middle, n, 0), (middle, b, n, 1)]
        start, stop, low, high, least = (np.array(x) for x in zip(*nodes))
        children = np.array(children)
        small = next(t for t in (np.int8, np.int16, np.int32, np.int64) if not rows.size or (rows.min() >= np.iinfo(t).min and rows.max() <= np.iinfo(t).max))
        return cls(rows=rows[order].astype(small), ids=ids[order], start=start, stop=stop, left=children[:, 0], right=children[:, 1], low=low.astype(small), high=high.astype(small), least=least)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f: getattr(self, f) for f in self.FIELDS})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Tree:
        with np.load(io.BytesIO(data)) as held:
            return cls(**{f: held[f] for f in cls.FIELDS})

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: list) -> list[list[tuple[int, int]]]:
        """For each query its k best (score, -vec_id) here of those that beat its floor (None: any), best first. own: ids that are left out."""
        kind = exact(queries, self.rows)
        rows, q = self.rows.astype(kind), queries.astype(kind)
        bounds = bounds_of(q, self.low.astype(kind), self.high.astype(kind))
        least, start, stop, left, right, ids = (getattr(self, f).tolist() for f in ("least", "start", "stop", "left", "right", "ids"))
        out = []
        for i in range(len(q)):
            bound, query, me = bounds[i].tolist(), q[i], int(own[i])
            best, last = [], floor[i]
            heap = [(-bound[0], least[0], 0)]
            while heap:
                negative, smallest, node = heapq.heappop(heap)
                if last is not None and (-negative, -smallest) <= last:
                    break
                if left[node] >= 0:
                    for child in (left[node], right[node]):
                        if last is None or (bound[child], -least[child]) > last:
                            heapq.heappush(heap, (-bound[child], least[child], child))
                    continue
                a = start[node]
                scores = clipped(rows[a : stop[node]] @ query)
                for j in range(len(scores)) if last is None else np.flatnonzero(scores >= last[0]).tolist():
                    found = (int(scores[j]), -ids[a + j])
                    if ids[a + j] == me or (last is not None and found <= last):
                        continue
                    if len(best) < k:
                        heapq.heappush(best, found)
                    else:
                        heapq.heapreplace(best, found)
                    if len(best) == k and (last is None or best[0] > last):
                        last = best[0]
            out.append(sorted(best, reverse=True))
        return out


def bounds_of(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product of each query with a point of each box."""
    zero = queries.dtype.type(0) if queries.dtype != object else 0
    return clipped(np.maximum(queries, zero) @ high.T + np.minimum(queries, zero) @ low.T)


def clipped(scores: np.ndarray) -> np.ndarray:
    """Scores beyond a long (met in unbounded integers only) become its ends."""
    return np.clip(scores, -LONG - 1, LONG) if scores.dtype == object else scores


def _router(splits: dict[int, list]):
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.int64())), ("d", pa.int32()), ("leaf", pa.int32())])

    def run(batches):
        for batch in batches:
            v = batch.column("v")
            sizes = np.asarray(pa.compute.list_value_length(v), np.int64)
            leaves = np.zeros(len(sizes), np.int32)
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                leaves[at] = leaf_of(matrix(v.take(pa.array(at)), d), splits.get(d, []))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), v.cast(pa.list_(pa.int64())), pa.array(sizes.astype(np.int32)), pa.array(leaves)], schema=schema)

    return run


def _build(key, table):
    d = key[0].as_py()
    tree = Tree.build(matrix(table.column("v"), d), table.column("vec_id").to_numpy().astype(np.int64))
    return pa.table({"d": pa.array([d], pa.int32()), "leaf": pa.array([key[1].as_py()], pa.int32()), "sub": pa.array([key[2].as_py()], pa.int64()), "low": pa.array([tree.low[0].tolist()], pa.list_(pa.int64())), "high": pa.array([tree.high[0].tolist()], pa.list_(pa.int64())), "tree": pa.array([tree.dump()], pa.binary())})


TREE = "d int, leaf int, sub long, low array<long>, high array<long>, tree binary"
FOUND = pa.schema([("query_id", pa.int64()), ("v", pa.list_(pa.int64())), ("d", pa.int32()), ("leaf", pa.int32()), ("sub", pa.int64()), ("ids", pa.list_(pa.int64())), ("scores", pa.list_(pa.int64())), ("last_score", pa.int64()), ("last_id", pa.int64())])
FOUND_SQL = "query_id long, v array<long>, d int, leaf int, sub long, ids array<long>, scores array<long>, last_score long, last_id long"


def _search(k: int):
    def run(key, trees, queries):
        """Queries of one shard and part beside the shard's tree."""
        if not queries.num_rows or not trees.num_rows:
            return FOUND.empty_table()
        q = matrix(queries.column("v"), key[0].as_py())
        own = queries.column("query_id").to_numpy()
        floor = [None if s is None else (s, -i) for s, i in zip(queries.column("last_score").to_pylist(), queries.column("last_id").to_pylist())]
        found = Tree.load(trees.column("tree")[0].as_py()).search(q, own, k, floor)
        lasts = [f[-1] if len(f) == k else None for f in found]
        columns = [queries.column("query_id"), queries.column("v"), *(pa.array([x.as_py()] * len(found), t) for x, t in zip(key[:3], (pa.int32(), pa.int32(), pa.int64()))), pa.array([[-i for _, i in f] for f in found], pa.list_(pa.int64())), pa.array([[s for s, _ in f] for f in found], pa.list_(pa.int64())), pa.array([x and x[0] for x in lasts], pa.int64()), pa.array([x and -x[1] for x in lasts], pa.int64())]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, FOUND)], schema=FOUND)

    return run


def _beaten(key, boxes, queries):
    """The pairs of a query and another shard whose box can beat the query's k-th."""
    d, out = key[0].as_py(), []
    if boxes.num_rows and queries.num_rows:
        q, low, high = matrix(queries.column("v"), d), matrix(boxes.column("low"), d), matrix(boxes.column("high"), d)
        kind = exact(q, np.concatenate((low, high)))
        bounds = bounds_of(q.astype(kind), low.astype(kind), high.astype(kind))
        last = np.array([-(2**70) if s is None else s for s in queries.column("last_score").to_pylist()], object if kind is object else np.float64)
        shards = list(zip(boxes.column("leaf").to_pylist(), boxes.column("sub").to_pylist()))
        homes = list(zip(queries.column("leaf").to_pylist(), queries.column("sub").to_pylist()))
        out = [(i, *shards[j]) for i, j in zip(*(x.tolist() for x in np.nonzero(bounds >= last[:, None]))) if shards[j] != homes[i]]
    at = pa.array([i for i, _, _ in out], pa.int64())
    taken = queries.select(["query_id", "v", "last_score", "last_id"]).take(at)
    return pa.table({"query_id": taken.column(0), "v": taken.column(1), "d": pa.array([d] * len(out), pa.int32()), "leaf": pa.array([x[1] for x in out], pa.int32()), "sub": pa.array([x[2] for x in out], pa.int64()), "last_score": taken.column(2), "last_id": taken.column(3)})


def dealt(queries: DataFrame, by: list[str]) -> DataFrame:
    """The queries with `part`: those of one key are dealt to parts of about QUERY_ROWS."""
    sizes = queries.groupBy(*by).agg(F.ceil(F.count("*") / QUERY_ROWS).alias("parts"))
    return queries.join(sizes, by).withColumn("part", F.pmod(F.xxhash64("query_id", "v"), "parts")).drop("parts")


def beside(keyed: DataFrame, queries: DataFrame, by: list[str]) -> DataFrame:
    """A copy of each keyed row for each part that has queries."""
    # New columns (x + 0 is x): both sides of a cogroup come from these queries, and may not share their names' origin.
    return keyed.join(queries.groupBy(*by, (F.col("part") + 0).alias("at_")).agg(F.count("*").alias("n_")).select(*by, F.col("at_").alias("part")), by)


def top_k(rows: DataFrame, is_query: Column, k: int = 20, scale: int = 64, shard_rows: int = SHARD_ROWS, vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best rows. is_query: a condition on vec_id."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "topk")
    rows = rows.filter(usable(vector) & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), quantised(vector, scale).alias("v"))
    n = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).collect()
    by_length: dict[int, list] = {}
    for r in sample:
        by_length.setdefault(len(r.v), []).append(r.v)
    depth = min(DEPTH, max(0, int(np.ceil(np.log2(max(1, n / shard_rows))))))
    splits = {d: fit_splits(np.array(v, np.int64).reshape(len(v), d).astype(np.float64), depth) for d, v in by_length.items()}
    routed = scratch.table(rows.mapInArrow(_router(splits), "vec_id long, v array<long>, d int, leaf int"), "routed")
    sizes = routed.groupBy("d", "leaf").agg(F.ceil(F.count("*") / shard_rows).alias("subs"))
    sharded = routed.join(sizes, ["d", "leaf"]).withColumn("sub", F.pmod(F.xxhash64("vec_id"), "subs")).drop("subs")
    trees = scratch.table(sharded.groupBy(*SHARD).applyInArrow(_build, TREE), "trees")

    home = SHARD
    queries = sharded.filter(is_query).select(F.col("vec_id").alias("query_id"), "v", *home, F.lit(None).cast("long").alias("last_score"), F.lit(None).cast("long").alias("last_id"))
    queries = scratch.table(dealt(queries, home), "queries")
    keys = [*home, "part"]
    first = scratch.table(beside(trees, queries, home).groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(_search(k), FOUND_SQL), "first")

    boxes = trees.select(*SHARD, "low", "high")
    blocks = boxes.groupBy("d").agg(F.ceil(F.count("*") / BOXES).alias("blocks"))
    boxes = boxes.join(blocks, "d").withColumn("block", F.pmod(F.xxhash64("leaf", "sub"), "blocks")).drop("blocks")
    asked = first.drop("ids", "scores").join(blocks, "d").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    asked = scratch.table(dealt(asked, ["d", "block"]), "asked")
    keys = ["d", "block", "part"]
    pairs = beside(boxes, asked, ["d", "block"]).groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(_beaten, "query_id long, v array<long>, d int, leaf int, sub long, last_score long, last_id long")
    pairs = scratch.table(dealt(scratch.table(pairs, "beaten"), SHARD), "pairs")
    keys = [*SHARD, "part"]
    second = beside(trees, pairs, SHARD).groupBy(*keys).cogroup(pairs.groupBy(*keys)).applyInArrow(_search(k), FOUND_SQL)

    hits = first.unionByName(second).select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("hit")).select("query_id", F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
