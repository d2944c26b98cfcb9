"""Exact top-k against all inner products, with copies, ties, nulls, odd lengths and huge components."""

import math

import numpy as np
import pytest
from cloakline.llm import topk
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k, scale=64):
    held = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in held if i % 20 == 0}:
        found = sorted(((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j) for i, v in held if i == q for j, w in held if j != q and len(v) == len(w)))[:k]
        out += [(q, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows", [40, 10_000])
def test_against_all_pairs(spark, shard_rows):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + 0.3 * rng.normal(size=8)).tolist()) for i in range(300)]
    rows += [(i, [0.5] * 8) for i in range(300, 460)]  # copies: ties go to the smaller vec_id, and a leaf is cut by hash
    rows += [(460, None), (461, [0.1] * 7 + [None]), (462, [float("nan")] * 8), (463, [float("inf")] * 8), (None, [1.0] * 8), (480, [1.0, 2.0]), (481, [0.5, 0.5]), (500, []), (501, []), (20, [0.25] * 8), (305, [0.5] * 8), (520, [0.0] * 8)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as d", "2 as leaf", "3 as score", "'x' as v", "4 as part")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=6, shard_rows=shard_rows).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == plain(rows, 6)


def test_few_rows_and_large_numbers(spark):
    rows = [(0, [1e6, -1e6]), (1, [1e6, 1e6]), (2, [3e6, -1e6]), (20, [1e12, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == plain(rows, 20)
    assert topk.top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []


def test_tree_skips_what_cannot_win():
    """Boxes are tight, every row is in one leaf, and a search with a floor finds only what beats it."""
    rng = np.random.default_rng(4)
    rows, ids = rng.integers(-60, 60, (2000, 4)), rng.permutation(2000)
    tree = topk.Tree.load(topk.Tree.build(rows, ids, 32).dump())
    for n in range(len(tree.start)):
        here = tree.rows[tree.start[n] : tree.stop[n]]
        assert (here.min(axis=0) == tree.low[n]).all() and (here.max(axis=0) == tree.high[n]).all() and tree.least[n] == tree.ids[tree.start[n] : tree.stop[n]].min()
    assert sorted(tree.ids.tolist()) == list(range(2000))
    query = rng.integers(-60, 60, (1, 4))
    scores = sorted(((int(s), -int(i)) for s, i in zip(rows @ query[0], ids)), reverse=True)
    assert tree.search(query, np.array([-1]), 10, [None])[0] == scores[:10]
    assert tree.search(query, np.array([-1]), 10, [scores[4]])[0] == scores[:4]
