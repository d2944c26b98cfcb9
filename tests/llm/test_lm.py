import math
import zlib
from collections import Counter

import numpy as np
import pytest

from cloakline.llm import lm
from cloakline.llm.common import held_out


def test_filter_never_loses_a_count():
    rng = np.random.default_rng(1)
    keys, counts = np.unique(rng.integers(0, 2**64, 20_000, dtype=np.uint64)), None
    counts = rng.geometric(0.3, len(keys)) ** 3
    shard = (keys % np.uint64(3)).astype(int)
    shards = {k: lm.build(keys[shard == k], counts[shard == k]).tobytes() for k in range(3)}
    levels = lm.Filter(shards, 3).levels(keys)
    assert (levels >= lm.level_of(counts)).all()
    assert (levels == lm.level_of(counts)).mean() > 0.97
    strange = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    assert (lm.Filter(shards, 3).levels(strange) > 0).mean() < 0.03
    part = lm.Filter({1: shards[1]}, 3).levels(keys)
    assert ((part == -1) == (shard != 1)).all()


def test_levels_are_floor_log2():
    c = np.array([1, 2, 3, 4, 7, 8, 1023, 1024])
    assert lm.level_of(c).tolist() == [1, 2, 2, 3, 3, 4, 10, 11]


def test_texts_are_looked_up_together():
    """A call for each text made the probes take eight times as long."""
    rng, asked = np.random.default_rng(2), []
    texts = [np.append(rng.integers(0, 2**64, n, dtype=np.uint64), lm.END) for n in [*rng.integers(0, 40, 3000), 200_000, 0, 3]]

    def levels_of(keys):
        asked.append(len(keys))
        return (keys % np.uint64(7)).astype(np.int8)

    found = lm.looked_up(texts, levels_of)
    assert all((x == (h % np.uint64(7)).astype(np.int8)).all() and len(x) == len(h) for x, h in zip(found, texts, strict=True))
    assert len(asked) <= 4 and max(asked) == 200_001 and lm.looked_up([], levels_of) == []
    with lm.quiet():
        assert (lm.pair_keys(np.concatenate(texts)) == np.concatenate([lm.pair_keys(h) for h in texts])).all()
    for most in (1, 10, 1000):
        runs = list(lm.together([len(h) for h in texts], most))
        assert [x for x, _ in runs] + [len(texts)] == [0] + [y for _, y in runs]
        assert all(y == x + 1 or sum(len(h) for h in texts[x:y]) <= most for x, y in runs)


def tokens(text):
    return (text or "").encode().lower().split() + [None]


SMALL = {"head_words": 3, "group_bytes": 300, "chars_per_shard": 4000}


@pytest.mark.parametrize("options", [{}, SMALL, SMALL | {"most_passes": 100}, SMALL | {"most_passes": 0, "chunk_tokens": 20}])
def test_equals_brute_force(spark, documents, options):
    training = documents.filter(~held_out("doc_id", 5, 1))
    rows = lm.score_texts(documents, training, **options).collect()
    docs = documents.collect()
    assert len(rows) == len(docs)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    c, pairs = Counter(), Counter()
    for d in docs:
        if not held(d.doc_id):
            t = tokens(d.text)
            c.update(t)
            pairs.update(zip([None, *t[:-1]], t))
    n, v = sum(c.values()), len(c)
    want = {}
    for d in docs:
        t = tokens(d.text)
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        score = sum(math.log10((pairs[x, w] + 300 * (c[w] + 0.5) / (n + 0.5 * (v + 1))) / (c[x] + 300)) for x, w in zip([None, *t[:-1]], t))
        want[d.doc_id] = (len(t), sum(c[w] > 0 for w in t), n, base, score)
    for r in rows:
        size, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (size, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(score, rel=0.1, abs=0.6)  # counts are quantised


def test_without_training_rows(spark, documents):
    rows = lm.score_texts(documents, documents.limit(0)).collect()
    assert len(rows) == documents.count() and all(r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert lm.score_texts(documents.limit(0), documents).count() == 0


def test_both_routes_score_alike(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    training = documents.filter(~held_out("doc_id", 5, 1))
    few = {"group_bytes": 20_000, "chars_per_shard": 40_000}
    want = {r.doc_id: r for r in lm.score_texts(documents, training, most_passes=1000, **few).collect()}
    for chunk_tokens in (100, 5_000, 1_000_000):
        got = {r.doc_id: r for r in lm.score_texts(documents, training, most_passes=0, chunk_tokens=chunk_tokens, **few).collect()}
        assert got.keys() == want.keys()
        for k, r in got.items():
            assert r[:5] == want[k][:5] and r.score == pytest.approx(want[k].score, rel=1e-12) and r.base_score == pytest.approx(want[k].base_score, rel=1e-12)
