import random

import numpy as np
import pytest
import xxhash

from cloakline.llm import simhash

WORDS = [w + x for w in ("an", "be", "co", "du", "el", "fa", "go", "hi") for x in ("ra", "to", "li", "mu", "ne")]


def brute_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h)) if h else 0


def brute_components(fps, radius):
    root = list(range(len(fps)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[top(i)] = top(j)
    return [top(k) for k in range(len(fps))]


def partition(labels):
    groups = {}
    for k, x in enumerate(labels):
        groups.setdefault(x, []).append(k)
    return sorted(groups.values())


def test_fingerprint_is_the_contract(documents):
    for r in documents.collect():
        text = r.text or ""
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_manhattan_bounds_hamming():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 500, dtype=np.uint64)
    b = a ^ (rng.integers(0, 2**64, 500, dtype=np.uint64) & rng.integers(0, 2**64, 500, dtype=np.uint64))
    for width in (1, 2, 4, 8):
        far = np.abs(simhash.bit_counts(a, width).astype(int) - simhash.bit_counts(b, width)).sum(1)
        assert (far <= np.bitwise_count(a ^ b)).all()


@pytest.mark.parametrize("options", [{}, {"cell_rows": 3}, {"radius": 6, "groups": 9, "width": 1}])
def test_components_equal_brute_force(spark, options):
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        words = [rng.choice(WORDS) for _ in range(rng.choice((1, 4, 30, 200)))]
        for _ in range(rng.choice((1, 1, 2, 6))):
            copy = list(words)
            for _ in range(rng.choice((0, 0, 1, 2))):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            texts.append(" ".join(copy))
    texts += [None, "", " \t"]
    ids = rng.sample(range(10_000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_duplicates(df, **options).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i][0] % 2**64 for i in ids] == fps
    want = partition(brute_components(fps, options.get("radius", 2)))
    assert partition([got[i][1] for i in ids]) == want
    for group in want:
        assert {got[ids[k]][1] for k in group} == {min(ids[k] for k in group)}


def test_links_of_a_cell_connect_a_chain():
    fps = np.unique(np.cumsum([0] + [1 << k for k in range(40)]).astype(np.uint64))
    links = simhash.forest(fps, 2, 2)
    assert all((int(fps[a]) ^ int(fps[b])).bit_count() <= 2 for a, b in links) and len(links) < 2 * len(fps)
    root = {k: k for k in range(len(fps))}
    for _ in fps:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert set(root.values()) == {0}


def test_edge_rows(spark, documents):
    got = simhash.near_duplicates(documents).collect()
    assert len(got) == documents.count()
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, set()).add((r.fp, r.component_id))
    assert by_id[1] == by_id[2] == by_id[6] == {(0, 1)} and by_id[4] == {next(iter(by_id[0]))}
    assert by_id[None] and all(c is None for _, c in by_id[None])
    kept = simhash.one_of_each(documents)
    assert sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())[:3] == [-1, 0, 1] and kept.columns == documents.columns
    assert simhash.near_duplicates(documents.limit(0)).count() == 0
