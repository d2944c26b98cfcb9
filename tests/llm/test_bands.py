import random

import numpy as np

import corpus_pipeline
from cloakline.llm import bands, simhash
from cloakline.llm.common import Lexicon


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(rng, words, n):
    copy = list(words)
    for at in rng.sample(range(len(copy)), n):
        copy[at] = f"e{rng.random()}"
    return copy


def brute(rows):
    """Ids that stay: the smallest of each component of pairs of similarity 0.8 or more."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j]) >= 0.8]
    for _ in rows:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(i, least.get(r, i))
    return set(least.values())


def test_stage_links_at_similarity_and_no_further(spark):
    rng, texts = random.Random(5), []
    for g in range(20):
        words = [f"g{g}w{rng.randrange(900)}" for _ in range(rng.choice((120, 300)))]
        texts.append(" ".join(words))
        for n in (1, 2, 3, 5, 8, 12):
            texts.append(" ".join(edited(rng, words, n)))
    line = "this line stands in all of these texts again and again without any end".split()
    texts += [" ".join(line * 20 + [f"own{k}x{j}" for j in range(60)]) for k in range(30)]
    texts += [None, "", " \t", "short text", "Short  text", "short text too"]
    ids = rng.sample(range(10_000), len(texts))
    rows = list(zip(ids, texts))
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_large_cells_and_components_give_the_same(spark):
    rng, texts = random.Random(6), []
    for g in range(3):
        words = [f"g{g}w{rng.randrange(900)}" for _ in range(200)]
        texts += [" ".join(edited(rng, words, rng.choice((1, 2, 3, 4, 6)))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute(list(enumerate(texts)))
    for options in ({}, {"cell_rows": 2}, {"chunk": 7}, {"cell_rows": 3, "chunk": 3}):
        assert {r.doc_id for r in simhash.one_of_each(df, **options).collect()} == want, options


def test_rows_that_differ_in_other_columns(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text, "en", 5), (1, text, "fr", 4), (1, text, None, 4), (2, text + " x", "en", 3), (9, "other words stand here alone", None, None), (9, "other words stand here alone", None, None), (None, text, "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a.b` int").selectExpr("*", "1 as _row", "map('k', lang) as node", "array(2) as root", "'x' as _own", "3 as place", "'y' as fp", "0 as key")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 9]
    assert got.filter("doc_id = 9 and _row = 1 and `a.b` is null").count() == 1
    assert simhash.one_of_each(df.limit(0)).count() == 0


def test_recall_of_candidates_at_the_least_similarity():
    rng, lexicon, met, all_pairs = random.Random(1), Lexicon(), 0, 0
    while all_pairs < 1000:
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(100, 800))]
        a, b = (bands.shingle_set(" ".join(w).encode(), lexicon) for w in (words, edited(rng, words, max(1, len(words) // 48))))
        if 0.8 <= bands.jaccard(a, b) < 0.85:
            all_pairs += 1
            x, y = (bands.band_keys(bands.minima(s)) for s in (a, b))
            met += bool((x == y).any()) and (int(bands.text_print(a)) ^ int(bands.text_print(b))).bit_count() <= 22
    assert met >= 995


def test_links_connect_what_pairs_connect():
    base = np.arange(1, 101, dtype=np.uint64)
    sets = [np.sort(np.concatenate((base[3 * k :], np.arange(1000, 1000 + 3 * k, dtype=np.uint64)))) for k in range(12)]
    root = list(range(12))
    for _ in sets:
        for x, y in bands.exact_links(sets, 0.8):
            assert bands.jaccard(sets[x], sets[y]) >= 0.8
            root[x] = root[y] = min(root[x], root[y])
    assert set(root) == {0}


def test_near_fingerprints_share_a_cell_of_the_grid():
    rng = np.random.default_rng(4)
    for dealings in (bands.DEALINGS, bands.MORE_DEALINGS):
        for n in (0, 1, 30, bands.GROUPS - 1):
            a = rng.integers(0, 2**64, bands.WIDE, np.uint64)
            bits = np.unpackbits(a.view(np.uint8), bitorder="little")
            bits[rng.choice(64 * bands.WIDE, n, replace=False)] ^= 1
            x, y = bands.wide_cells(np.stack((a, np.packbits(bits, bitorder="little").view(np.uint64))), dealings)
            assert len(x) == dealings * bands.GROUPS and (x == y).reshape(dealings, -1).any(1).all()


def test_grid_reaches_pairs_at_the_least_similarity():
    rng, lexicon = random.Random(2), Lexicon()
    for low, high, pairs in ((8, 70, 500), (100, 800, 500)):
        met = total = 0
        while total < pairs:
            words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(low, high))]
            other = edited(rng, words, max(1, len(words) // 48)) if total % 2 else words[: len(words) - rng.randrange(1, max(2, len(words) // 6))]
            a, b = (bands.shingle_set(" ".join(w).encode(), lexicon) for w in (words, other))
            if 0.8 <= bands.jaccard(a, b) < 0.85:
                total += 1
                x, y = bands.wide_print(a), bands.wide_print(b)
                cells = bands.wide_cells(np.stack((x, y)), bands.MORE_DEALINGS if max(len(a), len(b)) <= bands.FEW else bands.DEALINGS)
                met += bool((cells[0] == cells[1]).any()) and int(np.bitwise_count((x ^ y)[: bands.SHOWN]).sum()) <= 64
        assert met >= 0.995 * pairs


def test_cells_of_any_size_give_the_pairs(spark):
    rng = np.random.default_rng(5)
    rows, node = [], 0
    for key, n in enumerate([1, 2, 5, 40, 1, 90, 3]):
        base = rng.integers(0, 2**64, (3, bands.SHOWN), np.uint64)
        for k in range(n):
            own = base[k % 3].copy()
            for bit in rng.choice(64 * bands.SHOWN, 20, replace=False).tolist():
                own[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
            rows.append((key, node, *own.view(np.int64).tolist()))
            node += 1
    want = {(r[1] - k, r[1]) for i, r in enumerate(rows) for k in range(1, i + 1) if rows[i - k][0] == r[0] and k % 3 == 0}
    df = spark.createDataFrame(rows, "key long, node long, fp0 long, fp1 long, fp2 long")
    for options in ({"small": 32}, {"small": 2}, {"small": 100}, {"small": 2, "cell_rows": 20}):
        got = {(min(r), max(r)) for r in simhash.near_pairs(df, 64, 2, **({"cell_rows": 1000} | options)).collect()}
        root = list(range(node))
        for _ in range(8):
            for a, b in got:
                root[a] = root[b] = min(root[a], root[b])
        assert all(root[a] == root[b] for a, b in want), options
        assert "cell_rows" in options or got <= want, options


def test_stage_takes_its_candidates_from_the_grid(spark, monkeypatch):
    for name in ("minima", "band_keys"):
        monkeypatch.delattr(bands, name)
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join(words), " ".join(edited(random.Random(7), words, 3)), "other words stand here all alone"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == {0, 2}
