"""The trained models against plain loops: counts, features, FTRL, the toxicity gradient, importance ratios."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from cloakline.llm import langid, resampling, toxicity
from cloakline.llm.common import words_of

M32, M64 = (1 << 32) - 1, (1 << 64) - 1
TEXTS = ["The cat sat.", "the  Cat\tsat on THE mat!!", "", None, "Žluťoučký kůň", "aaaa aaaa", "漢字 and 𝄞"]


def plain_ngrams(text, buckets, orders=3):
    codes = [ord(c) * 0x9E3779B1 & M32 for c in " ".join(("", *text.lower().split(), ""))]
    shift = 32 - buckets.bit_length() + 1
    for at in range(len(codes)):
        h = 0
        for k, c in enumerate(codes[at : at + orders]):
            h = (((h ^ (h >> 13)) * 0xC2B2AE35) + c) & M32 if k else c
            yield ((h * 0x85EBCA6B & M32) ^ (h >> 15)) >> shift


def test_document_frequencies(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got, n = langid.document_frequencies(df, 1 << 9)
    want = Counter(b for t in TEXTS for b in set(plain_ngrams(t or "", 1 << 9)))
    assert n == len(TEXTS) and {k: int(v) for k, v in enumerate(got) if v} == want


def test_tf_idf_features(spark, monkeypatch):
    texts = [f"{w} {w}{k}" for k in range(12) for w in ("ba", "ko")]
    df = spark.createDataFrame([(k, t, "x" if k % 2 else "y") for k, t in enumerate(texts)], "doc_id long, text string, lang string")
    seen = []
    plain = langid.fit_ftrl
    monkeypatch.setattr(langid, "fit_ftrl", lambda rows, *a, **k: seen.extend(rows) or plain(rows, *a, **k))
    langid.fit(df, buckets=1 << 9, scale=10.0)
    counts = [Counter(plain_ngrams(t, 1 << 9)) for t in texts]
    idf = {b: math.log((1 + len(texts)) / (1 + sum(b in c for c in counts))) + 1 for c in counts for b in c}
    want = [{b: n / c.total() * idf[b] * 10 for b, n in c.items()} for c in counts]
    assert len(seen) == len(texts) - len(texts) // 5
    for at, values in seen:
        own = dict(zip(at.tolist(), values.tolist()))
        assert any(w.keys() == own.keys() and all(w[b] == pytest.approx(own[b], rel=1e-5) for b in w) for w in want)


def test_ftrl():
    rng = np.random.default_rng(5)
    buckets, classes, alpha, beta, l1, l2, epochs, seed = 12, 3, 0.5, 1.0, 0.4, 0.01, 3, 1
    rows = [(np.sort(rng.choice(buckets, 4, replace=False)), rng.random(4)) for _ in range(25)]
    labels = rng.integers(0, classes, len(rows))
    z = [[0.0] * classes for _ in range(buckets + 1)]
    n = [[0.0] * classes for _ in range(buckets + 1)]

    def weight(i, c):
        penalty = 0.0 if i == buckets else l1
        if abs(z[i][c]) <= penalty:
            return 0.0
        return (math.copysign(penalty, z[i][c]) - z[i][c]) / ((beta + math.sqrt(n[i][c])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            x = dict(zip(rows[k][0].tolist(), rows[k][1].tolist())) | {buckets: 1.0}
            w = {i: [weight(i, c) for c in range(classes)] for i in x}
            e = [math.exp(sum(v * w[i][c] for i, v in x.items())) for c in range(classes)]
            for i, v in x.items():
                for c in range(classes):
                    g = v * (e[c] / sum(e) - (c == labels[k]))
                    sigma = (math.sqrt(n[i][c] + g * g) - math.sqrt(n[i][c])) / alpha
                    z[i][c] += g - sigma * w[i][c]
                    n[i][c] += g * g
    got, bias = langid.fit_ftrl(rows, labels, classes, buckets, alpha=alpha, beta=beta, l1=l1, l2=l2, epochs=epochs, seed=seed)
    assert got == pytest.approx(np.array([[weight(i, c) for c in range(classes)] for i in range(buckets)]), abs=1e-9)
    assert bias == pytest.approx(np.array([weight(buckets, c) for c in range(classes)]), abs=1e-9)
    assert (got == 0).any() and (got != 0).any()


def test_toxicity_steps():
    """Two steps of AdaGrad along gradients of the loss that are found by differences."""
    texts = [b"ba bo zor", b"bo ba", b"ku", b"zor ku ba"]
    buckets, dims, rate, seed, epochs = 24, 2, 0.5, 3, 2
    trainer = toxicity.Trainer(texts, buckets, dims, rate, seed)
    wins = [w[i : i + toxicity.WINDOW] for w in map(words_of, texts) for i in range(max(1, len(w) - toxicity.WINDOW + 1))]
    assert len(wins) == len(trainer.wins)
    bad = [k for k, w in enumerate(wins) if b"zor" in w]
    good = [k for k in range(len(wins)) if k not in bad]
    share = min(10.0, max(1.0, len(good) / len(bad)))
    grams = {w: toxicity.subwords([w], buckets)[1].tolist() for win in wins for w in win}

    def logit(p, win):
        v, w, b = p[: buckets * dims].reshape(buckets, dims), p[buckets * dims : -1], p[-1]
        return np.mean([np.mean([v[g] for g in grams[x]], axis=0) for x in win], axis=0) @ w + b

    def loss(p):
        return sum(share * math.log1p(math.exp(-logit(p, wins[k]))) for k in bad) + sum(math.log1p(math.exp(logit(p, wins[k]))) for k in good)

    rng = np.random.default_rng(seed)
    p = np.concatenate((rng.normal(0, 0.1, (buckets, dims)).ravel(), rng.normal(0, 0.3, dims), [0.0]))
    held = np.full(len(p), 1e-6)
    for _ in range(epochs):
        g = np.array([(loss(p + h) - loss(p - h)) / 2e-5 for h in np.eye(len(p)) * 1e-5])
        squares = g**2
        squares[: buckets * dims] = np.repeat((g[: buckets * dims].reshape(buckets, dims) ** 2).mean(1), dims)
        held += squares
        p -= rate * g / np.sqrt(held)
    values, bias = trainer.train(np.array(bad), np.array(good), epochs)
    v, w = p[: buckets * dims].reshape(buckets, dims), p[buckets * dims : -1]
    assert values == pytest.approx(v @ w, abs=1e-4) and bias == pytest.approx(p[-1], abs=1e-4)
    assert trainer.values((values, bias)) == pytest.approx([logit(p, win) for win in wins], abs=1e-3)


def plain_features(text, buckets):
    def mix(x):
        x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & M64
        x = (x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53 & M64
        return x ^ (x >> 33)

    h = [xxhash.xxh64_intdigest(t, 42) for t in re.findall(r"\w+|[^\w\s]+", text)]
    return [x % buckets for x in h] + [mix((a * 0x9E3779B97F4A7C15 + b) & M64) % buckets for a, b in zip(h, h[1:])]


def test_importance_ratios(spark):
    buckets, smoothing = 1 << 6, 1.0
    rows = [(k, t, k % 2) for k, t in enumerate(TEXTS * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    raw, good = resampling.bucket_counts(df.selectExpr("text", "quality = 1 as good"), buckets)
    want_raw = Counter(b for _, t, _ in rows for b in plain_features(t or "", buckets))
    want_good = Counter(b for _, t, q in rows if q for b in plain_features(t or "", buckets))
    assert raw.tolist() == [want_raw[b] for b in range(buckets)] and good.tolist() == [want_good[b] for b in range(buckets)]

    labels = df.select("doc_id", "quality")
    got = {r.doc_id: r for r in resampling.scores(df.select("doc_id", "text"), labels, buckets=buckets, smoothing=smoothing).collect()}

    def ratio(b):
        return math.log((want_good[b] + smoothing) / (want_good.total() + smoothing * buckets)) - math.log((want_raw[b] + smoothing) / (want_raw.total() + smoothing * buckets))

    for k, t, _ in rows:
        own = plain_features(t or "", buckets)
        assert got[k].n_grams == len(own)
        assert got[k].log_weight == pytest.approx(sum(map(ratio, own)) / len(own) if own else 0.0, abs=1e-9)
