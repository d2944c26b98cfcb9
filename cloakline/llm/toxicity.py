"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its character n-grams (3 to 5 bytes, with marks at its ends) and of itself, hashed to `buckets`;
its vector is their average, so an unseen misspelling shares most of its vectors with the word it comes from. A window
of words is the average of its words' vectors, and a linear softmax gives its probability. Labels are of documents, so
training picks windows: models of two thirds of the sample, for which all windows of a toxic document count as toxic,
find the highest window in each toxic document of the last third; the final model learns from those against all windows
of clean documents. A document's score is that of its highest window, calibrated on documents set aside.

The model is fitted on a bounded sample of labelled rows (`sample_rows` whole texts of each label, and 16 million
characters of each). Since the softmax is linear, a
word comes down to one number, kept in a bounded memory by each worker.

Defined cases: null or empty text scores as a window without words; labels that repeat an id count once, toxic if any
is; null labels are not learned from; with no label of one kind every score is 0 (or 1 if all are toxic); repeated rows
get equal scores; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batches_of, quiet, small_batches, words_of
from .sampling import bounded_sample, fit_logistic

#: Words of a window.
WINDOW = 2
ORDERS = (3, 4, 5)


def subwords(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every n-gram of every word and of the words themselves, in order of words."""
    lengths = np.array([len(w) + 2 for w in words], np.int64)
    chars = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(words)), lengths)
    end = np.repeat(np.cumsum(lengths), lengths)
    owners, found = [np.arange(len(words))], [np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))]
    with quiet():
        h = chars
        for n in range(2, max(ORDERS) + 1):
            h = h[:-1] * np.uint64(0x100000001B3) + chars[n - 1 :]
            if n in ORDERS:
                ok = np.arange(len(h)) + n <= end[: len(h)]
                x = (h[ok] ^ (h[ok] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
                owners.append(word[: len(h)][ok])
                found.append(x ^ (x >> np.uint64(32)))
    owner, bucket = np.concatenate(owners), (np.concatenate(found) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return owner[order], bucket[order]


@dataclass
class ToxicityModel:
    values: np.ndarray  # one number for each bucket: its embedding times the softmax's weights
    bias: float
    slope: float
    start: float

    def word_values(self, words: list[bytes]) -> np.ndarray:
        owner, bucket = subwords(words, len(self.values))
        return np.bincount(owner, self.values[bucket], len(words)) / np.bincount(owner, minlength=len(words))

    def probability(self, raw: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * raw + self.start, -30, 30))))


class Scorer:
    """Scores texts; remembers words' values."""

    def __init__(self, model: ToxicityModel, most_words: int = 400_000):
        self.model, self.most, self.known = model, most_words, {}

    def raw(self, texts: list[bytes]) -> list[float]:
        """The highest window's logit of each text."""
        if len(self.known) > self.most:
            self.known.clear()
        out, run, size = [], [], 0
        for t in texts:
            run.append(words_of(t))
            size += len(run[-1])
            if size > 200_000:
                out += self._run(run)
                run, size = [], 0
        return out + self._run(run)

    def _run(self, cut: list[list[bytes]]) -> list[float]:
        new = list(set().union(*cut).difference(self.known))
        if new:
            self.known.update(zip(new, self.model.word_values(new).tolist()))
        get, out = self.known.__getitem__, []
        for words in cut:
            n = len(words)
            if not n:
                out.append(self.model.bias)
                continue
            sums = np.concatenate(([0.0], np.cumsum(np.fromiter(map(get, words), float, n))))
            w = min(n, WINDOW)
            starts = np.arange(n - w + 1)
            out.append(float((sums[starts + w] - sums[starts]).max() / w) + self.model.bias)
        return out


def fit(training: DataFrame, *, buckets: int = 1 << 17, dims: int = 8, sample_rows: int = 1500, epochs: int = 5, rate: float = 0.5, seed: int = 1) -> ToxicityModel:
    """A model learned from rows of doc_id, text and toxic."""
    rows = training.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "toxic").filter("toxic is not null")
    # At most sample_rows texts of each label come to the driver.
    sample = bounded_sample(rows, "toxic", sample_rows).select("text", "toxic").toArrow()
    return fit_texts(as_bytes(sample.column("text")), np.array(sample.column("toxic").to_pylist() or [0]) == 1, buckets, dims, epochs, rate, seed)


class Trainer:
    """Fits embeddings and softmax jointly on windows of a sample's words, by AdaGrad."""

    def __init__(self, texts: list[bytes], buckets: int, dims: int, rate: float, seed: int):
        self.buckets, self.dims, self.rate, self.seed = buckets, dims, rate, seed
        number, wins = {}, []
        for text in texts:
            words = words_of(text)
            ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
            if 0 < len(ids) < WINDOW:  # a text shorter than a window is one
                ids = np.append(ids, np.full(WINDOW - len(ids), -1, np.int32))
            wins.append(np.lib.stride_tricks.sliding_window_view(ids, WINDOW) if len(ids) else np.zeros((0, WINDOW), np.int32))
        self.wins = np.concatenate(wins) if wins else np.zeros((0, WINDOW), np.int32)
        self.doc = np.repeat(np.arange(len(wins)), [len(w) for w in wins])
        self.length = (self.wins >= 0).sum(1)
        self.owner, self.bucket = subwords(list(number), buckets)
        self.size = np.bincount(self.owner, minlength=len(number))
        self.first = np.concatenate(([0], np.cumsum(self.size)))

    def values(self, model: tuple[np.ndarray, float]) -> np.ndarray:
        """Each window's logit."""
        own = np.append(np.bincount(self.owner, model[0][self.bucket], len(self.size)) / self.size, 0.0)
        return own[self.wins].sum(1) / self.length + model[1]

    def train(self, bad: np.ndarray, good: np.ndarray, epochs: int) -> tuple[np.ndarray, float]:
        """Bucket values and bias learned from toxic and clean windows, the fewer weighted up to 10 times."""
        rng = np.random.default_rng(self.seed)
        vectors, weights, bias = rng.normal(0, 0.1, (self.buckets, self.dims)), rng.normal(0, 0.3, self.dims), 0.0
        held_v, held_w, held_b = np.full(self.buckets, 1e-6), np.full(self.dims, 1e-6), 1e-6
        chosen = np.concatenate((good, bad))
        y = np.concatenate((np.zeros(len(good)), np.ones(len(bad))))
        share = np.where(y > 0, np.clip(len(good) / max(1, len(bad)), 1, 10), 1.0)
        dims = range(self.dims)
        for _ in range(epochs):
            turn = rng.permutation(len(chosen))
            for at in range(0, len(turn), 4096):
                part = turn[at : at + 4096]
                own, n = self.wins[chosen[part]], self.length[chosen[part]]
                used, place = np.unique(own[own >= 0], return_inverse=True)
                where = np.repeat(np.arange(len(part)), n)
                size = self.size[used]
                grams = self.bucket[np.repeat(self.first[used] - np.cumsum(size) + size, size) + np.arange(size.sum())]
                of = np.repeat(np.arange(len(used)), size)
                # Forward: n-grams to words, words to windows, windows to a logit.
                word = np.stack([np.bincount(of, vectors[grams, d], len(used)) for d in dims], 1) / size[:, None]
                x = np.stack([np.bincount(where, word[place, d], len(part)) for d in dims], 1) / n[:, None]
                g = (1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30))) - y[part]) * share[part]
                # Backward, the same way.
                g_w, g_b, by_word = x.T @ g, g.sum(), np.bincount(place, (g / n)[where], len(used)) / size
                hit, slot = np.unique(grams, return_inverse=True)
                g_v = np.bincount(slot, by_word[of], len(hit))[:, None] * weights[None, :]
                held_v[hit] += (g_v**2).mean(1)
                held_w += g_w**2
                held_b += g_b**2
                vectors[hit] -= self.rate * g_v / np.sqrt(held_v[hit])[:, None]
                weights -= self.rate * g_w / np.sqrt(held_w)
                bias -= self.rate * g_b / np.sqrt(held_b)
        return vectors @ weights, float(bias)


def fit_texts(texts: list[bytes], labels: np.ndarray, buckets: int = 1 << 17, dims: int = 8, epochs: int = 5, rate: float = 0.5, seed: int = 1) -> ToxicityModel:
    """The model of a sample's texts and labels (true: toxic)."""
    if not len(texts) or labels.all() or not labels.any():
        return ToxicityModel(np.zeros(buckets), 0.0, 0.0, 30.0 if len(texts) and labels.all() else -30.0)
    rng = np.random.default_rng(seed)
    aside = rng.random(len(texts)) < 0.2
    used, of = [t for t, a in zip(texts, aside) if not a], labels[~aside]
    trainer = Trainer(used, buckets, dims, rate, seed)
    toxic, fold = of[trainer.doc], rng.integers(0, 3, len(used))[trainer.doc]
    good, picked = np.flatnonzero(~toxic), np.zeros(len(toxic), bool)
    best = np.full(len(used), -np.inf)
    # Which windows make a document toxic is asked of models that haven't seen it.
    for k in range(3):
        model = trainer.train(np.flatnonzero(toxic & (fold != k)), good[fold[good] != k], 1)
        v = trainer.values(model)
        own = np.flatnonzero(toxic & (fold == k))
        np.maximum.at(best, trainer.doc[own], v[own])
        picked[own] = v[own] >= best[trainer.doc[own]] - 1e-9
    model = trainer.train(np.flatnonzero(picked), good, epochs)
    # Once more, with the other windows that the model is sure of.
    v = trainer.values(model)
    line = np.quantile(v[good], 0.9999) if len(good) else 0.0
    model = trainer.train(np.flatnonzero(toxic & (picked & (v > line) | (v > 2 * max(line, 0) + 1))), good, epochs)
    out = ToxicityModel(*model, 1.0, 0.0)
    raw = np.array(Scorer(out).raw([t for t, a in zip(texts, aside) if a]))
    y = labels[aside].astype(float)
    if len(y) and 0 < y.sum() < len(y):
        out.slope, out.start = fit_logistic(np.clip(raw, -20, 20), y)
    return out


def score(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score, the probability that a text is toxic, of every row."""
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # one number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in batches_of(batches):
            raw = scorer.raw(as_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shared.value.probability(float(np.clip(x, -20, 20))) for x in raw])], names=["doc_id", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
