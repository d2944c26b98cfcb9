"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, white space becomes one space, and character n-grams of 1 to 3 are hashed to `buckets`. Document
frequencies are counted over all training rows. The weights are fitted by follow-the-regularised-leader with an
elastic-net penalty on a bounded sample (`sample_rows` of each language), four fifths of it; the rest fits the
temperature. Most weights are exactly zero.

Defined cases: null text, or text without a letter, is `und` with score 0; null languages are not learned from; with no
training row every document is `und`; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import batches_of, quiet, small_batches
from .sampling import bounded_sample

UNKNOWN = "und"


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def ngram_buckets(text: str, buckets: int, orders: int = 3) -> Iterator[np.ndarray]:
    """Hashed n-grams of a whole text, in runs; buckets is a power of two."""
    shift = np.uint32(32 - buckets.bit_length() + 1)
    codes = np.frombuffer(" ".join(("", *text.lower().split(), "")).encode("utf-32-le"), "<u4")
    step = 1 << 16
    with quiet():
        for at in range(0, len(codes), step):
            c = codes[at : at + step + orders - 1] * np.uint32(0x9E3779B1)
            h, n = c, len(codes[at : at + step])
            yield ((h[:n] * np.uint32(0x85EBCA6B)) ^ (h[:n] >> np.uint32(15))) >> shift
            for k in range(1, orders):
                h = (h[:-1] ^ (h[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + c[k:]
                yield ((h[:n] * np.uint32(0x85EBCA6B)) ^ (h[:n] >> np.uint32(15))) >> shift


def document_frequencies(texts: DataFrame, buckets: int) -> tuple[np.ndarray, int]:
    """Documents that have each bucket, over all rows of a text column, and the number of documents."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen, n = np.zeros(buckets, np.int64), np.zeros(buckets, bool), 0
        for b in batches_of(batches):
            for text in b.column(0).to_pylist():
                for part in ngram_buckets(text or "", buckets):
                    seen[part] = True
                here = np.flatnonzero(seen)
                total[here] += 1
                seen[here] = False
                n += 1
        if n:
            here = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(here, -1)), pa.array(np.append(total[here], n))], names=["bucket", "n"])

    out, documents = np.zeros(buckets, np.int64), 0
    # At most a row for each bucket comes to the driver.
    for r in texts.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas().itertuples():
        if r.bucket < 0:
            documents = int(r.n)
        else:
            out[r.bucket] = r.n
    return out, documents


@dataclass
class LanguageModel:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, already times idf
    bias: np.ndarray
    temperature: float
    buckets: int

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for part in ngram_buckets(text, self.buckets):
            total += self.weights[part].sum(0, dtype=np.float64)
            n += len(part)
        return total / max(1, n) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, buckets: int, *, alpha: float = 0.5, beta: float = 1.0, l1: float = 2e-3, l2: float = 1e-3, epochs: int = 4, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets x classes) and bias by FTRL-proximal with an elastic net; rows are (buckets, values), each bucket once."""
    z, n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))
    order = np.random.default_rng(seed)

    def weights(zz: np.ndarray, nn: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zz) <= penalty, 0.0, (np.sign(zz) * penalty - zz) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x = rows[k]
            at, x = np.append(at, buckets), np.append(x, 1.0)  # the last row is the bias, without penalty
            penalty = np.full((len(at), 1), l1)
            penalty[-1] = 0
            w = weights(z[at], n[at], penalty)
            p = softmax(x @ w)
            p[labels[k]] -= 1
            g = x[:, None] * p[None, :]
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
    penalty = np.full((buckets + 1, 1), l1)
    penalty[-1] = 0
    w = weights(z, n, penalty)
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden-section search on its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-12).mean())

    a, b, r = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(training: DataFrame, *, buckets: int = 1 << 17, sample_rows: int = 500, scale: float = 200.0) -> LanguageModel:
    """A model learned from rows of doc_id, text and lang."""
    training = training.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    seen, documents = document_frequencies(training.select("text"), buckets)
    if not documents:
        return LanguageModel([], np.zeros((buckets, 0)), np.zeros(0), 1.0, buckets)
    idf = np.log((1 + documents) / (1 + seen)) + 1

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_of(batches):
            at, tf = [], []
            for text in b.column(1).to_pylist():
                counts = np.zeros(buckets, np.int64)
                for part in ngram_buckets(text, buckets):
                    counts += np.bincount(part, minlength=buckets)
                here = np.flatnonzero(counts)
                at.append(here.astype(np.int32))
                tf.append((counts[here] / max(1, counts.sum())).astype(np.float32))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.float32()))], names=["lang", "at", "tf"])

    # The sample's sparse rows, sample_rows for each language, come to the driver.
    sample = bounded_sample(training, "lang", sample_rows).select("lang", "text").mapInArrow(features, "lang string, at array<int>, tf array<float>").toArrow().to_pydict()
    languages = sorted(set(sample["lang"]))
    if not languages:
        return LanguageModel([], np.zeros((buckets, 0)), np.zeros(0), 1.0, buckets)
    labels = np.array([languages.index(x) for x in sample["lang"]])
    rows = [(np.array(a), np.array(t) * idf[a] * scale) for a, t in zip(sample["at"], sample["tf"])]
    turn = np.random.default_rng(7).permutation(len(rows))
    held, used = turn[: len(rows) // 5], turn[len(rows) // 5 :]
    w, bias = fit_ftrl([rows[k] for k in used], labels[used], len(languages), buckets)
    logits = np.array([rows[k][1] @ w[rows[k][0]] + bias for k in held]).reshape(len(held), len(languages))
    return LanguageModel(languages, (w * idf[:, None] * scale).astype(np.float32), bias, fit_temperature(logits, labels[held]), buckets)


def predicted(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """own (each row, as a struct), lang_pred and score."""
    spark = documents.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # buckets x languages float32
    text = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches_of(batches):
            got = [own.predict(t) for t in b.column(0).field(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["own", "lang_pred", "score"])

    return documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("own")).mapInArrow(run, StructType().add("own", documents.schema).add("lang_pred", "string").add("score", "double"))


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of a table with lang_pred and score added (columns of these names are replaced)."""
    return predicted(documents, model).select(*(F.col("own").getField(c).alias(c) for c in documents.columns if c not in ("lang_pred", "score")), "lang_pred", "score")


def of_known_language(documents: DataFrame, model: LanguageModel, least: float) -> DataFrame:
    """The rows whose language is found with a score of `least` or more, as they are."""
    rows = predicted(documents, model).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return rows.select(*(F.col("own").getField(c).alias(c) for c in documents.columns))
