"""Quality classifier by importance resampling.

Two generative models over hashed word n-grams are counted: one of target text (rows labelled good), one of all raw
text. A document's log importance weight is the log ratio of the two models over its n-grams, here averaged over them so
that length doesn't decide. Labelled rows of both kinds, a bounded sample, turn the average into log odds; Gumbel noise,
a function of the row, is added, and the k rows with the largest sums are kept: a sample without replacement in
proportion to the weights. k is the number of rows whose odds favour the target, so far from the boundary noise decides
nothing. Rows that tie with the k-th are kept with it.

Defined cases: null or empty text has no n-grams and the weight of no evidence; rows without a label count as raw only;
repeated rows are kept or not together; labels that repeat an id count once, good if any is; with
no label of either kind every row is kept; other columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Lexicon, Scratch, as_texts, batches_of, chain, quiet, small_batches
from .sampling import bounded_sample, fit_logistic, kth_largest, labelled

TOKENS = re.compile(r"\w+|[^\w\s]+")


def feature_buckets(text: str, lexicon: Lexicon, buckets: int) -> np.ndarray:
    """Buckets of a text's words, runs of signs, and pairs of them, case kept."""
    ids = lexicon.ids([t.encode() for t in TOKENS.findall(text)])
    h = lexicon.array()[ids]
    with quiet():
        return (np.concatenate((h, chain(h[:-1], h[1:]))) % np.uint64(buckets)).astype(np.int64)


def bucket_counts(rows: DataFrame, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of buckets over all rows of (text, good), and over those that are good."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, lexicon = np.zeros((2, buckets), np.int64), Lexicon()
        for b in batches_of(batches):
            if lexicon.full():
                lexicon.reset()
            for text, good in zip(as_texts(b.column(0)), b.column(1).to_pylist()):
                counts = np.bincount(feature_buckets(text, lexicon, buckets), minlength=buckets)
                total[0] += counts
                if good:
                    total[1] += counts
        here = np.flatnonzero(total[0])
        if len(here):
            yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(total[0][here]), pa.array(total[1][here])], names=["bucket", "raw", "good"])

    raw, good = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    # At most a row for each bucket comes to the driver.
    for r in rows.mapInArrow(run, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).toPandas().itertuples():
        raw[r.bucket], good[r.bucket] = r.raw, r.good
    return raw, good


@dataclass
class Resampler:
    ratios: np.ndarray  # log ratio of the two models by bucket
    slope: float
    start: float
    seed: int


def log_weights(documents: DataFrame, ratios: np.ndarray) -> DataFrame:
    """own (each row, as a struct), log_weight (the average log ratio over a text's n-grams) and n_grams."""
    shared = documents.sparkSession.sparkContext.broadcast(ratios)
    text = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lexicon = shared.value, Lexicon()
        for b in batches_of(batches):
            if lexicon.full():
                lexicon.reset()
            weights, sizes = [], []
            for t in as_texts(b.column(0).field(text)):
                found = feature_buckets(t, lexicon, len(own))
                weights.append(float(own[found].mean()) if len(found) else 0.0)
                sizes.append(len(found))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(weights, pa.float64()), pa.array(sizes, pa.int64())], names=["own", "log_weight", "n_grams"])

    return documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("own")).mapInArrow(run, StructType().add("own", documents.schema).add("log_weight", "double").add("n_grams", "long"))


def fit(documents: DataFrame, labels: DataFrame, *, buckets: int = 1 << 16, smoothing: float = 1.0, sample_rows: int = 4000, seed: int = 1) -> Resampler:
    """Both models, counted over all rows, and the log odds' line. labels: doc_id, quality (1 is good)."""
    rows = labelled(documents.select("doc_id", "text"), labels, "quality", "_good")
    raw, good = bucket_counts(rows.select("text", F.coalesce(F.col("_good") == 1, F.lit(False)).alias("good")), buckets)
    ratios = np.log((good + smoothing) / (good.sum() + smoothing * buckets)) - np.log((raw + smoothing) / (raw.sum() + smoothing * buckets))
    sample = bounded_sample(rows.filter("_good is not null"), "_good", sample_rows)
    sample = log_weights(sample.select("text", "_good"), ratios).select("own._good", "log_weight").toPandas()
    if not len(sample):
        return Resampler(ratios, 0.0, 1e6, seed)
    slope, start = fit_logistic(sample["log_weight"].to_numpy(float), (sample["_good"].to_numpy() == 1).astype(float))
    return Resampler(ratios, slope, min(start, 1e6), seed)


def weigh(documents: DataFrame, model: Resampler) -> DataFrame:
    """own (each row, as a struct) with n_grams, log_weight, odds and gumbel_key; Gumbel noise is a function of doc_id and text."""
    small_batches(documents.sparkSession)
    uniform = (F.pmod(F.xxhash64("own.doc_id", "own.text", F.lit(model.seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    rows = log_weights(documents, model.ratios).withColumn("odds", F.lit(model.slope) * F.col("log_weight") + F.lit(model.start))
    return rows.withColumn("gumbel_key", F.col("odds") - F.log(-F.log(uniform)))


def cut(keys: DataFrame) -> float:
    """The smallest key that is kept: the k-th largest, where k rows have odds of 0 or more."""
    k = keys.filter("odds >= 0").count()
    return kth_largest(keys, "gumbel_key", k) if k else float("inf")


def scores(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, n_grams, log_weight, odds, gumbel_key and kept of every row."""
    scratch = Scratch(documents.sparkSession, "resampling")
    keys = weigh(documents.select("doc_id", "text"), fit(documents, labels, **options))
    keys = scratch.table(keys.select("own.doc_id", "n_grams", "log_weight", "odds", "gumbel_key"), "keys")
    return keys.withColumn("kept", F.col("gumbel_key") >= F.lit(cut(keys)))


def resample(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that are kept, with the columns of documents. Keys are a function of the row, so the texts are read again rather than stored."""
    scratch = Scratch(documents.sparkSession, "resampling")
    model = fit(documents, labels, **options)
    line = cut(scratch.table(weigh(documents.select("doc_id", "text"), model).select("odds", "gumbel_key"), "keys"))
    return weigh(documents, model).filter(F.col("gumbel_key") >= F.lit(line)).select(*(F.col("own").getField(c).alias(c) for c in documents.columns))
