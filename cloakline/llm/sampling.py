"""Bounded samples of labelled rows to fit classifiers on, and the k-th largest value of a table of any size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, label: str, most: int, most_chars: int = 16_000_000) -> DataFrame:
    """At most `most` rows of each label, and of whole texts of at most most_chars characters together: those with the
    smallest hashes of doc_id, the same on every run. Rows without an id go by the hash of their text; where ids repeat (a label has fewer than four
    fifths as many of them as rows), all of the label's rows go by id and text. A text of more than a sixteenth of most_chars is never sampled.

    Labels are counted over all rows first; a threshold on the hash then leaves about 1.2 times the bound, and only
    those rows are ranked.
    """
    found = rows.groupBy(label).agg(F.count("*").alias("n"), F.count("doc_id").alias("with_id"), F.approx_count_distinct("doc_id").alias("ids")).collect()
    counts = {r[0]: r["n"] for r in found}
    repeating = [r[0] for r in found if r["ids"] < 0.8 * r["with_id"]]

    def hashed(salt: str):
        by_text = F.xxhash64("doc_id", "text", F.lit(salt))
        own = F.when(F.col("doc_id").isNull(), by_text)
        for value in repeating:
            own = own.when(F.col(label).eqNullSafe(F.lit(value)), by_text)
        return own.otherwise(F.xxhash64("doc_id", F.lit(salt)))

    spread = F.pmod(hashed("sample"), F.lit(1_000_000))
    keep = F.lit(False)
    for value, n in counts.items():
        keep = F.when(F.col(label) == F.lit(value), spread < int(min(1.0, 1.2 * most / n + 20 / n) * 1_000_000) + 1).otherwise(keep)
    order = Window.partitionBy(label).orderBy("_spread", "doc_id", "text")
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    rows = rows.withColumn("_spread", hashed("order")).filter(keep & (size <= most_chars // 16))
    rows = rows.withColumn("_rank", F.row_number().over(order)).withColumn("_chars", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter((F.col("_rank") <= most) & (F.col("_chars") <= most_chars)).drop("_spread", "_rank", "_chars")


def labelled(documents: DataFrame, labels: DataFrame, value: str, name: str, most_ids: int = 4_000_000) -> DataFrame:
    """Documents with their label under a name, null where they have none; of several labels the largest counts.

    Up to most_ids labels are broadcast, so that texts aren't shuffled; more are joined by id.
    """
    known = labels.filter(f"doc_id is not null and {value} is not null").groupBy("doc_id").agg(F.max(value).alias(name))
    if known.count() <= most_ids:
        known = F.broadcast(known)
    return documents.drop(name).join(known, "doc_id", "left")


def _boundary(rows: DataFrame, column: str, k: int, enough: int = 5000, bins: int = 4096) -> tuple[float, float, int]:
    """lo, hi, n: exactly k - n rows are above hi, and the k-th largest lies in [lo, hi]. Narrows by histograms until few rows are left or all are equal."""
    low, high, total = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    need = k
    while total > enough and low < high:
        width = (high - low) / bins
        if width <= 0 or low + width <= low:
            break
        place = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).alias("bin")
        own = rows.filter(F.col(column).between(low, high)).groupBy(place).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        above = 0
        for r in sorted(own, key=lambda r: -r["bin"]):
            if above + r.n >= need:
                break
            above += r.n
        need, total = need - above, r.n
        if (r.lo, r.hi) == (low, high):
            break
        low, high = r.lo, r.hi
    return low, high, need


def kth_largest(rows: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a column, exactly. Only histogram counts and few rows around it come to the driver."""
    low, high, need = _boundary(rows, column, k)
    if low == high:
        return low
    # Few rows, or few values that floating point can tell apart: values with their counts.
    near = rows.filter(F.col(column).between(low, high)).groupBy(F.col(column).alias("value")).count().collect()
    for value, n in sorted(map(tuple, near), reverse=True):
        need -= n
        if need <= 0:
            break
    return value


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept of P(y = 1 | x), by Newton steps with a small ridge on standardised x."""
    if len(x) == 0 or y.min() == y.max():
        return 0.0, (float("inf") if len(y) and y[0] else 0.0)
    mean, spread = float(x.mean()), float(x.std()) or 1.0
    z, w = np.stack([(x - mean) / spread, np.ones(len(x))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * len(x) * np.eye(2), z.T @ (p - y) + ridge * len(x) * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / spread), float(w[1] - w[0] * mean / spread)
