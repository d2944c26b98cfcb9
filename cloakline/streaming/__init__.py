"""Scans over streams: values are scanned and redacted as they come; what needs whole documents runs on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.redaction import redact_values
from ..operators.scan import scan_collection, scan_values, with_findings
from ..plans.options import THRESHOLDS, Options


def scan_stream(values: DataFrame, options: Options = Options()) -> DataFrame:
    """Findings of a stream of values; stateless."""
    return scan_values(values, options)


def redact_stream(values: DataFrame, options: Options = Options(), threshold: float | None = None, mode: str = "redact") -> DataFrame:
    """A stream of values with `output`; stateless."""
    return redact_values(with_findings(values, options), THRESHOLDS[options.confidence] if threshold is None else threshold, mode).drop("findings")


def each_batch(stream: DataFrame, work: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]) -> DataStreamWriter:
    """Runs document-scoped work (profiles, seeds, readings) on each micro-batch of whole documents."""
    return stream.writeStream.foreachBatch(lambda batch, epoch: sink(work(batch), epoch))


def whole_documents(values: DataFrame, time: str, gap: str, lateness: str) -> DataFrame:
    """A stream of single values (doc_id, value_seq, value, an event time) as a stream of whole documents, each once it is over.

    A document's values wait in the state store as one session of that document: it is over when the watermark, `lateness` behind the latest event time,
    passes its last value by `gap`. Values that come late, but before that, are in their place; those that come later are dropped by Spark, which counts
    them. So the state holds the open documents alone. A null doc_id is a document. Gives doc_id, value_seq, value, kind."""
    held = F.collect_list(F.struct("value_seq", "value"))
    over = values.withWatermark(time, lateness).groupBy(F.session_window(time, gap), "doc_id").agg(held.alias("_values"))
    return over.select("doc_id", F.explode("_values").alias("v")).select("doc_id", "v.value_seq", "v.value", F.lit("text").alias("kind"))


def scan_document_stream(values: DataFrame, sink: Callable[[DataFrame, int], None], time: str = "time", gap: str = "10 minutes", lateness: str = "5 minutes", options: Options = Options()) -> DataStreamWriter:
    """Both passes over documents that come value by value: names of a late value are found in the early ones too, as in a batch."""
    whole = whole_documents(values, time, gap, lateness)
    return each_batch(whole, lambda batch: scan_collection(batch, options), sink).outputMode("append")
