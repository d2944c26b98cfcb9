"""The library's entry points, over DataFrames: prepare, scan, select, show, redact."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.text import replacement
from .operators.redaction import redact_findings, redact_values, redacted_text, searched
from .operators.scan import findings_of, scan_values, with_context, with_findings
from .operators.structured import FINDING
from .plans.documents import FIELDS, binary_values, document_values, redact_documents, scan_documents, values_of
from .plans.options import PRESETS, THRESHOLDS, Options

__all__ = [
    "PRESETS", "THRESHOLDS", "Options", "apply_replacements", "document_values", "escape_html", "findings_for_display", "redact_documents", "redact_text", "register", "replacement_for", "scan_documents", "scan_values", "sheet_preview", "with_context", "with_findings",
]


def replacement_for(label: str, original: str, mode: str = "redact") -> Column:
    """What takes a finding's place; label and original are names of columns."""
    return F.expr(replacement(label, original, mode))


def apply_replacements(values: DataFrame, findings: DataFrame, keys: list[str], mode: str = "redact") -> DataFrame:
    """Values (keys, value) with `output`, in which findings (keys, spans) are replaced."""
    return redact_findings(values, findings, keys, mode)


def redact_text(values: DataFrame, column: str = "value", options: Options = Options(), mode: str = "redact") -> DataFrame:
    """A table with a text column scanned and replaced by itself with findings of the options' confidence removed; nothing is shuffled."""
    rows = with_context(values.withColumn("_kept", F.struct(*(F.col(f"`{c}`") for c in values.columns))).select("_kept", F.col(f"`{column}`").alias("value"))).withColumn("kind", F.lit("text"))
    done = redact_values(with_findings(rows, options), options.threshold, mode)
    return done.select("_kept.*", "output").withColumn(column, F.when(F.col(f"`{column}`").isNotNull(), F.col("output"))).drop("output")


def register(spark: SparkSession) -> None:
    """SQL names for a session: table functions document_values(name, text) and office_values(name, content), scalar functions redacted(label, original), pseudonym(label, original), text_findings(text), an array, and redact_text(text), all SQL expressions."""
    shown = [(n, t) for n, _, t in FIELDS if n != "doc_id"]
    schema = ", ".join(f"{n} {t}" for n, t in shown)

    def rows(found: Iterator[dict]) -> Iterator[tuple]:
        for n, v in enumerate(found):
            v = {"value_seq": n} | v
            yield tuple(v.get(c) for c, _ in shown)

    class DocumentValues:
        def eval(self, name: str, text: str) -> Iterator[tuple]:
            yield from rows(values_of(name, text or ""))

    class OfficeValues:
        def eval(self, name: str, content: bytes) -> Iterator[tuple]:
            yield from rows(binary_values(name or "", bytes(content or b"")))

    spark.udtf.register("document_values", F.udtf(DocumentValues, returnType=schema))
    spark.udtf.register("office_values", F.udtf(OfficeValues, returnType=schema))
    for name, mode in (("redacted", "redact"), ("pseudonym", "pseudo")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(label STRING, original STRING) RETURNS STRING RETURN {replacement('label', 'original', mode)}")
    found = findings_of("text")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION text_findings(text STRING) RETURNS ARRAY<{FINDING}> RETURN {found}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION redact_text(text STRING) RETURNS STRING RETURN {redacted_text('text', found)}")


def findings_for_display(findings: DataFrame, text: str = "", badge_at: float = THRESHOLDS["high"]) -> DataFrame:
    """Findings that hold a text, with a badge HIGH or MEDIUM and their percentage."""
    return searched(findings, text.strip()).withColumn("badge", F.when(F.col("confidence") >= badge_at, "HIGH").otherwise("MEDIUM")).withColumn("percent", F.round(F.col("confidence") * 100).cast("int"))


def sheet_preview(values: DataFrame, sheets: int = 2, rows: int = 6) -> DataFrame:
    """The first rows of the first sheets of workbooks, a row of cells as one array."""
    shown = values.filter((F.col("sheet_index") < sheets) & (F.col("row_index") < rows - 1))
    lines = shown.groupBy("doc_id", "sheet_index", "row_index").agg(F.expr("transform(array_sort(collect_list(struct(column_index, value))), c -> c.value)").alias("cells"))
    return lines.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "sheet_index").orderBy("row_index")))


def escape_html(column: str) -> Column:
    out = F.col(column)
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out
