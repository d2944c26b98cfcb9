"""Whole documents: kind by name or by text, values, scan, the better of several readings, redaction in place.

Parsing and writing back work on one document at a time in Arrow batches; detection, profiles, seeds, collapse and
replacement are DataFrame operations.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import DESCRIPTOR_HEADERS, PATTERNS
from ..operators.redaction import finalised, numbered, redact_findings
from ..operators.scan import scan_collection, scan_values
from ..sources import parsers
from .options import Options
from .storage import stored

PLACES = ("table_index", "row_index", "column_index", "sheet_index", "segment_index")
FIELDS = (
    ("doc_id", pa.int64(), "long"), ("reading", pa.string(), "string"), ("preferred", pa.bool_(), "boolean"), ("sure", pa.bool_(), "boolean"), ("unit", pa.string(), "string"), ("value_seq", pa.int64(), "long"),
    ("value", pa.string(), "string"), ("key_hint", pa.string(), "string"), ("preview_path", pa.string(), "string"), ("path", pa.list_(pa.string()), "array<string>"), ("kind", pa.string(), "string"),
    *((p, pa.int32(), "int") for p in PLACES), ("disable_profile", pa.bool_(), "boolean"), ("profile_hints", pa.list_(pa.string()), "array<string>"), ("span_start", pa.int32(), "int"), ("span_stop", pa.int32(), "int"), ("reason", pa.string(), "string"),
)
VALUES = ", ".join(f"{n} {t}" for n, _, t in FIELDS)
READERS = {"csv": lambda t: parsers.delimited_values(t, ","), "tsv": lambda t: parsers.delimited_values(t, "\t"), "json": parsers.json_values, "yaml": parsers.yaml_values}
KINDS = {"csv": "table", "tsv": "table", "json": "json", "yaml": "yaml"}
ROLE, DELIMITER = re.compile(PATTERNS["PIPE_ROLE"].strip("^$").replace("(?i)^", ""), re.I), re.compile(PATTERNS["DELIMITER_ROW"])
LIKE_TEXT = ("text", "docx")


def values_of(name: str | None, text: str) -> Iterator[dict]:
    """All values of a text document: of its kind, and of each other reading that its text allows."""
    kind, others, reason = parsers.format_of(name, text)
    if kind == "rejected":
        yield {"reading": "rejected", "unit": "none", "reason": reason, "preferred": True}
        return
    sure = {k: c == "high" for k, c, _ in parsers.sniff(text)} if others else {}
    for reading in [kind, *others]:
        base = {"reading": reading, "preferred": reading == kind, "sure": sure.get(reading, False)}
        if reading == "text":
            yield base | {"unit": "whole", "value": text, "kind": "text"}
            for start, stop in parsers.pipe_names(text, ROLE, DELIMITER):
                yield base | {"unit": "pipe", "value": text[start:stop], "kind": "text", "preview_path": "pipe_row", "span_start": start, "span_stop": stop}
            for v in parsers.markdown_values(text, frozenset(DESCRIPTOR_HEADERS)):
                yield base | v | {"unit": "cell", "kind": "text"}
        else:
            try:
                for v in READERS[reading](text):
                    yield base | v | {"unit": "cell", "kind": KINDS[reading]}
            except ValueError as e:
                yield {"reading": "rejected", "unit": "none", "reason": f"not {reading}: {e}", "preferred": True}


def binary_values(name: str, data: bytes) -> Iterator[dict]:
    """Values of a workbook or a word processing file; another file, or a broken one, is refused."""
    lower = (name or "").lower()
    try:
        if lower.endswith(".xlsx"):
            for v in parsers.workbook_values(data):
                yield v | {"reading": "xlsx", "unit": "cell", "kind": "xlsx", "preferred": True}
        elif lower.endswith(".docx"):
            yield {"reading": "docx", "unit": "whole", "kind": "docx", "value": parsers.document_text(data), "preview_path": name, "preferred": True}
        else:
            yield {"reading": "rejected", "unit": "none", "reason": "not a workbook or a word processing file", "preferred": True}
    except Exception as e:  # a broken file is a row of its own
        yield {"reading": "rejected", "unit": "none", "reason": f"{type(e).__name__}: {e}", "preferred": True}


def document_values(documents: DataFrame) -> DataFrame:
    """Values of documents (doc_id, name, text or content)."""
    binary = "content" in documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, name, body in zip(*(c.to_pylist() for c in b.columns)):
                found = binary_values(name or "", body or b"") if binary else values_of(name, body or "")
                rows += [{"doc_id": doc_id, "value_seq": n} | v for n, v in enumerate(found)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t, _ in FIELDS], names=[n for n, _, _ in FIELDS])

    name = F.col("name").cast("string") if "name" in documents.columns else F.lit(None).cast("string")
    return documents.select(F.col("doc_id").cast("long"), name.alias("name"), "content" if binary else F.col("text").cast("string").alias("text")).mapInArrow(run, VALUES)


COLUMNS = ("doc_id", "reading", "preferred", "sure", "value_seq", "label", "category", "confidence", "start", "stop", "original", "reasoning", "key_hint", "preview_path", *PLACES)


def scan_documents(documents: DataFrame, options: Options = Options()) -> DataFrame:
    """Findings of documents, numbered; where a text may also be a table or YAML, of the reading that finds clearly more.

    Spans of text are of the document, spans of cells are of the cell.
    """
    values = stored(document_values(documents))
    whole = scan_values(values.filter("unit = 'whole'"), options)
    pipes = values.filter("unit = 'pipe'").selectExpr("*", "'PERSON' as label", "'identity' as category", "0.8D as confidence", "span_start as start", "span_stop as stop", "value as original", "array('pipe_row_person_context') as reasoning")
    # Readings of one document share no profile and no seeds: their key is the document and the reading.
    cells = values.filter("unit = 'cell'").withColumnRenamed("doc_id", "_doc").withColumn("doc_id", F.concat_ws(" ", F.col("_doc").cast("string"), "reading"))
    found = scan_collection(cells, options).drop("doc_id").withColumnRenamed("_doc", "doc_id")
    tabled = found.filter("reading = 'text'").withColumn("start", F.col("start") + F.col("span_start")).withColumn("stop", F.col("stop") + F.col("span_start"))
    text = whole.select(*COLUMNS).unionByName(tabled.select(*COLUMNS))
    text = text.unionByName(pipes.select(*COLUMNS))
    plain = finalised(text.filter("reading = 'text'"), ["doc_id", "reading"])
    every = stored(plain.unionByName(text.filter("reading <> 'text'")).unionByName(found.filter("reading <> 'text'").select(*COLUMNS)))
    # Readings are counted also where they find nothing.
    readings = values.select("doc_id", "reading", "preferred", F.coalesce("sure", F.lit(False)).alias("sure")).distinct()
    totals = readings.join(every.groupBy("doc_id", "reading").agg(F.count("*").alias("total")), ["doc_id", "reading"], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    by_doc = Window.partitionBy("doc_id")
    best = F.row_number().over(by_doc.orderBy(F.col("preferred"), F.desc("total"), F.desc("sure"), F.expr("array_position(array('yaml', 'tsv', 'csv'), reading)")))
    ranked = totals.withColumn("_best", best).withColumn("_own", F.max(F.when(F.col("preferred"), F.col("total"))).over(by_doc))
    other = F.max(F.when((F.col("_best") == 1) & ~F.col("preferred"), F.col("total"))).over(by_doc)
    better = F.coalesce((other > 0) & ((F.col("_own") == 0) | (other >= F.col("_own") + 2) | (other > F.col("_own")) & (F.col("_own") <= 1)), F.lit(False))
    chosen = ranked.withColumn("_better", better).filter((F.col("_better") & (F.col("_best") == 1) & ~F.col("preferred")) | (~F.col("_better") & F.col("preferred"))).select("doc_id", "reading")
    findings = every.join(chosen, ["doc_id", "reading"])
    return numbered(findings, ["doc_id"], ["value_seq", "start", F.desc("stop"), "label", F.desc("confidence")])


def rewritten(kind: str, text: str, cells: list) -> str:
    """A document with the outputs of its changed cells in place."""
    if kind in ("csv", "tsv"):
        separator = "," if kind == "csv" else "\t"
        header, rows = parsers.table(text, separator)
        for c in cells:
            rows[c["row_index"]][c["column_index"]] = c["output"]
        return parsers.delimited_text(header, rows, separator, parsers.line_ending(text), parsers.ends_in_newline(text))
    out, at = [], 0
    for c in sorted(cells, key=lambda c: c["span_start"]):
        out += [text[at : c["span_start"]], json.dumps(c["output"], ensure_ascii=False) if kind == "json" else c["output"]]
        at = c["span_stop"]
    return "".join([*out, text[at:]])


def redact_documents(documents: DataFrame, findings: DataFrame, mode: str = "redact") -> DataFrame:
    """doc_id, name, output, n_replaced of every document, with the findings given (selected ones) replaced in its own format.

    Binary documents: output is text for a word processing file, and column data has a workbook's bytes.
    """
    binary = "content" in documents.columns
    values = stored(document_values(documents))  # texts and cells are read apart
    spans = findings.select("doc_id", "reading", "value_seq", "start", "stop", "label", "confidence", "reasoning")
    texts = redact_findings(values.filter("unit = 'whole'").select("doc_id", "reading", "value"), spans.filter(F.col("reading").isin(*LIKE_TEXT)).drop("value_seq"), ["doc_id", "reading"], mode)
    cells = redact_findings(
        values.filter("unit = 'cell' and reading <> 'text'").select("doc_id", "reading", "value_seq", "value", *PLACES, "span_start", "span_stop"),
        spans.filter(~F.col("reading").isin(*LIKE_TEXT)),
        ["doc_id", "reading", "value_seq"],
        mode,
    ).filter("n_replaced > 0")
    changed = cells.groupBy("doc_id", "reading").agg(F.collect_list(F.struct("sheet_index", "row_index", "column_index", "span_start", "span_stop", "output")).alias("cells"), F.sum("n_replaced").alias("n_replaced"))
    changed = changed.unionByName(texts.filter("n_replaced > 0 or reading = 'docx'").select("doc_id", "reading", F.col("n_replaced").cast("long").alias("n_replaced"), F.col("output").alias("whole")), allowMissingColumns=True)
    name = F.col("name").cast("string") if "name" in documents.columns else F.lit(None).cast("string")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), name.alias("name"), "content" if binary else F.col("text").cast("string").alias("text")).join(changed, "doc_id", "left").select("doc_id", "name", "content" if binary else "text", "reading", "whole", "cells", "n_replaced")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, data, names = [], [], []
            for _, own, body, reading, whole, cells_, _ in zip(*(c.to_pylist() for c in b.columns)):
                text, book = None, None
                if binary and (own or "").lower().endswith(".xlsx"):
                    book = parsers.rewritten_workbook(body, {(c["sheet_index"], c["row_index"], c["column_index"]): c["output"] for c in cells_}) if cells_ else body
                elif whole is not None:
                    text = whole
                elif binary:
                    text = None  # refused
                else:
                    text = rewritten(reading, body or "", cells_) if cells_ else body
                out.append(text)
                data.append(book)
                names.append(output_name(own))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(out, pa.string()), pa.array(data, pa.binary()), pa.array([n or 0 for n in b.column(6).to_pylist()], pa.int64())], names=["doc_id", "name", "output", "data", "n_replaced"])

    return rows.mapInArrow(run, "doc_id long, name string, output string, data binary, n_replaced long")


def output_name(name: str | None) -> str:
    """What a redacted document is called."""
    name = name or "redacted.txt"
    stem, dot, ending = name.rpartition(".")
    if ending.lower() == "docx":
        return f"{stem}-redacted.txt"
    if ending.lower() == "xlsx":
        return f"{stem}-redacted.xlsx"
    return name


# Media types of file names.
MIME = {"csv": "text/csv", "tsv": "text/tab-separated-values", "json": "application/json", "yaml": "text/yaml", "yml": "text/yaml", "md": "text/markdown", "pdf": "application/pdf", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "png": "image/png"}


def media_type(name: str) -> str:
    """SQL text for a file name's media type; plain text by default."""
    cases = " ".join(f"when '{k}' then '{v}'" for k, v in MIME.items())
    return f"case lower(substring_index({name}, '.', -1)) {cases} else 'text/plain' end"
