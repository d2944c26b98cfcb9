"""Readers and writers over Spark's own sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import line_ending


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """Text documents of a folder: doc_id, name, text, line_ending, trailing_newline."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return _named(files).withColumn("line_ending", F.expr(line_ending("text"))).withColumn("trailing_newline", F.col("text").endswith("\n"))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """Workbooks, word processing files and others: doc_id, name, content."""
    return _named(spark.read.format("binaryFile").load(path).select("path", "content"))


def _named(files: DataFrame) -> DataFrame:
    return files.withColumn("doc_id", F.xxhash64("path")).withColumn("name", F.element_at(F.split("path", "/"), -1))


def kind_of_file(name: str = "name") -> str:
    """SQL text: how a file is read."""
    return f"case when lower({name}) rlike '[.](png|jpe?g|gif|webp|bmp|tiff?)$' then 'image' when lower({name}) rlike '[.](pdf|docx|xlsx)$' then lower(substring_index({name}, '.', -1)) else 'text' end"


def melted(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Cells of a wide table as values: doc_id, row_index, column_index, key_hint, value. One row becomes one for each column, nothing is shuffled.
    The whole table is one document: its columns' profiles are of all rows, and its names spread over all of it."""
    cells = F.array(*(F.struct(F.lit(k).alias("column_index"), F.lit(c).alias("key_hint"), F.col(c).cast("string").alias("value")) for k, c in enumerate(columns)))
    out = rows.select(F.col(key).cast("long").alias("row_index"), F.explode(cells).alias("c")).select(F.lit(0).cast("long").alias("doc_id"), "row_index", "c.column_index", "c.key_hint", "c.value")
    return out.withColumn("kind", F.lit("table")).withColumn("preview_path", F.concat(F.lit("row "), F.col("row_index") + 1, F.lit("."), "key_hint")).withColumn("value_seq", F.col("row_index") * len(columns) + F.col("column_index"))


def write_outputs(outputs: DataFrame, path: str) -> None:
    """Redacted texts as text files, one row a line end apart."""
    outputs.select(F.coalesce("output", F.lit("")).alias("value")).write.mode("overwrite").text(path, lineSep="\n")
