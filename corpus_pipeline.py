"""A corpus pipeline: language, quality, near duplicates, benchmark leaks, packed sequences.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns a DataFrame; run() writes
each stage's rows as Parquet in the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloakline.llm import decontamination, langid, packing, resampling, simhash
from cloakline.llm.common import Scratch, read_table
from cloakline.llm.tokens import tokenizer_path

#: A document whose language is less certain than this goes.
LEAST_LANGUAGE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; texts without a letter, and those of uncertain language, go."""
    return langid.of_known_language(docs, langid.fit(docs), LEAST_LANGUAGE)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps."""
    return resampling.resample(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more."""
    return simhash.one_of_each(docs, shingle=5, least=0.8)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, with their ids."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination_stage),
    ("packing", packed),
]

#: SQL expresses none of the stages' models; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
