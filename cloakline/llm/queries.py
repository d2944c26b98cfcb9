"""Queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import decontamination, html, langid, lm, media, packing, repair, resampling, sampling, simhash, token_files, topk, toxicity, trie
from .common import held_out, read_table
from .sql import ORACLES  # noqa: F401
from .tokens import tokenizer_path


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(read_table(spark, sf_dir, "pages"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    training = sampling.labelled(documents.filter(~held_out("doc_id", 4, 2)).select("doc_id", "text"), read_table(spark, sf_dir, "labels"), "toxic", "toxic")
    rows = toxicity.score(documents, toxicity.fit(training))
    return rows.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.sniff_media(media.stored_texts(read_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "media_type", "corrected")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    rows = lm.score_texts(documents, documents.filter(~held_out("doc_id", 5, 1)))
    return rows.select("doc_id", held_out("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    model = langid.fit(documents.filter(~held_out("doc_id", 4, 2)))
    rows = langid.identify(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return rows.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_files.token_files(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), 1)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = resampling.scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_grams", "log_weight", "odds", "gumbel_key", "kept")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(read_table(spark, sf_dir, "conversations")), texts=False).drop("repaired")


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(read_table(spark, sf_dir, "conversations"))



# What SQL can say of results that it can't compute: each of these reads the whole result of an operator's query.


def llm_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_decontamination(spark, sf_dir).select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


def llm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def llm_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


def llm_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each prediction is a language that documents to learn from have (or none), and its score from 0 to 1."""
    langs = read_table(spark, sf_dir, "documents").filter(~held_out("doc_id", 4, 2)).select(F.col("lang").alias("lang_pred")).distinct().withColumn("known", F.lit(True))
    rows = op8_language(spark, sf_dir).join(langs, "lang_pred", "left")
    undetermined = F.col("lang_pred") == "und"
    return rows.select("doc_id", "held_out", undetermined.alias("undetermined"), (undetermined | F.coalesce("known", F.lit(False))).alias("learned"), F.col("score").between(0, 1).alias("in_range"))


def llm_toxic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_toxicity(spark, sf_dir).select("doc_id", "held_out", F.col("score").between(0, 1).alias("in_range"), ((F.col("score") >= 0.3) == (F.col("predicted") == 1)).alias("decided"))


def llm_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the pieces of each document follow one another from its first id to its last."""
    pieces = op2_packing(spark, sf_dir)
    before = Window.partitionBy("doc_id").orderBy("start")
    pieces = pieces.withColumn("due", F.coalesce(F.lag(F.col("start") + F.col("length")).over(before), F.lit(0)))
    return pieces.groupBy("doc_id").agg(F.min(F.col("start") == F.col("due")).alias("gapless"), (F.sum("length") == F.max("doc_tokens")).alias("whole"))


def llm_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document starts where another one ends, or at 0."""
    rows = op9_token_files(spark, sf_dir)
    ends = rows.select((F.col("start") + F.col("n_tokens")).alias("start"), F.lit(True).alias("met"))
    rows = rows.join(ends, "start", "left")
    return rows.select("doc_id", ((F.col("start") == 0) | F.coalesce("met", F.lit(False))).alias("follows"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_packing": op2_packing,
    "op3_html": op3_html,
    "op4_toxicity": op4_toxicity,
    "op5_media": op5_media,
    "op6_simhash": op6_simhash,
    "op7_lm": op7_lm,
    "op8_language": op8_language,
    "op9_token_files": op9_token_files,
    "op10_resampling": op10_resampling,
    "op11_repair": op11_repair,
    "op12_top_k": op12_top_k,
    "op13_trie": op13_trie,
    "llm_leaks": llm_leaks,
    "llm_base_scores": llm_base_scores,
    "llm_payloads": llm_payloads,
    "llm_languages": llm_languages,
    "llm_toxic_scores": llm_toxic_scores,
    "llm_pieces": llm_pieces,
    "llm_token_files": llm_token_files,
}
