"""The queries of this subpackage: each applies one operator, with production
parameters, to its whole table, and derives the digest columns from the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_extraction, language_id, lm_scoring, packing, quality_rules, sharding, simhash, token_binary, toxicity
from .shared import held_out_fold, table


def tokenizer_path(name: str) -> str:
    """Where the machine keeps a public tokenizer's file; the same on the driver and all executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", (held_out_fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in shards 0 to 7 under the law `rows`."""
    out = sharding.interleaved_shards(table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.identify(docs, language_id.language_samples(docs))
    return out.select("doc_id", (held_out_fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_binary.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_report(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.per_row(out).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.main_text(table(spark, sf_dir, "pages"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lm_scoring.katz_scores(docs.withColumn("held_out", held_out_fold(F.col("doc_id")) == 1), "held_out")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_sharding, op3_language_id, op4_packing, op5_token_binary, op6_quality_rules, op7_html_extraction, op8_decontamination, op9_lm_scoring, op10_simhash)}
