"""Corpus pipeline: quality rules, toxicity, near-duplicates, decontamination, packing.

Each stage takes what its predecessor kept, written as Parquet and read again.
All but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heliograph.llm import decontamination, packing, quality_rules, simhash, toxicity
from heliograph.llm.queries import tokenizer_path
from heliograph.llm.shared import mark, released, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without boilerplate lines. A line in more than 1000 texts of a host is one, however large the host."""
    return quality_rules.apply_quality_rules(docs, most_line_docs=1000)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have 0.8 of their five-word shingles in common with no kept document of their component.

    Components only propose: they hold texts linked at 6 or fewer differing bits of one of five fingerprints.
    One fingerprint at 3 bits, as op10's contract has it, links a fifth of such pairs; the README has the shares
    that more bits and more fingerprints link.
    """
    return simhash.deduplicated(docs, tau=6, seeds=tuple(range(42, 47)), least_share=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No documents with windows of two or more benchmark items, and no such windows in others."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in windows of 2048 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("pack", pack)]

#: SQL can't express toxicity and packing; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage has written besides its result, and its own input, goes once the result is there."""
    docs, kept = table(spark, sf_dir, "documents"), 0
    for name, stage in STAGES[:-1]:
        start = mark() - kept
        docs = written(stage(spark, docs, sf_dir), name)
        released(spark, start, mark() - 1)
        kept = 1
    return STAGES[-1][1](spark, docs, sf_dir)
