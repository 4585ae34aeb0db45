"""A corpus pipeline: language, near duplicates, repeated passages, benchmark leaks, token counts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lattica.llm import bpe, decontam, langid, neardup, substring
from lattica.llm.sampling import crc_share
from lattica.plans.scratch import Scratch


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the network finds in no language: null or letterless texts, and those where no language
    reaches half of the mean distribution (mixed, garbled, too short to tell).

    Learned from the rows with a lang. Columns stay; repeated rows and ids are judged each; no rows give none.
    """
    model = langid.learn(docs.filter(crc_share("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    return langid.keep_identified(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts alike in 0.8 of their five-word shingles stays: the least doc_id.

    Rows that share a doc_id stay or go together; rows without a doc_id stay.
    """
    return neardup.drop_near_duplicates(docs, words_per_shingle=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences of repeated runs go from all documents but the first; all documents stay, whole texts count."""
    return substring.remove_repeats(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null texts hold none."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of every document left; a null text counts as empty."""
    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", languages),
    ("near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("decontamination", leaks),
    ("bpe", tokens),
]

#: The trained model and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
