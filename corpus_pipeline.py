"""A corpus from raw documents to token ids, in stages that each use one text operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finops_spark.llm import byte_bpe, decontaminate, language, line_dedup, simhash
from finops_spark.llm.common import crc_share, read, store


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row, so that no column of an operator meets one of the documents."""
    return docs.select("doc_id", "text", F.struct("*").alias("_row"))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is told without doubt; learned as in op6."""
    held_out = F.coalesce(crc_share(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language.fit_language_model(docs.where(~held_out))
    told = language.predict_language(_packed(docs), model)
    return told.where((F.col("lang_pred") != language.UNKNOWN) & ~F.col("ambiguous")).select("_row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut lines found in three documents or more out of all but the last of these; no document goes."""
    kept = line_dedup.dedup_lines(_packed(docs)).select("_row.*", F.col("kept_text").alias("_kept"))
    return kept.withColumns({"text": F.col("_kept"), "n_chars": F.char_length("_kept").cast("bigint")}).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with linked fingerprints keep the one of the smallest doc_id; rows without an id stay."""
    others = simhash.near_duplicates(docs).where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of a benchmark item."""
    return decontaminate.remove_documents(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded bytes."""
    return byte_bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("simhash", keep_one_of_each_group),
    ("decontaminate", drop_benchmark_leaks),
    ("byte_bpe", encode),
]
#: No SQL: the stages need trained classifiers and byte-pair merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
