"""The registered queries of the numbered text operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finops_spark.llm import (
    byte_bpe,
    decontaminate,
    language,
    line_dedup,
    minhash,
    prefix_trie,
    quality,
    simhash,
    spelling,
    substring_dedup,
    token_counts,
    toxicity,
    warc,
)
from finops_spark.llm.common import crc_share, read


def op1_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.hit_report(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(read(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, folder, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_share(F.col("doc_id"), 3) == 1, F.lit(False))
    labels = read(spark, folder, "labels").select("doc_id", "toxic").where("toxic is not null").where(~held_out)
    model = toxicity.fit_toxicity(docs.join(labels, "doc_id"))
    scored = toxicity.score_toxicity(docs.withColumn("held_out", held_out), model)
    return scored.select("doc_id", "held_out", "score", "predicted", "sentences")


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.digest_report(read(spark, folder, "documents"))


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(crc_share(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language.fit_language_model(docs.where(~held_out))
    told = language.predict_language(docs.drop("lang").withColumn("held_out", held_out), model)
    return told.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return byte_bpe.token_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(read(spark, folder, "documents"))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive_report(read(spark, folder, "pages"))


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, folder, "documents"))


def op11_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, folder, "documents"))


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, folder, "documents"))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.build_trie(read(spark, folder, "conversations"))


def registered() -> dict:
    queries = (
        op1_decontaminate,
        op2_token_counts,
        op3_line_dedup,
        op4_toxicity,
        op5_substring_dedup,
        op6_language_id,
        op7_byte_bpe,
        op8_quality_rules,
        op9_warc,
        op10_simhash,
        op11_minhash,
        op12_spelling,
        op13_prefix_trie,
    )
    return {q.__name__: q for q in queries}


def statements() -> dict[str, str]:
    return {
        "op1_decontaminate": decontaminate.SQL,
        "op3_line_dedup": line_dedup.SQL,
        "op5_substring_dedup": substring_dedup.SQL,
        "op9_warc": warc.SQL,
        "op11_minhash": minhash.SQL,
        "op12_spelling": spelling.SQL,
        "op13_prefix_trie": prefix_trie.SQL,
    }
