"""Registered queries of the corpus operators: thin, over whole tables, digest columns only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import bit_slices, compression_quality, conversations, hard_negatives, jaccard, mixing, neighbours, pieces, ppm, quality_rules, token_files, toxicity, url_filter
from panelforge.llm.common import table


def op1_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents"))


def op2_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"))


def op3_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "source", F.col("mix_copy").alias("copy_no"), F.col("mix_copies").alias("n_copies"), F.col("mix_key").alias("shuffle_key"), "text")


def op5_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.count_documents(table(spark, sf_dir, "documents"))


def op6_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), check=True)
    digest = F.crc32(F.array_join(F.col("piece_ids").cast("array<string>"), ",").cast("binary"))
    return encoded.select("doc_id", F.size("piece_ids").alias("n_pieces"), "n_chunks", digest.alias("ids_crc32"), "decoded_equal")


def op7_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.measure_documents(table(spark, sf_dir, "documents"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op9_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_documents(table(spark, sf_dir, "documents"))


def op10_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return compression_quality.score_documents(docs, compression_quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_slices.search(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(conversations.damaged(table(spark, sf_dir, "conversations")))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), hard_negatives.spread_label(F.col("vec_id"), F.col("label")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ppm_score": op1_ppm_score,
        "op2_multiprobe_neighbours": op2_multiprobe_neighbours,
        "op3_toxic_lexicon": op3_toxic_lexicon,
        "op4_poisson_mixing": op4_poisson_mixing,
        "op5_separator_scan": op5_separator_scan,
        "op6_sentencepiece_scan": op6_sentencepiece_scan,
        "op7_quality_cascade": op7_quality_cascade,
        "op8_url_rules": op8_url_rules,
        "op9_jaccard_components": op9_jaccard_components,
        "op10_compression_quality": op10_compression_quality,
        "op11_bit_sliced_top_k": op11_bit_sliced_top_k,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_hard_negatives": op13_hard_negatives,
    }
