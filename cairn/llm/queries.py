"""The registered queries of the corpus operators: thin calls with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.llm import decontaminate, elkan, html_blocks, language_crf, line_dedup, merkle, metric_join, ngram_jaccard, repair_tokens, schema_rewrite, secret_cnn, sentencepiece_codec, warc_index
from cairn.llm.oracles import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_tokens.tokens(_table(spark, sf_dir, "documents")).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_cnn.scan(_table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(_table(spark, sf_dir, "pages"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_index.archive(_table(spark, sf_dir, "pages"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_crf.language_id(_table(spark, sf_dir, "documents"))


def op7_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_join.metric_join(_table(spark, sf_dir, "embeddings"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(_table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ids_crc32", "round_trip", "differing")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "lines_removed", "chunks_removed")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_schema_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_rewrite.schema_rewrite(_table(spark, sf_dir, "clients"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_fingerprints(_table(spark, sf_dir, "documents"))


def op13_elkan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return elkan.clusters(_table(spark, sf_dir, "embeddings")).drop("computed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_repair, op2_secret_scan, op3_html_text, op4_ngram_jaccard, op5_warc, op6_language_id, op7_metric_join, op8_sentencepiece, op9_line_dedup, op10_decontamination, op11_schema_rewrite, op12_merkle, op13_elkan)}


def oracle_sql() -> dict[str, str]:
    return ORACLES
