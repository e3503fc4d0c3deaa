"""The corpus pipeline: language ID, line dedup, near-duplicate join, decontamination, SentencePiece encoding.

Stages remove rows, not ids: rows that share an id are told apart by the md5 of their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.llm._spark import Scratch, sized_join
from cairn.llm.decontaminate import contaminated
from cairn.llm.language_crf import identify, train
from cairn.llm.line_dedup import dedup_lines
from cairn.llm.ngram_jaccard import ngram_jaccard_join
from cairn.llm.sentencepiece_codec import encode

#: A document stays if its language has been decided at least this surely.
MIN_SCORE = 0.2
#: Part of a word, as ``cairn.llm._text`` has it.
WORD = r"[\p{L}\p{M}\p{N}]"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that are null, have no letter, or whose language scores under MIN_SCORE; fills in a null ``lang``."""
    model = train(docs)
    seen = identify(docs, model)
    if model is None:  # nothing to learn from: only texts without letters go
        return seen.where("n_words > 0").select(docs.columns)
    kept = seen.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated multi-line chunks, and documents that this leaves without a word (mostly exact copies); ``n_chars`` is that of what is left."""
    out = dedup_lines(docs).where((F.col("lines_removed") == 0) | F.col("text").rlike(WORD))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose (doc_id, md5 of the text) isn't in ``gone``; rows with a null id or text stay."""
    keyed = docs.withColumn("__cairn_md5", F.md5("text"))
    return sized_join(keyed, gone.select("doc_id", F.col("text_md5").alias("__cairn_md5")), ["doc_id", "__cairn_md5"], "left_anti").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of linked documents the one with the smallest id, and the smallest md5 where an id has several texts.

    A row that repeats the kept one's id and text stays with it; rows with a null id or without a word aren't linked and stay.
    """
    scratch = Scratch(spark, "dups")
    found = scratch.table(ngram_jaccard_join(docs, by_text=True).where("n_links > 0").select("doc_id", "text_md5", "component"), "linked")
    place = F.struct("doc_id", "text_md5")
    first = found.groupBy("component").agg(F.min(place).alias("first"))
    gone = scratch.table(found.join(first, "component").where(place != F.col("first")).select("doc_id", "text_md5").distinct(), "gone")
    scratch.drop(found)
    return _without(docs, gone)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a benchmark passage."""
    found = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), by_text=True)
    return _without(docs, Scratch(spark, "leaks").table(found.select("doc_id", "text_md5").distinct(), "gone"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_crc32, round_trip, differing`` of each document."""
    return encode(docs).select("doc_id", "n_tokens", "ids", "ids_crc32", "round_trip", "differing")


STAGES = [("language ID", language), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("SentencePiece encoding", encoding)]

#: The language model and SentencePiece aren't expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again, and goes when the next one is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
