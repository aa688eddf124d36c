"""The queries of the ten operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, embedding_dedup, jaccard_join, language_id, line_dedup, mixing, quality_classifier, quality_rules, suffix_dedup, token_counts

from larkspur.llm.oracles import ORACLE

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query
def op2_byte_bpe(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op10_token_counts(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select("doc_id", "n_pretokens", "n_tokens")


@query
def op7_mixing(spark, sf):
    return mixing.mix(read(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")


@query
def op6_quality_rules(spark, sf):
    return quality_rules.quality_rules(read(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def fold(folds: int):
    """The fold of a row by its id; null has none."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))


@query
def op8_language_id(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.filter(fold(5) != 0))
    held = docs.select("doc_id", "text", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"))
    return language_id.predict(held, model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@query
def op1_quality_classifier(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    network = quality_classifier.train(docs.filter(fold(3) != 1), read(spark, sf, "labels").select("doc_id", "quality").filter(fold(3) != 1))
    held = docs.select("doc_id", "text", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"))
    return quality_classifier.score(held, network).select("doc_id", "held_out", "score", "predicted")


@query
def op3_line_dedup(spark, sf):
    docs = line_dedup.line_dedup(read(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op4_embedding_dedup(spark, sf):
    return embedding_dedup.embedding_dedup(read(spark, sf, "embeddings"))


@query
def op5_jaccard_join(spark, sf):
    return jaccard_join.jaccard_join(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "class_id", "n_links", "component_id", "kept")


@query
def op9_suffix_dedup(spark, sf):
    return suffix_dedup.suffix_dedup(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept_chars", "repeats")
