"""A corpus pipeline of five stages: each takes the documents that its predecessor left, and all but the last return documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, jaccard_join, line_dedup, mixing, quality_rules
from larkspur.llm.columns import ROW, boxed
from larkspur.llm.store import cut, drop


def chars(text) -> F.Column:
    return F.coalesce(F.length(text), F.lit(0)).cast("bigint")


def renewed(df: DataFrame, docs: DataFrame, text: F.Column) -> DataFrame:
    """The documents' columns from their struct, with another text and its number of characters."""
    new = {"text": text, "n_chars": chars(text)}
    return df.select(*(new.get(c, F.col(ROW).getField(c)).alias(c) for c in docs.columns))


def by_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, unchanged.

    Null and empty texts have no words and go; repeated rows have equal verdicts, so all or none of them stay; there are no ties. An empty table gives an empty
    one. Further columns stay; those named like the operator's results are put back as they were.
    """
    # The operator replaces columns that bear its results' names: the rows travel as one struct beside what it looks at.
    boxes = boxed(docs, (), F.col("text").alias("text"), F.col("lang").alias("lang"))
    kept = quality_rules.quality_rules(boxes).filter("kept")
    return kept.select(*(F.col(ROW).getField(c).alias(c) for c in docs.columns))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line is near to; n_chars is the length of what is left.

    Null texts stay null and empty ones empty; a text all of whose lines go is empty. Of equal lines the one of the least id, digest of the text and line number
    stays; rows that repeat id and text keep the same lines. An empty table gives an empty one. Further columns stay, whatever their names.
    """
    boxes = boxed(docs, (), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    return renewed(line_dedup.line_dedup(boxes), docs, F.col("text"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, and every document that has none, unchanged.

    Texts that are null, empty or without words are in no group, and all stay. Of a group the least id stays (a null id only if there is no other; of rows of that
    id the least digest of the text); of rows that repeat id and text one stays, unless the text has no words. An empty table gives an
    empty one. Further columns stay, whatever their names.
    """
    boxes = boxed(docs, (), F.col("doc_id").cast("bigint").alias("d"), F.xxhash64("text").alias("t"))
    decided = jaccard_join.jaccard_join(docs.select("doc_id", "text")).filter("kept")
    kept = cut(decided.groupBy(F.col("doc_id").alias("kd"), F.col("th").alias("kt")).agg(F.count("*").alias("times"), F.max("n_links").alias("links")))
    joined = boxes.join(kept, F.col("d").eqNullSafe(F.col("kd")) & (F.col("t") == F.col("kt")))
    repeated = (F.col("times") > 1) & (F.col("links") > 0)
    if not kept.filter(repeated).isEmpty():
        joined = joined.filter(~repeated).unionByName(joined.filter(repeated).dropDuplicates(["kd", "kt"]))
    return joined.select(*(F.col(ROW).getField(c).alias(c) for c in docs.columns))


def first_words(text: F.Column, n: F.Column) -> F.Column:
    """The text up to the end of its n-th word, spacing and all; it has more than n words."""
    ahead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    rest = F.element_at(F.split(text, mixing.SEPARATORS, (n + 1 + ahead).cast("int")), -1)
    return F.regexp_replace(F.left(text, F.length(text) - F.length(rest)), r"[\x20\x09-\x0D]+$", "")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents in the order of the schedule: each as often as the mix takes it whole, and once more up to the end of a word where it takes a part.

    What isn't taken goes, and so do null and empty texts, of which there is nothing to take. Rows that repeat id and text share what the mix takes of them all; of
    equal places in the schedule the digest decides. An empty table gives an empty one. Further columns stay, whatever their names.
    """
    taken = mixing.mix(docs.select("doc_id", "text", "source")).filter("taken > 0").groupBy(F.col("row_digest").alias("mh"))
    taken = cut(taken.agg(F.sum("taken").alias("taken"), F.max("size").alias("size"), F.min("first_slot").alias("first"), F.count("*").alias("times")))
    boxes = boxed(docs, (), F.col("text").alias("t"), mixing.digest(F.col("doc_id"), F.col("text")).alias("h"))
    joined = boxes.join(taken, F.col("h") == F.col("mh"))
    # Rows that repeat id and text have one total, which stands once for all of them.
    if not taken.filter("times > 1").isEmpty():
        joined = joined.filter("times = 1").unionByName(joined.filter("times > 1").dropDuplicates(["h"]))
    whole, rest = F.expr("taken div size"), F.expr("taken % size")
    copies = joined.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), whole + F.when(rest > 0, 1).otherwise(0))))
    ordered = copies.orderBy("first", "h", "k")
    return renewed(ordered, docs, F.when(F.col("k") > whole, first_words(F.col("t"), rest)).otherwise(F.col("t")))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, with the digests of ids and decoded bytes.

    Null and empty texts have no ids. Rows are independent, so repeated rows have equal results and nothing ties. An empty table gives an empty one. Further
    columns are left out.
    """
    out = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)
    return out.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", "decoded_sha256", "ids")


STAGES = [
    ("quality rules", by_quality_rules),
    ("line dedup", without_repeated_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("mixing sources", mixed),
    ("byte-level BPE", encoded),
]

#: Chosen paths and the merges of the vocabulary aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; each but the last is written as Parquet and read again. A stage's table goes once the next one is written."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
