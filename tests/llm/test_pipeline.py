"""The pipeline's stages on small documents."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
from fixtures import documents, frame, prose, words

from larkspur.llm import bpe
from larkspur.llm.store import cut


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    rows = documents() + [(1000 + i, prose(rng, 200) + "\n" + prose(rng, 40), "en", "a", 0) for i in range(20)]
    frame(spark, rows).write.parquet(f"file://{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = cut(stage(spark, docs, str(tmp_path)))
        counts.append(docs.count())
        if name == "byte-level BPE":
            break
        assert docs.columns == columns
        if name == "mixing sources":
            # A document comes as often as it is taken, and its last copy may be a part: the text up to the end of a word.
            whole = {(r.doc_id, r.text) for r in before.collect()}
            texts = {r.doc_id: r.text for r in before.collect()}
            parts = [r for r in docs.collect() if (r.doc_id, r.text) not in whole]
            assert parts and all(texts[r.doc_id].startswith(r.text) and words(texts[r.doc_id])[: len(words(r.text))] == words(r.text) for r in parts)
            total = sum(len(words(r.text)) for r in before.collect())
            assert abs(sum(len(words(r.text)) for r in docs.collect()) - total) <= 4 * 4 * 64
    assert counts[1] < counts[0] and counts[1] == counts[2] and counts[3] <= counts[2]
    ranks = {x: i for i, x in enumerate(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = Counter((r.doc_id, tuple(encoding.encode_ordinary(r.text))) for r in before.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in docs.collect()) == expected
    assert np.all([r.n_tokens == len(r.ids) for r in docs.collect()])
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == counts[-1]


def test_one_of_each_group(spark):
    rng = random.Random(13)
    base = prose(rng, 120)
    rows = [(1, base, None, None, None), (2, base, None, None, None), (2, base, None, None, None), (3, base + " end", None, None, None), (4, prose(rng, 120), None, None, None), (5, "", None, None, None), (6, "", None, None, None)]
    got = corpus_pipeline.one_of_each_group(spark, frame(spark, rows), "")
    assert sorted(r.doc_id for r in got.collect()) == [1, 4, 5, 6]
    twins = [(1, base, None, None, None)] * 3
    assert corpus_pipeline.one_of_each_group(spark, frame(spark, twins), "").count() == 1


def test_clashing_names(spark):
    """Further columns with the names of results and inner columns go through all stages that return documents."""
    from pyspark.sql import functions as F

    names = ["kept", "row", "rows", "n_lines", "n_dropped", "dropped", "links", "times", "taken", "__taken", "__h", "h", "k", "t", "d", "size", "first", "n_words"]
    docs = frame(spark, documents()).withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.columns == docs.columns, name
        assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for r in got.collect() for c in names), name
        assert stage(spark, docs.limit(0), "").count() == 0


def test_first_words(spark):
    from pyspark.sql import functions as F

    rows = [("  a\n\tb  c d ", 2, "  a\n\tb"), ("a b", 1, "a"), ("a  b c", 2, "a  b"), ("\nx y\nz", 1, "\nx")]
    df = spark.createDataFrame(rows, "t string, n int, e string").select(corpus_pipeline.first_words(F.col("t"), F.col("n")).alias("g"), "e")
    assert all(r.g == r.e for r in df.collect())
