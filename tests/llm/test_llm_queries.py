"""The registered queries, against DuckDB where SQL can express them, and against the contracts elsewhere."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from oracle import compare, connection  # noqa: E402

from larkspur.llm import registry  # noqa: E402

COLUMNS = {
    "op1_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op2_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op8_language_id": ["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
    "op9_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept_chars", "repeats"],
    "op10_token_counts": ["doc_id", "n_pretokens", "n_tokens"],
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    con = connection(sf)
    if name in registry.ORACLE:
        compare(df, con, registry.ORACLE[name])
    else:
        assert df.columns == COLUMNS[name]
        rows = df.collect()
        assert sorted(r.doc_id for r in rows) == [r[0] for r in con.execute("select doc_id from documents order by 1").fetchall()]


def test_held_out(spark, sf):
    con = connection(sf)
    lang = dict(con.execute("select doc_id, lang from documents").fetchall())
    rows = [r for r in registry.QUERIES["op8_language_id"](spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in rows) >= 0.9 * len(rows)
    quality = dict(con.execute("select doc_id, quality from labels").fetchall())
    rows = [r for r in registry.QUERIES["op1_quality_classifier"](spark, sf).collect() if r.held_out and r.doc_id in quality]
    assert sum(r.predicted == quality[r.doc_id] for r in rows) >= 0.8 * len(rows)
