"""The registered queries, as they are, over a whole small data folder."""

import zlib

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality": {"doc_id", "held_out", "score", "predicted"}, "op4_toxicity": {"doc_id", "held_out", "score", "predicted"}, "op5_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op6_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}, "op7_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op9_neardup": {"doc_id", "n_shingles", "component_id", "kept"}, "op10_substrings": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op12_contamination": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"}, "op13_alignment": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
}


@pytest.mark.parametrize("name", COLUMNS)
def test_every_document_once(spark, name):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())
    rows = __spark_entry__.queries()[name](spark, SF).collect()
    assert COLUMNS[name] <= set(rows[0].asDict()) and sorted(r.doc_id for r in rows) == ids
    if "score" in COLUMNS[name]:
        by, out = (5, 0) if name == "op1_quality" else (4, 2)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % by == out) and r.predicted == int(r.score >= 0.3) for r in rows)


def test_nearest_asks_for_every_hundredth(spark):
    ids = [r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()]
    rows = __spark_entry__.queries()["op8_nearest"](spark, SF).collect()
    assert {r.query_id for r in rows} == {i for i in ids if i % 100 == 0} and all(r.query_id != r.vec_id for r in rows)
