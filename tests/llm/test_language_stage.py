from __future__ import annotations

import corpus_pipeline
from quirespark.llm.language import fit_languages, identify_languages


def test_stage_keeps_named_documents_of_a_small_margin(spark):
    """doc_id 7493 is the one word 'De.', rightly named fr at a score of 0.501."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    named = identify_languages(docs, fit_languages(docs), keep=docs.columns)
    low = {r["doc_id"] for r in named.where("lang_pred <> 'und' AND score < 0.51").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, "").select("doc_id").collect()}
    assert 7493 in low and low <= kept
    assert len(kept) == named.where("lang_pred <> 'und'").count()
