from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from quirespark.llm.nearcopies import copy_groups, forest, shingles, similar
from tests.llm.copies import brute
from tests.llm.helpers import DOCS, awkward, clash, long_text


def edited(n=80):
    """Texts with 1 to 5 changed words of 125: similarities of 0.65 to 0.92 to their source."""
    out = []
    for i in range(n):
        words = long_text(100 + i, 125).split()
        out.append((1000 + 2 * i, " ".join(words), None, None, None))
        for at in random.Random(i).sample(range(125), 1 + i % 5):
            words[at] = f"new{at}"
        out.append((1001 + 2 * i, " ".join(words), None, None, None))
    return out


def found(df, **k):
    return sorted((str(r["doc_id"]), str(r["component_id"])) for r in copy_groups(df, **k).collect())


def test_groups_equal_brute_force_also_in_blocks(spark):
    docs = awkward() + edited()
    df = clash(spark.createDataFrame(docs, DOCS))
    assert found(df) == found(df, group=2) == brute(docs)
    assert found(spark.createDataFrame([], DOCS)) == []


def test_fingerprints_link_as_well(spark):
    """Texts of one word order but other sets of words: equal fingerprints alone join them."""
    base = long_text(3, 40)
    pairs = [(1, base), (2, base + " " + base), (3, base + " " + base + " " + base), (4, long_text(5, 40))]
    docs = [(i, t, None, None, None) for i, t in pairs]
    assert found(spark.createDataFrame(docs, DOCS)) == brute(docs)
    from pyspark.sql import functions as F

    from quirespark.llm.nearcopies import _print_edges

    rows = spark.createDataFrame([(5, 10), (5, 11), (6, 12), (7 << 40, 13), ((7 << 40) + 8, 14)], "fp long, node long")
    # 5 and 6 differ in two bits, the last two in one; none of the others is near.
    links = {tuple(sorted(r)) for r in _print_edges(rows).where(F.col("a") != F.col("b")).collect()}
    assert links == {(10, 11), (10, 12), (13, 14)}


def test_forest_and_similarity():
    sets = [np.sort(np.unique(np.random.default_rng(i).integers(0, 40, 30).astype(np.uint64))) for i in range(40)]
    near = [(i, j) for i in range(40) for j in range(i) if similar(sets[i], sets[j], 0.5)]
    assert near == [(i, j) for i in range(40) for j in range(i) if 2 * len(set(sets[i]) & set(sets[j])) >= len(set(sets[i]) | set(sets[j]))]
    of = {k: k for k in range(40)}
    links = forest(sets, 0.5)
    for p, q in links:
        assert (max(p, q), min(p, q)) in near
        p, q = of[p], of[q]
        of = {k: min(p, q) if v in (p, q) else v for k, v in of.items()}
    assert all(of[i] == of[j] for i, j in near)
    assert len(shingles("a b c")) == 1 and len(shingles(" ")) == 0


def test_stage_removes_texts_of_one_changed_word(spark):
    docs = [d for k, d in enumerate(edited()) if k // 2 % 5 == 0]
    kept = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(docs, DOCS), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d[0] for d in docs if d[0] % 2 == 0)


def test_stage_keeps_unlinked_texts_of_one_id_and_meets_null_ids(spark):
    a, b, c, d = (long_text(s, 60) for s in (1, 2, 3, 4))
    docs = [(7, a), (7, b), (7, a), (5, c), (7, c), (None, d), (None, d), (None, b), (9, a)]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOCS)
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, df, "").collect()]
    assert len(kept) == 4 and set(kept) == {(7, a), (7, b), (5, c), (None, d)}


def test_stage_drops_a_planted_near_copy(spark):
    """doc_id 145 copies 6 at a similarity of 0.83."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()}
    assert 6 in kept and 145 not in kept and kept == {int(i) for i, c in brute([(r["doc_id"], r["text"]) for r in docs.collect()]) if i == c}
