"""The pipeline against a version that works on plain lists, and what is registered."""

from __future__ import annotations

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from quirespark.llm.language import fit_languages
from quirespark.llm.mixing import uniform
from quirespark.llm.quality import fit_quality, terms
from tests.llm.test_mixing import WORD, targets
from tests.llm.copies import brute as brute_copies
from tests.llm.test_packing import check

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and [s[0] for s in corpus_pipeline.STAGES]


def ratio_of(mine, goal, cap=3.0):
    """(size, weight) pairs of a source: lower classes share what the capped ones leave."""
    open_ = list(mine)
    for top in sorted({w for _, w in mine}, reverse=True):
        capped = sum(n for n, w in mine if w > top)
        mass = sum(n * w for n, w in open_)
        if mass and (goal - cap * capped) / mass * top < cap:
            return (goal - cap * capped) / mass
        open_ = [(n, w) for n, w in open_ if w != top]
    return float("inf")


def mixed(docs, spark):
    sizes = [len(WORD.findall(d["text"] or "")) for d in docs]
    heavy = [0.5 if s < 50 else 1.0 if s < 500 else 2.0 for s in sizes]
    by = {}
    for d, s in zip(docs, sizes):
        by[d["source"]] = by.get(d["source"], 0) + s
    goal = targets(by)
    draws = dict(spark.createDataFrame([(d["doc_id"],) for d in docs], "id long").select("id", uniform(F.col("id"))).collect())
    out = []
    for source in by:
        mine = [(d, s, w) for d, s, w in zip(docs, sizes, heavy) if d["source"] == source]
        ratio = ratio_of([(s, w) for _, s, w in mine], goal[source])
        hopes = [min(ratio * w, 3.0) for _, _, w in mine]
        missing, at, ranked = goal[source] - sum(int(h) * s for h, (_, s, _) in zip(hopes, mine)), 0, []
        for h, (d, s, _) in zip(hopes, mine):
            u, p = draws[d["doc_id"]], h - int(h)
            ranked.append(((u / (1 - u)) / (p / (1 - p)) if p else float("inf"), d["doc_id"], s, int(h), d))
        for rank, _, s, certain, d in sorted(ranked, key=lambda x: x[:3]):
            out += [d] * (certain + (rank < float("inf") and at + s / 2 < missing))
            at += s
    return out


def test_run_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = fit_quality(docs, labels)
    rows = [d for d in docs.collect() if model.score(np.stack([terms(d["text"])]))[0] >= 0.7]
    kept = spark.createDataFrame(rows, docs.schema)
    profiles = fit_languages(kept)
    named = [profiles.predict(d["text"]) for d in rows]
    rows = [d for d, (lang, _) in zip(rows, named) if lang != "und"]
    first = {i for i, c in brute_copies([(d["doc_id"], d["text"]) for d in rows]) if i == c}
    rows = [d for d in rows if str(d["doc_id"]) in first]
    rows = mixed(rows, spark)
    packed = corpus_pipeline.run(spark, SF).collect()
    used = check(packed, [(d["doc_id"], d["text"]) for d in rows], Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    assert used <= -(-sum(r["length"] for r in packed) // 1024) + 2


TAKEN = ["score", "predicted", "held_out", "lang_pred", "p_lang", "p_score", "__score", "__copies", "__copy", "__hash", "__id", "text_hash",
         "fingerprint", "component_id", "component", "copies", "size", "k0", "a.b"]


def test_stages_keep_columns_of_any_name_and_survive_odd_rows(spark, tmp_path):
    from tests.llm.helpers import DOCS, awkward, clash

    odd = clash(spark.createDataFrame(awkward(), DOCS))
    odd.select("*", *[F.lit(f"v{i}").alias(c) for i, c in enumerate(TAKEN) if c not in odd.columns]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if n < 4:
            assert out.columns == docs.columns
            rows = out.collect()
            assert rows and all(r["score"] == "x" and r["predicted"] == "v1" and r["a.b"] == f"v{len(TAKEN) - 1}" for r in rows)
            docs = spark.createDataFrame(rows, docs.schema)
    assert out.count() > 0
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "e/documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "e/labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "e")).count() == 0
