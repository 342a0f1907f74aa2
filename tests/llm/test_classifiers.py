"""Quality, toxicity and language: held-out accuracy, and the awkward rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirespark.llm.language import LanguageProfiles, fit_languages, identify_languages, keep_named, ngrams, ranked
from quirespark.llm.quality import QualityModel, fit_quality, keep_quality, score_quality, terms
from quirespark.llm.toxicity import Chain, Linear, Rows, features, fit_toxicity, score_toxicity
from tests.llm.helpers import DOCS, awkward, clash, fold

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    rows = score_quality(docs, fit_quality(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    assert all(fold(r["doc_id"]) == 2 for r in rows)
    good = [r["predicted"] for r in rows if r["quality"] == 1]
    bad = [r["predicted"] for r in rows if r["quality"] == 0]
    assert np.mean(good) >= 0.98 and np.mean(bad) <= 0.15


def test_held_out_labels_are_not_learned(tables):
    docs, labels = tables
    lied = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = fit_quality(docs, labels), fit_quality(docs, lied)
    assert np.array_equal(a.labels, b.labels) and np.allclose(a.weight, b.weight)


def test_equal_cosines_count_in_the_order_of_learning():
    x = np.eye(6, 12, dtype=np.float32).repeat(5, 0)
    model = QualityModel.fit(x, np.arange(30) % 5 < 2, rank=6, neighbours=2, sharpness=20.0)
    for block in (3, 7, 100):
        assert np.allclose(model.score(np.eye(6, 12, dtype=np.float32), block), 1.0)


def test_axes_are_the_leading_singular_vectors():
    rng = np.random.default_rng(1)
    x = rng.random((30, 20)).astype(np.float32)
    model = QualityModel.fit(x, np.arange(30) % 2, rank=5, neighbours=3, sharpness=20.0)
    idf = np.log(31 / (1 + (x > 0).sum(0))) + 1
    a = x * idf / np.linalg.norm(x * idf, axis=1, keepdims=True)
    right = np.linalg.svd(a, full_matrices=False)[2][:5]
    assert np.allclose(np.abs((model.axes.T * right).sum(1)), 1, atol=1e-3)


def test_votes_equal_brute_force():
    rng = np.random.default_rng(0)
    x, y, z = rng.random((40, 30)).astype(np.float32), rng.integers(0, 2, 40), rng.random((9, 30)).astype(np.float32)
    model = QualityModel.fit(x, y, rank=8, neighbours=5, sharpness=20.0)
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    mine = unit(unit(z * model.weight) @ model.axes)
    for block in (3, 7, 100):
        got = model.score(z, block)
        for row, s in zip(mine, got):
            cosine = model.vectors @ row
            best = np.argsort(-cosine)[:5]
            pull = np.exp(20 * (cosine[best] - cosine[best].max()))
            assert abs((pull * y[best]).sum() / pull.sum() - s) < 1e-4


def test_toxicity_on_held_out_rows(tables):
    docs, labels = tables
    chain = fit_toxicity(docs, labels, {"junk": "1 - quality", "toxic": "toxic"})
    rows = score_toxicity(docs, chain).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] for r in rows if not r["toxic"]]) <= 0.03
    assert np.mean([r["predicted"] for r in rows if r["toxic"]]) >= 0.5  # thirty toxic texts to learn from


def test_chain_equals_brute_force():
    """Each category by itself: folds, out-of-fold probabilities, and the models on dense rows."""
    rng = np.random.default_rng(9)
    y = np.c_[rng.integers(0, 2, 300), rng.integers(0, 2, 300)].astype(float)
    y[::17, 1] = np.nan
    texts = [np.unique(np.r_[rng.integers(0, 60, 8), [90 + int(v)] * 1]).astype(np.int32) for v in y[:, 0]]
    rows, folds = Rows.of(texts), np.arange(300) % 3
    chain = Chain.fit(["a", "b"], rows, y, folds, 40)

    def plain(model, t, before):
        odds = sum(float(model.weights[f]) for f in t) + sum(p * w for p, w in zip(before, model.earlier)) + model.bias
        return 1 / (1 + np.exp(-min(max(odds, -30), 30)))

    held = np.zeros(300)
    for f in range(3):
        learn = [i for i in range(300) if i % 3 != f]
        part = Linear.fit(Rows.of([texts[i] for i in learn]), np.zeros((200, 0)), y[learn, 0], 40)
        for i in range(f, 300, 3):
            held[i] = plain(part, texts[i], [])
    known = [i for i in range(300) if y[i, 1] == y[i, 1]]
    first = Linear.fit(rows, np.zeros((300, 0)), y[:, 0], 40)
    second = Linear.fit(Rows.of([texts[i] for i in known]), held[known, None], y[known, 1], 40)
    wanted = []
    for t in texts:
        p = plain(first, t, [])
        wanted.append((p, plain(second, t, [p])))
    assert np.allclose(chain.predict(rows), wanted, atol=1e-6)


def test_chain_hands_earlier_probabilities_on():
    """The second category is the first one's, so its model has to use the first's probability."""
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 600).astype(float)
    rows = Rows.of([np.unique(np.r_[rng.integers(0, 200, 6), [7777] if v else [8888]]).astype(np.int32) for v in y])
    chain = Chain.fit(["a", "b"], rows, np.c_[y, y], np.arange(600) % 3, 50)
    p = chain.predict(rows)
    assert ((p[:, 1] > 0.5) == (y == 1)).mean() > 0.99 and chain.models[1].earlier[0] > 0
    assert Linear.fit(rows, np.zeros((600, 0)), np.ones(600), 10).bias > 0


def test_language_on_held_out_rows(tables):
    docs, _ = tables
    rows = identify_languages(docs, fit_languages(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_profiles_equal_brute_force():
    texts = {"x": "the cat and the hat and the bat", "y": "der hund und die katze und der hut"}
    rows = [(lang, int(g), n) for lang, t in texts.items() for n, g in enumerate(ranked(*ngrams(t), 50))]
    model = LanguageProfiles.build(rows, 50)
    for text in ("the hat", "und die", "katze the"):
        mine = ranked(*ngrams(text), 50).tolist()
        far = {}
        for lang in texts:
            place = {g: n for k, g, n in rows if k == lang}
            far[lang] = sum(abs(place[g] - n) if g in place else 50 for n, g in enumerate(mine))
        assert model.predict(text)[0] == min(sorted(far), key=far.get)


def test_language_profiles_learn_by_join_alike(spark, tables):
    docs, _ = tables
    a, b = fit_languages(docs, sample=40), fit_languages(docs, sample=40, few=0)
    assert a.languages == b.languages and np.array_equal(a.grams, b.grams) and np.array_equal(a.place, b.place)


def test_awkward_rows(spark):
    docs = clash(spark.createDataFrame(awkward(), DOCS))
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(12)] + [(0, None, None), (1, 0, 1), (None, 1, 1)], LABELS)
    n = docs.count()
    quality = score_quality(docs, fit_quality(docs, labels)).collect()
    assert len(quality) == n and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in quality)
    langs = identify_languages(docs, fit_languages(docs)).collect()
    named = {r["doc_id"]: r["lang_pred"] for r in langs}
    assert len(langs) == n and named[0] == named[1] == named[2] == named[13] == named[14] == "und" and named[7] == "en"
    toxic = score_toxicity(docs, fit_toxicity(docs, labels, {"junk": "1 - quality", "toxic": "toxic"})).collect()
    assert len(toxic) == n and all(0 <= r["p_toxic"] <= 1 for r in toxic)


def test_nothing_to_learn_from_and_empty_tables(spark):
    docs, none = spark.createDataFrame(awkward(), DOCS), spark.createDataFrame([], LABELS)
    assert {r["score"] for r in score_quality(docs, fit_quality(docs, none)).collect()} == {0.5}
    assert {r["predicted"] for r in score_toxicity(docs, fit_toxicity(docs, none, {"toxic": "toxic"})).collect()} == {0}
    empty = spark.createDataFrame([], DOCS)
    assert score_quality(empty, fit_quality(empty, none)).count() == 0
    assert identify_languages(empty, fit_languages(empty)).count() == 0
    assert {r["lang_pred"] for r in identify_languages(docs, fit_languages(empty)).collect()} == {"und"}


TAKEN = ["score", "predicted", "held_out", "lang_pred", "p_lang", "p_score", "__score", "__copies", "__copy", "fingerprint", "component_id", "k0", "text_", "a.b", "c`d"]


def test_kept_columns_may_have_any_names(spark):
    docs = spark.createDataFrame(awkward(), DOCS).select("*", *[F.lit(f"v{i}").alias(c) for i, c in enumerate(TAKEN)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], LABELS)
    model, profiles = fit_quality(docs, labels), fit_languages(docs)
    plain = {r["doc_id"]: r["score"] for r in score_quality(docs, model).collect()}
    made = score_quality(docs, model, keep=docs.columns)
    assert made.columns == docs.columns + ["held_out_", "score_", "predicted_"]
    assert all(r["score"] == "v0" and abs(r["score_"] - plain[r["doc_id"]]) < 1e-4 for r in made.collect())
    kept = keep_quality(docs, model)
    good = [tuple(r)[: len(docs.columns)] for r in made.collect() if r["predicted_"]]
    assert kept.columns == docs.columns and sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, good))
    named = identify_languages(docs, profiles, keep=docs.columns)
    assert named.columns == docs.columns + ["held_out_", "lang_pred_", "score_"]
    kept = keep_named(docs, profiles)
    assert kept.columns == docs.columns and kept.count() == named.where("lang_pred_ <> 'und'").count() > 0


def test_features_read_whole_texts():
    long = "word " * 50000
    assert not np.array_equal(features(long), features(long + "unusual"))
    assert not np.array_equal(terms(long), terms(long + "#### %%%%"))
