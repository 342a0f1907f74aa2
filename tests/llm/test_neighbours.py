from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirespark.llm.neighbours import Setting, choose, hilbert, nearest, search

VECS = "vec_id long, embedding array<float>, label int"


def brute(vectors: dict, asked: list, k: int):
    ids = np.array(sorted(vectors))
    x = np.array([vectors[i] for i in ids], np.float32).astype(np.float64)
    out = {}
    for q in asked:
        s = (x * x[ids == q]).sum(1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out[q] = [int(ids[i]) for i in order]
    return out


def lists(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def asks():
    return F.pmod("vec_id", F.lit(20)) == 0


def test_scan_is_exact_and_odd_vectors_take_no_part(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist(), 0) for i in range(300)]
    rows[5] = (5, None, 0)
    rows[20] = (20, [0.0] * 8, 0)
    rows[40] = (40, [float("nan")] * 8, 0)
    rows[60] = (60, [float("inf")] + [1.0] * 7, 0)
    rows[61] = (61, [None] + [1.0] * 7, 0)
    rows[62] = (62, [1.0] * 5, 0)
    rows[63] = (63, [], 0)
    rows += [(400 + i, rows[100][1], 1) for i in range(70)] + [rows[80], (None, rows[7][1], 1)]
    df = spark.createDataFrame(rows, VECS).withColumn("score", F.lit(1)).withColumn("id", F.lit("x"))
    good = {r[0]: r[1] for r in rows if r[0] is not None and r[0] not in (5, 20, 40, 60, 61, 62, 63)}
    wanted = brute(good, [i for i in good if i % 20 == 0], 20)
    assert lists(nearest(df, asks(), block=50, chunk=4)) == wanted


def test_few_candidates_and_empty(spark):
    rows = [(i, [1.0, float(i)], 0) for i in range(3)]
    assert lists(nearest(spark.createDataFrame(rows, VECS), asks())) == {0: [1, 2]}
    assert nearest(spark.createDataFrame([], VECS), asks()).count() == 0


def clustered(n=4000, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(100, 12))
    return (centres[rng.integers(0, 100, n)] + 0.1 * rng.normal(size=(n, 12))).astype(np.float32)


def calibrated(spark, x, **options):
    """search() as nearest() calls it, with the setting that it chose."""
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECS)
    clean = rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), asks().alias("asks"))
    given = dict(k=20, recall=0.95, curves=8, block=8192, chunk=4096, fit_rows=4096, fit_queries=128, setting=None, exact_pairs=10**13)
    return search(clean, x.shape[1], **{**given, **options})


def recall(df, x):
    found = lists(df)
    wanted = brute({i: v.tolist() for i, v in enumerate(x)}, [i for i in range(len(x)) if i % 20 == 0], 20)
    assert set(found) == set(wanted)
    return np.mean([len(set(found[q]) & set(w)) / 20 for q, w in wanted.items()])


def test_calibration_takes_curves_on_clustered_vectors(spark):
    """Few vectors, so that no switch by size could hide the method: curves, recall and share read."""
    x = clustered()
    df, chosen = calibrated(spark, x, block=400, chunk=50)
    assert chosen.curves > 0 and chosen.cost < 0.6
    assert recall(df, x) >= 0.9


def test_windows_are_rows_not_blocks(spark):
    """With windows of half the order every vector is met, whatever the blocks; of a few rows, few are."""
    x = clustered(1500)
    whole, _ = calibrated(spark, x, setting=Setting(1, 1.0, 1.0), block=200)
    assert recall(whole, x) == 1.0
    narrow, _ = calibrated(spark, x, setting=Setting(2, 0.002, 0.01), block=200)
    assert 0.1 < recall(narrow, x) < 0.9


def test_even_vectors_are_searched_exactly_or_refused(spark):
    x = np.random.default_rng(3).normal(size=(600, 64)).astype(np.float32)
    df, chosen = calibrated(spark, x)
    assert chosen.curves == 0 and recall(df, x) == 1.0
    with pytest.raises(ValueError, match="exact_pairs"):
        calibrated(spark, x, exact_pairs=1000)


def test_choose_takes_the_cheapest_that_holds_the_recall():
    sample = np.arange(1000)[:, None].repeat(3, 1)
    asked = np.full((100, 3), 500)
    near = np.stack([np.r_[np.full(90, 510), np.full(10, 900)], np.r_[np.full(90, 900), np.full(10, 505)], np.full(100, 999)], 1)
    one = choose(asked, near, sample, 0.85)
    both = choose(asked, near, sample, 0.99)
    assert one.curves == 1 and 0.01 <= one.width < 0.06 and both.curves == 2 and both.cost == 4 * both.width
    assert choose(asked, np.full((100, 3), 999), sample, 0.9).curves == 0


def test_vectors_of_another_length_are_searched_among_their_own(spark):
    rows = [(i, [1.0, float(i)], 0) for i in range(25)] + [(100 + i, [1.0, 2.0, float(i)], 0) for i in range(3)]
    found = lists(nearest(spark.createDataFrame(rows, VECS), asks()))
    assert found[100] == [101, 102] and found[20][:2] == [24, 23] and len(found[0]) == 20


def test_hilbert_visits_every_cell_step_by_step():
    for n, bits in ((2, 3), (3, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
        order = np.argsort(hilbert(cells, bits))
        assert len(set(hilbert(cells, bits))) == len(cells)
        assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()
