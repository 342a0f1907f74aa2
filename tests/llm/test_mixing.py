from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from quirespark.llm.mixing import by_length, mix_sources, repeat_copies, source_targets
from tests.llm.helpers import DOCS, awkward, clash, long_text

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes: dict, cap=3.0):
    """Brute force: share what is left by weight until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1.0 + i % 3 for i, s in enumerate(order)}
    got, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] >= cap * sizes[s]}
        if not over:
            return got | {s: share * weight[s] for s in open_}
        for s in over:
            got[s] = cap * sizes[s]
        left -= sum(got[s] for s in over)
        open_ -= over
    return got


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 5, "c": 700, None: 40}, {"a": 0, "b": 10}, {"a": 0}, {"z": 9}, {f"s{i}": i * i for i in range(30)}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    found = {r["source"]: r["target"] for r in source_targets(rows).collect()}
    wanted = targets(sizes)
    assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 1e-6 for k in wanted)
    assert abs(sum(found.values()) - sum(sizes.values())) < 1e-6


def test_awkward_rows(spark):
    df = clash(spark.createDataFrame(awkward(), DOCS))
    rows = mix_sources(df).collect()
    assert len(rows) == df.count()
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert rows.__class__ is list and sorted(map(str, rows)) == sorted(map(str, mix_sources(df).collect()))
    sizes = {(d[0], d[1]): len(WORD.findall(d[1] or "")) for d in awkward()}
    assert sorted(r["size"] for r in rows) == sorted(len(WORD.findall(d[1] or "")) for d in awkward())
    assert sizes[(0, None)] == 0


def test_taken_words_come_near_the_target(spark):
    docs = [(i, long_text(i, 5 + i * 31 % 90), None, "hot" if i % 3 == 0 else f"s{i % 7}", None) for i in range(2000)]
    rows = mix_sources(spark.createDataFrame(docs, DOCS), buckets=16).collect()
    by = {}
    for r in rows:
        t = by.setdefault(r["source"], [0, r["target"]])
        t[0] += r["taken"]
    assert all(abs(taken - target) <= 95 for taken, target in by.values())


def test_salted_join_gives_the_same(spark):
    docs = spark.createDataFrame([(i, long_text(i, 9), None, None if i % 5 == 0 else f"s{i % 4}", None) for i in range(300)], DOCS)
    a = sorted(map(str, mix_sources(docs, keep=docs.columns).collect()))
    assert a == sorted(map(str, mix_sources(docs, keep=docs.columns, few_sources=0).collect()))


def test_importance_changes_the_odds_within_a_source(spark):
    docs = [(i, "w " * 10, None, "ab"[i % 2], i % 4 // 2) for i in range(4000)]
    df = spark.createDataFrame(docs, DOCS).withColumn("importance", 1.0 + 3.0 * F.col("n_chars"))
    rows = {r["doc_id"]: r for r in mix_sources(df, importance="importance").collect()}
    for source in "ab":
        mine = [rows[i] for i in rows if "ab"[i % 2] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 10
    mean = lambda heavy: sum(rows[i]["copies"] for i in rows if i % 4 // 2 == heavy and i % 2 == 0) / 1000
    assert 3.2 < mean(1) / mean(0) < 4.8
    none = mix_sources(df.withColumn("importance", F.lit(None)), importance="importance").collect()
    assert {r["copies"] for r in none} == {0}


def expected_copies(docs, goal, cap=3.0):
    """Brute force: a source's ratio by halving, until its words reach its target. docs: (source, size, weight)."""
    out = {}
    for source in goal:
        mine = [(n, w) for s, n, w in docs if s == source]
        words = lambda r: sum(n * min(r * w, cap) for n, w in mine)  # noqa: B023, E731
        low, high = 0.0, 1e6
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if words(mid) < goal[source] else (low, mid)
        out[source] = high
    return out


def test_inclusion_rates_are_the_expected_copies(spark):
    """Fragments, documents and long documents of one source are taken at rates of 1 : 2 : 4, up to the cap."""
    kinds = (20, 100, 600)
    docs = [(i, "w " * kinds[i % 3], None, "abcd"[i % 4], None) for i in range(9000)]
    rows = mix_sources(spark.createDataFrame(docs, DOCS), importance=by_length(F.col("text"))).collect()
    facts = [(r["source"], r["size"], {20: 0.5, 100: 1.0, 600: 2.0}[r["size"]]) for r in rows]
    goal = {r["source"]: r["target"] for r in rows}
    ratio = expected_copies(facts, goal)
    for source in "abcd":
        assert abs(sum(r["taken"] for r in rows if r["source"] == source) - goal[source]) <= 600
        for n, w in ((20, 0.5), (100, 1.0), (600, 2.0)):
            copies = [r["copies"] for r in rows if r["source"] == source and r["size"] == n]
            assert abs(sum(copies) / len(copies) - min(ratio[source] * w, 3.0)) < 0.06 and max(copies) <= 3


def test_capped_sources_reach_their_target_with_importance(spark):
    docs = [(i, "w " * (20 if i % 2 else 600), None, "tiny" if i < 40 else "big", None) for i in range(4000)]
    rows = mix_sources(spark.createDataFrame(docs, DOCS), weights=(1, 100), importance=by_length(F.col("text"))).collect()
    assert {r["copies"] for r in rows if r["source"] == "tiny"} == {3}


def test_copies_keep_columns_of_any_name(spark):
    taken = ["__copies", "__copy", "copies", "copy", "size", "k0", "taken", "weight", "a.b"]
    docs = spark.createDataFrame(awkward(), DOCS).select("*", *[F.lit(c).alias(c) for c in taken])
    made = mix_sources(docs, keep=docs.columns)
    assert made.columns == [*docs.columns, "size_", "source_size", "target", "copies_", "taken_"]
    again = repeat_copies(docs)
    assert again.columns == docs.columns and again.count() == sum(r["copies_"] for r in made.collect())


def test_empty_table(spark):
    assert mix_sources(spark.createDataFrame([], DOCS)).count() == 0
