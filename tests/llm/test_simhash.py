from __future__ import annotations

import numpy as np
import xxhash

from quirespark.llm.simhash import fingerprint, forest, simhash_groups
from tests.llm.helpers import DOCS, awkward, clash, long_text


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 0))] or ([b" ".join(words)] if words else [])
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(shingles))


def brute(docs):
    prints = [brute_print(d[1]) for d in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {g: min((docs[i][0] for i in range(len(docs)) if group[i] == g and docs[i][0] is not None), default=None) for g in set(group)}
    return sorted((str(d[0]), f"{p:016x}", str(least[g])) for d, p, g in zip(docs, prints, group))


def found(df, **k):
    return sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash_groups(df, **k).collect())


def near_copies():
    base = [long_text(9, 300).split() for _ in range(1)][0]
    docs = []
    for i in range(90):
        words = list(base)
        words[(i * 3) % 300] = f"new{i}"
        docs.append((1000 + i, " ".join(words), None, None, None))
    return docs


def test_awkward_rows_and_near_copies(spark):
    docs = awkward() + near_copies() + [(500 + i, long_text(50 + i, 40), None, None, None) for i in range(60)]
    assert found(clash(spark.createDataFrame(docs, DOCS))) == brute(docs)


def test_large_groups_go_through_the_second_equality_step(spark):
    docs = near_copies() + [(3, None, None, None, None), (2, "", None, None, None)]
    assert found(spark.createDataFrame(docs, DOCS), group=3) == brute(docs)


def test_empty_table(spark):
    assert found(spark.createDataFrame([], DOCS)) == []


def test_fingerprint_of_texts():
    for t in ("", None, "a", "A b", "a B c d e f", "ÄÖ ß x y\x0bz", long_text(4, 500)):
        assert fingerprint(t) & (1 << 64) - 1 == brute_print(t)


def test_forest_spans_the_components():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 12, 300).astype(np.int64))
    a, b = forest(x)

    def groups(links):
        of = {v: v for v in x.tolist()}
        for p, q in links:
            p, q = of[p], of[q]
            of = {k: min(p, q) if v in (p, q) else v for k, v in of.items()}
        return of

    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 2
    assert groups(zip(a.tolist(), b.tolist())) == groups([(x[i], x[j]) for i, j in zip(*np.nonzero(near))])
    assert len(a) < len(x)
