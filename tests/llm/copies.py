"""Brute force for near copies, over all pairs: similar sets of five-word shingles, or fingerprints of two or fewer differing bits."""

from __future__ import annotations

from quirespark.llm.simhash import fingerprint


def words_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def brute(docs):
    sets = [words_set(d[1]) for d in docs]
    prints = [fingerprint(d[1]) & (1 << 64) - 1 for d in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) or (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    least = {g: min((d[0] for d, x in zip(docs, group) if x == g and d[0] is not None), default=None) for g in set(group)}
    return sorted((str(d[0]), str(least[g])) for d, g in zip(docs, group))
