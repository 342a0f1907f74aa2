"""SimHash near-duplicates by deletion-variant signatures.

Two 64-bit fingerprints that differ in at most two bits differ in at most one bit in one of
their 32-bit halves. Each half is indexed under its 32 one-wildcard variants (one bit left
out), so such a pair shares a key; equal keys meet by an equality shuffle and are verified
on all 64 bits. Copies are folded into one fingerprint before any of this.

Inside a key's group only a spanning forest of the verified links is emitted, never all
pairs. A group beyond ``GROUP`` distinct fingerprints is not held in a task: its rows go
through a second equality step, whose keys leave out two bits of all 64, so that all that
share one are linked without any comparison.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm._common import connected_components, materialise, named

GROUP = 20_000
_SEED = 42


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit majority fingerprint of a whole text; zero if it holds no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), _SEED)).astype(np.int64))
    line = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = (end - size)[: len(words) - shingle + 1].tolist()
    digest, votes, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(begin)
    end = end[shingle - 1 :].tolist()
    for at in range(0, total, 65536):
        h = np.array(
            [digest(line[i:j], _SEED) for i, j in zip(begin[at : at + 65536], end[at : at + 65536])],
            np.uint64,
        )
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > total, bitorder="little").view(np.int64)[0])


def forest(prints: np.ndarray, distance: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Links (child, parent) that span the components of ``prints`` at that distance."""
    left, right = [], []
    rest = np.unique(prints)
    while len(rest) > 1:
        wave, rest = rest[:1], rest[1:]
        while len(wave) and len(rest):
            reached = []
            for at in range(0, len(wave), 64):
                part = wave[at : at + 64]
                near = np.bitwise_count((part[:, None] ^ rest[None, :]).view(np.uint64)) <= distance
                hit = near.any(0)
                if hit.any():
                    left.append(rest[hit])
                    right.append(part[near[:, hit].argmax(0)])
                    reached.append(rest[hit])
                    rest = rest[~hit]
                    if not len(rest):
                        break
            wave = np.concatenate(reached) if reached else rest[:0]
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _verify(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of every key's group; ``keys`` is sorted."""
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.r_[first, len(keys)])
    first, size = first[size > 1], size[size > 1]
    if not len(first):
        return prints[:0], prints[:0]
    which = keys[first] >> 32
    member = np.repeat(np.arange(len(first)), size)
    rows = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    # Wholly equal halves meet under each of their 32 variants; the first of them suffices.
    bit = (prints[rows] >> which[member]) & 1
    ones = np.bincount(member, bit, len(first))
    use = (which % 32 == 0) | ((ones > 0) & (ones < size))
    first, size = first[use], size[use]
    two = first[size == 2]
    a, b = prints[two], prints[two + 1]
    near = np.bitwise_count((a ^ b).view(np.uint64)) <= 2
    lefts, rights = [a[near]], [b[near]]
    for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
        x, y = forest(prints[at : at + n])
        lefts.append(x)
        rights.append(y)
    return np.concatenate(lefts), np.concatenate(rights)


def _links(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key in, spanning links out; groups over ``limit`` pass with their key."""
    names = ["a", "b", "hot"]

    def linked(keys, prints):
        a, b = _verify(keys, prints)
        return pa.record_batch([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names)

    def passed(keys, prints):
        return pa.record_batch([pa.array(prints), pa.array(prints), pa.array(keys)], names)

    held_k, held_p, hot = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in batches:
        k = np.concatenate([held_k, batch.column(0).to_numpy()])
        p = np.concatenate([held_p, batch.column(1).to_numpy()])
        if hot is not None:
            n = int(np.searchsorted(k, hot, "right"))
            if n:
                yield passed(k[:n], p[:n])
                k, p = k[n:], p[n:]
            if len(k):
                hot = None
        if not len(k):
            held_k, held_p = k, p
            continue
        cut = int(np.searchsorted(k, k[-1], "left"))
        if cut:
            yield linked(k[:cut], p[:cut])
        held_k, held_p = k[cut:], p[cut:]
        if len(held_k) > limit:
            hot = int(held_k[0])
            yield passed(held_k, held_p)
            held_k, held_p = held_k[:0], held_p[:0]
    if len(held_k):
        yield linked(held_k, held_p)


def variants(prints: DataFrame) -> DataFrame:
    """64 rows (key, fp) a fingerprint: which bit is left out, and the rest of its half."""
    half = lambda i: F.when(i < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(
        F.shiftrightunsigned("fp", 32)
    )
    masks = F.array(*[F.lit(0xFFFFFFFF ^ (1 << (i % 32))).cast("long") for i in range(64)])
    return prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).select(
        (F.col("i").cast("long") * F.lit(1 << 32) + half(F.col("i")).bitwiseAND(F.element_at(masks, F.col("i") + 1))).alias("key"),
        "fp",
    )


def _clique_links(hot: DataFrame) -> DataFrame:
    """Exact links of over-large groups: all that agree but for two left-out bits are linked."""
    pairs = [(i, j) for i in range(64) for j in range(i + 1, 64)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    full = (1 << 64) - 1
    masks = F.array(*[F.lit(signed(full ^ (1 << i) ^ (1 << j))).cast("long") for i, j in pairs])
    rows = hot.select("fp").distinct().select("fp", F.posexplode(masks).alias("n", "mask")).select(
        "fp", "n", F.col("fp").bitwiseAND(F.col("mask")).alias("rest")
    )
    least = rows.groupBy("n", "rest").agg(F.min("fp").alias("least"), F.count("*").alias("size")).where("size > 1")
    return rows.join(least, ["n", "rest"]).where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))


def print_links(prints: DataFrame, group: int = GROUP) -> DataFrame:
    """(a, b) links that span the components of distinct fingerprints (fp) at two or fewer differing bits."""
    keyed = variants(prints).repartition("key").sortWithinPartitions("key", "fp")
    # Sorted by key inside each task: an external sort that spills; the task itself streams.
    links = materialise(keyed.mapInArrow(lambda b: _links(b, group), "a long, b long, hot long"), "near")
    edges = links.where("hot is null").select("a", "b")
    hot = links.where("hot is not null").select(F.col("a").alias("fp"))
    return edges if hot.isEmpty() else edges.unionAll(_clique_links(hot))


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, group: int = GROUP
) -> DataFrame:
    """One row a row of ``docs``: id, fingerprint (hex), component_id.

    Fingerprints link at two or fewer differing bits; component_id is the smallest id that
    can be reached. Null and blank texts have fingerprint zero and link like any other.
    A null id stays in the result and never is a component's smallest id, unless all of that
    component's are null. Bits that are set in just half of the shingles are 0. Very long texts
    are read whole. Repeated rows give repeated rows, an empty table an empty result. Other
    columns are not read, whatever their names.
    """
    ids = docs.schema[id_col].dataType

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t.as_py(), shingle) for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.int64())], ["id", "fp"])

    found = materialise(
        docs.select(named(id_col).alias("id"), named(text_col).cast("string").alias("text")).mapInArrow(
            prints, f"id {ids.simpleString()}, fp long"
        ),
        "prints",
    )
    folded = found.groupBy("fp").agg(F.min("id").alias("least"))
    edges = print_links(folded.select("fp"), group)
    nodes = connected_components(edges)
    nodes = nodes.unionAll(nodes.select(F.col("root").alias("node"), "root").distinct())
    rooted = folded.join(nodes, folded.fp == nodes.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = rooted.join(least, "root").select(F.col("fp").alias("of"), "component_id")
    return found.join(member, found.fp == member.of).select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
