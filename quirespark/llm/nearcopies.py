"""Near copies: SimHash groups, widened to texts of a Jaccard similarity of 0.8 or more.

Two texts link if their SimHash fingerprints do (simhash.py: two or fewer differing bits), or if
their sets of five-word shingles are that similar. Fingerprints alone cannot tell the latter:
at a similarity of 0.8 they differ in about ten bits of 64, and no cut into segments that then
differ by at most one bit leaves segments long enough to be selective. So the candidates of
the second rule come from MinHash.

Candidates share one of ``BANDS`` MinHash keys of ``ROWS`` minima each: a pair of similarity s
is missed with a chance of (1 - s^ROWS)^BANDS, which is 0.00003 at 0.8 and less above it.
Every candidate is then verified on the whole sets, so no pair below the similarity is linked.
Texts of equal sets are folded into one node before any of this.

Inside a key's group only a spanning forest of the verified links is emitted, never all pairs.
A group beyond ``GROUP`` nodes is dealt into blocks that meet two by two, so a task holds the
sets of about two blocks and every pair still meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirespark.llm._common import connected_components, materialise, named
from quirespark.llm.simhash import fingerprint, print_links

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS, GROUP = 20, 4, 4_000
_SEED = 42
_MIX = np.random.default_rng(_SEED).integers(0, 1 << 64, (2, BANDS * ROWS), np.uint64) | np.array([[0], [1]], np.uint64)
_FOLD = np.random.default_rng(_SEED + 1).integers(0, 1 << 64, ROWS, np.uint64) | np.uint64(1)


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one, none if it has no word."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begin = np.r_[0, end[:-1] + 1][: max(len(words) - width + 1, 1)].tolist()
    digest, end = xxhash.xxh64_intdigest, end[min(width, len(words)) - 1 :].tolist()
    return np.unique(np.fromiter((digest(line[i:j], _SEED) for i, j in zip(begin, end)), np.uint64, len(begin)))


def band_keys(found: np.ndarray) -> np.ndarray:
    """The MinHash keys of a set of hashes, which is not empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        np.minimum(least, ((found[at : at + 4096, None] ^ _MIX[0]) * _MIX[1]).min(0), out=least)
    keys = least.reshape(BANDS, ROWS)
    keys = ((keys ^ keys >> np.uint64(31)) * _FOLD).sum(1, dtype=np.uint64)
    return ((keys ^ keys >> np.uint64(29)) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether two sorted sets have that Jaccard similarity."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return common >= least * (len(both) - common) - 1e-9


def forest(sets: list[np.ndarray], least: float = SIMILARITY) -> list[tuple[int, int]]:
    """Links (child, parent) of places in ``sets`` that span its components."""
    links, rest = [], list(range(len(sets)))
    while rest:
        wave, rest = [rest[0]], rest[1:]
        while wave and rest:
            at, left = wave.pop(), []
            for i in rest:
                if similar(sets[at], sets[i], least):
                    links.append((i, at))
                    wave.append(i)
                else:
                    left.append(i)
            rest = left
    return links


def _links(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows (part, node, members) sorted by part in, verified spanning links out."""
    now, nodes, sets = None, [], []

    def linked():
        found = forest(sets, least)
        return pa.record_batch([pa.array([nodes[k] for k in x], pa.int64()) for x in (zip(*found) if found else ((), ()))], ["a", "b"])

    for batch in batches:
        for part, node, members in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if part != now:
                if len(nodes) > 1:
                    yield linked()
                now, nodes, sets = part, [], []
            nodes.append(node)
            sets.append(np.frombuffer(members, np.uint64))
    if len(nodes) > 1:
        yield linked()


def _print_edges(found: DataFrame) -> DataFrame:
    """Links of nodes whose fingerprints are equal or link; a fingerprint stands for its least node."""
    pairs = found.groupBy("fp", "node").agg(F.count("*").alias("rows")).select("fp", "node")
    heads = materialise(pairs.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("nodes")), "heads")
    same = pairs.join(heads.where("nodes > 1"), "fp").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    links = print_links(heads.select("fp"))
    left, right = heads.select(F.col("fp").alias("a"), F.col("head").alias("p")), heads.select(F.col("fp").alias("b"), F.col("head").alias("q"))
    return same.unionAll(links.join(left, "a").join(right, "b").select("p", "q"))


def copy_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY,
    group: int = GROUP,
) -> DataFrame:
    """One row a row of ``docs``: id, text_hash (xxhash64 of the text), component_id, component.

    Texts link when their fingerprints do, or when their sets of word shingles are that
    similar, in lower case (ASCII) and whatever the white space; texts without a word link to
    each other. Very long texts are read whole; an empty table gives an empty result. component_id is the
    smallest id that can be reached. A null id never is, unless all of its component's are
    null. Where ids repeat, two components may have one component_id; component tells them
    apart. Repeated rows give repeated rows. Other columns are not read.
    """
    ids = docs.schema[id_col].dataType
    rows = docs.select(named(id_col).alias("id"), F.coalesce(named(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("h"), "text")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, keys, prints = [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py(), shingle)
                prints.append(fingerprint(text.as_py()))
                made.append(xxhash.xxh64_intdigest(found.tobytes(), _SEED))
                keys.append(band_keys(found) if len(found) else np.zeros(0, np.int64))
            nodes = pa.array(np.array(made, np.uint64).view(np.int64))
            yield pa.record_batch([batch.column(0), batch.column(1), nodes, pa.array(prints, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["id", "h", "node", "fp", "keys"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shingles(t.as_py(), shingle).tobytes() for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(made, pa.binary())], ["node", "members"])

    found = materialise(rows.mapInArrow(keyed, f"id {ids.simpleString()}, h long, node long, fp long, keys array<long>"), "keys")
    keys = found.select("node", F.explode("keys").alias("key")).distinct()
    # Keys of one and the same group of nodes do the same work: one of them stays.
    shared = keys.groupBy("key").agg(F.count("*").alias("size"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("of")).where("size > 1")
    shared = shared.groupBy("size", "of").agg(F.min("key").alias("key"))
    near = materialise(keys.join(shared.select("key", "size"), "key"), "near")
    blocks = F.ceil(F.col("size") / group).cast("int")
    parts = (
        near.withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("node", "key"), F.col("blocks")).cast("int"))
        .select("node", "key", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("node", F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other")).alias("part"))
    )
    # One text for each node that has a candidate; the list of them grows with the corpus.
    texts = found.join(near.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("h").alias("h"))
    whole = rows.select("h", "text").join(texts.hint("shuffle_hash"), "h").select("node", "text").mapInArrow(sets, "node long, members binary")
    whole = materialise(whole.dropDuplicates(["node"]), "sets")
    # Sorted by part inside each task: an external sort that spills; the task itself streams.
    met = parts.join(whole, "node").select("part", "node", "members").repartition("part").sortWithinPartitions("part", "node")
    nodes = connected_components(met.mapInArrow(lambda b: _links(b, similarity), "a long, b long").unionAll(_print_edges(found)))
    nodes = nodes.unionAll(nodes.select(F.col("root").alias("node"), "root").distinct())
    rooted = found.groupBy("node").agg(F.min("id").alias("least")).join(nodes, "node", "left")
    rooted = rooted.select("node", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = rooted.join(least, "root").select("node", "component_id", F.col("root").alias("component"))
    return found.join(member, "node").select(F.col("id").alias(id_col), F.col("h").alias("text_hash"), "component_id", "component")


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of every group of copy_groups(), with all columns of ``docs``.

    The row of the smallest id stays; null ids come last. Among rows of one id, that of the
    smallest text hash stays, and among rows equal in both, that of the smallest hash of all
    its columns: reruns keep the same. Rows of one id whose texts do not link both stay.
    """
    rows = copy_groups(docs, id_col, text_col, similarity=similarity).select(named(id_col).alias("id"), "text_hash", "component")
    rows = rows.groupBy("component", "id", "text_hash").agg(F.count("*").alias("rows"))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash", "rows")
    first = materialise(rows.groupBy("component").agg(F.min(order).alias("f")).select("f.id", "f.text_hash", "f.rows"), "first")
    held = [f"k{i}" for i in range(len(docs.columns))]
    text_hash = F.xxhash64(F.coalesce(named(text_col).cast("string"), F.lit("")))
    whole = docs.select(*[named(c).alias(k) for k, c in zip(held, docs.columns)], named(id_col).alias("of"), text_hash.alias("hash"))
    # The list of kept rows grows with the corpus: at every size it meets the texts by a shuffle.
    ours = first.select("id", "text_hash").hint("shuffle_hash")
    kept = whole.join(ours, F.col("of").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash")), "left_semi")
    if not first.where("rows > 1").isEmpty():
        same = Window.partitionBy("of", "hash").orderBy("all")
        sums = F.sha1(F.to_json(F.struct(*held), {"ignoreNullFields": "false"}))
        kept = kept.withColumn("all", sums).withColumn("n", F.row_number().over(same)).where("n = 1")
    return kept.select(*[F.col(k).alias(c) for k, c in zip(held, docs.columns)])
