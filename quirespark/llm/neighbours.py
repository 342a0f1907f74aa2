"""Approximate nearest neighbours on shifted space-filling curves.

Vectors (with one component more, which turns the largest inner product into the nearest
direction) are projected onto a few axes, turned and shifted once a curve, and put in the order
of the Hilbert curve through the cells of the result. Spark range-partitions every order, and
every vector gets its row number along it. A query is compared with all vectors whose numbers
are within a window around its own on every curve, in blocks far smaller than the window; what
the curves find is merged and ranked by the exact measure.

How many curves and how wide a window are not guessed, at any size of the table: a bounded
sample of queries is searched exactly, and the cheapest setting is taken whose windows hold
``recall`` of the true neighbours. Where directions are spread evenly in many dimensions no
order keeps neighbours together, and every such setting reads more than all vectors; the window
is then the whole table once, in bounded blocks, which is exact, and quadratic: beyond
``exact_pairs`` comparisons it is refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirespark.llm._common import materialise, named

BITS, AXES = 7, 8


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places along the Hilbert curve of integer cells, a row each (axes x bits <= 62)."""
    x = [c.astype(np.int64) for c in cells.T]
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(len(x)):
            high = (x[i] & q) != 0
            x[0] = np.where(high, x[0] ^ (q - 1), x[0])
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = x[0] ^ swap
            x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | (((axis ^ turn) >> bit) & 1)
    return key


@dataclass(frozen=True)
class Curves:
    """Projections fitted on a bounded sample; ``largest`` is the largest norm of all vectors."""

    largest: float
    centre: np.ndarray
    axes: np.ndarray
    turns: np.ndarray
    shifts: np.ndarray
    scale: float

    @classmethod
    def fit(cls, sample: np.ndarray, largest: float, count: int, seed: int = 1) -> Curves:
        rng = np.random.default_rng(seed)
        lifted = cls._lift(sample, largest)
        centre = lifted.mean(0)
        m = min(AXES, lifted.shape[1])
        values, vectors = np.linalg.eigh(np.cov(lifted - centre, rowvar=False).reshape(lifted.shape[1], -1))
        axes = vectors[:, ::-1][:, :m]
        turns = np.stack([np.linalg.qr(rng.normal(size=(m, m)))[0] for _ in range(count)])
        scale = 4 * max(math.sqrt(max(values[-1], 0.0)), 1e-9)
        return cls(largest, centre, axes, turns, rng.uniform(-0.25, 0.25, (count, m)), scale)

    @staticmethod
    def _lift(x: np.ndarray, largest: float) -> np.ndarray:
        x = x / largest
        return np.concatenate([x, np.sqrt(np.maximum(1 - (x * x).sum(1, keepdims=True), 0))], axis=1)

    def keys(self, x: np.ndarray, asked: np.ndarray) -> np.ndarray:
        """Keys (rows x curves). Queries are only a direction, so they are lifted at full length."""
        x = x.astype(np.float64)
        length = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.where(asked[:, None], x / np.maximum(length, 1e-300) * self.largest, x)
        flat = (self._lift(x, self.largest) - self.centre) @ self.axes
        out = []
        for turn, shift in zip(self.turns, self.shifts):
            unit = (flat @ turn) / (2 * self.scale) + 0.5 + shift / 4
            out.append(hilbert(np.clip((unit * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)))
        return np.stack(out, axis=1)


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def best_pairs(asked: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, vec_id, score) of each query's k best; the score of a pair does not
    depend on the block that it is met in."""
    rows, found, scores = [], [], []
    for at in range(0, len(asked), 256):
        part = asked[at : at + 256]
        s = part @ vectors.T
        if s.shape[1] > k:
            kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            q, c = np.nonzero(s >= (kth - 1e-9 * np.maximum(np.abs(kth), np.abs(s).max(1)))[:, None])
        else:
            q, c = np.divmod(np.arange(s.size), s.shape[1])
        exact = np.empty(len(q))
        for i in range(0, len(q), 16384):
            exact[i : i + 16384] = (part[q[i : i + 16384]] * vectors[c[i : i + 16384]]).sum(1)
        order = np.lexsort((ids[c], -exact, q))
        q, c, exact = q[order], c[order], exact[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < k
        rows.append(q[keep] + at)
        found.append(ids[c[keep]])
        scores.append(exact[keep])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(scores)


def _merge(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of every query; most are dropped before the shuffle."""
    order = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


_FOUND = "asker long, vec_id long, score double"


def _compare(cells: DataFrame, asked: DataFrame, dim: int, k: int) -> DataFrame:
    """Both sides by (block, chunk): every query of a cell against every vector of it."""

    def compare(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"asker": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        who = right["id"].to_numpy()
        q, ids, scores = best_pairs(_matrix(right["vec"], dim), _matrix(left["vec"], dim), left["id"].to_numpy(), k)
        return pa.table({"asker": who[q], "vec_id": ids, "score": scores})

    return cells.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInArrow(compare, _FOUND)


def _exact_for(sample: np.ndarray, ids: np.ndarray, vectors: DataFrame, dim: int, k: int) -> DataFrame:
    """Exact neighbours of a bounded sample of queries, which is sent to every task."""
    sent = vectors.sparkSession.sparkContext.broadcast((sample, ids))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, who = sent.value
        for batch in batches:
            if batch.num_rows:
                q, found, scores = best_pairs(asked, _matrix(batch.column(1), dim), batch.column(0).to_numpy(), k + 1)
                yield pa.record_batch([pa.array(who[q]), pa.array(found), pa.array(scores)], ["asker", "vec_id", "score"])

    return _merge(vectors.select("id", "vec").mapInArrow(scan, _FOUND).where("asker <> vec_id"), k)


@dataclass(frozen=True)
class Setting:
    """curves 0: the window is the whole table. width: half a window, in parts of the order."""

    curves: int
    width: float
    cost: float


def choose(asked_keys: np.ndarray, found_keys: np.ndarray, sample_keys: np.ndarray, recall: float, most: float = 0.8) -> Setting:
    """The cheapest number of curves and window width that hold ``recall`` of sampled pairs."""
    n, best = len(sample_keys), Setting(0, 1.0, 1.0)
    apart = []
    for c in range(sample_keys.shape[1]):
        order = np.sort(sample_keys[:, c])
        apart.append(np.abs(np.searchsorted(order, asked_keys[:, c]) - np.searchsorted(order, found_keys[:, c])) / n)
        nearest = np.min(apart, axis=0)
        width = float(np.quantile(nearest, recall)) + 1 / math.sqrt(n)
        cost = (c + 1) * min(2 * width, 1.0)
        if cost < best.cost and cost < most:
            best = Setting(c + 1, width, cost)
    return best


def nearest(
    vectors: DataFrame, is_query: F.Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = 0.95,
    curves: int = 8, block: int = 8192, chunk: int = 4096, fit_rows: int = 4096, fit_queries: int = 128, setting: Setting | None = None,
    exact_pairs: int = 10**13,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every query, itself left out.

    Null, zero and non-finite vectors and null ids take no part. Vectors are searched among
    those of their own length. Equal scores go to the smaller id. Rows of the same id and
    vector count once. Fewer than k candidates give fewer rows; an empty table gives none.
    Equal vectors are folded first: only the k + 1 smallest ids of a vector can be among
    anyone's k nearest, and equal queries are searched once. Other columns are not read.
    """
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    clean = vectors.select(named(id_col).cast("long").alias("id"), named(vec_col).cast("array<double>").alias("vec"), is_query.alias("asks"))
    clean = clean.where("id IS NOT NULL AND vec IS NOT NULL").where(finite)
    lengths = [r["dim"] for r in clean.groupBy(F.size("vec").alias("dim")).agg(F.max("asks").alias("asked")).where("asked").orderBy("dim").collect()]
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for dim in lengths:
        found, _ = search(clean.where(F.size("vec") == dim), dim, k, recall, curves, block, chunk, fit_rows, fit_queries, setting, exact_pairs)
        out = found if len(lengths) == 1 else out.unionAll(found)
    return out


def search(
    clean: DataFrame, dim: int, k: int, recall: float, curves: int, block: int, chunk: int, fit_rows: int, fit_queries: int,
    setting: Setting | None, exact_pairs: int,
) -> tuple[DataFrame, Setting]:
    """nearest() among the (id, vec, asks) of one length, and the setting that was taken."""
    clean = clean.groupBy("id", "vec").agg(F.max("asks").alias("asks"))

    first = Window.partitionBy("vec").orderBy("id")
    folded = materialise(
        clean.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).select("id", "vec"), "vectors"
    )
    asking = clean.where("asks").select(F.col("id").alias("query_id"), "vec")
    heads = materialise(asking.groupBy("vec").agg(F.min("query_id").alias("id")), "queries")
    total, heads_total = folded.count(), heads.count()

    chosen = setting
    fitted = None
    if chosen is None or chosen.curves:
        norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
        largest = folded.agg(F.max(norm)).first()[0]
        rows = folded.orderBy(F.xxhash64("id"), "id").limit(fit_rows).collect()
        sample = np.array([r["vec"] for r in rows], np.float64)
        fitted = Curves.fit(sample, largest, curves if chosen is None else chosen.curves)
    if chosen is None:
        some = heads.orderBy(F.xxhash64("id"), "id").limit(fit_queries).collect()
        asked = np.array([r["vec"] for r in some], np.float64).reshape(-1, dim)
        truth = _exact_for(asked, np.array([r["id"] for r in some], np.int64), folded, dim, k)
        # At most fit_queries x k pairs.
        pairs = truth.join(folded.withColumnRenamed("id", "vec_id"), "vec_id").select("asker", "vec").collect()
        at = {r["id"]: i for i, r in enumerate(some)}
        if pairs:
            mine = fitted.keys(asked, np.ones(len(asked), bool))[[at[p["asker"]] for p in pairs]]
            theirs = fitted.keys(np.array([p["vec"] for p in pairs], np.float64), np.zeros(len(pairs), bool))
            chosen = choose(mine, theirs, fitted.keys(sample, np.zeros(len(sample), bool)), recall)
        else:
            chosen = Setting(0, 1.0, 1.0)

    if not chosen.curves:
        if total * heads_total > exact_pairs:
            raise ValueError(f"no windows hold {recall} of these vectors' neighbours, and an exact search would compare {total} vectors with {heads_total} queries; exact_pairs allows {exact_pairs}")
        blocks, chunks = -(-total // block), max(-(-heads_total // chunk), 1)
        cells = folded.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn(
            "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))
        )
        asked = heads.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(chunks))).withColumn(
            "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
        )
        best = _merge(_compare(cells, asked, dim, k + 1), k + 1)
    else:
        ordered = materialise(_in_order(folded, heads, fitted, chosen.curves, dim, -(-total * chosen.curves // block)), "ordered")
        reach = max(math.ceil(chosen.width * total), 1)
        step = min(max(reach // 4, 64), block)  # rows a block: windows are read to a quarter of their half
        chunks = max(math.ceil(heads_total * (2 * reach + step) / max(total, 1) / chunk), 1)
        numbered = _numbered(ordered)
        cells = numbered.where("NOT asked").withColumn("block", F.floor(F.col("row") / step)).withColumn(
            "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))
        )
        asked = numbered.where("asked").withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks))).withColumn(
            "block", F.explode(F.sequence(F.floor((F.col("row") - reach) / step), F.floor((F.col("row") + reach) / step)))
        )
        # Named anew, as both sides are of one table.
        part = lambda df: df.select(F.col("id").alias("id"), F.col("vec").alias("vec"), F.col("chunk").alias("chunk"), (F.col("block") * chosen.curves + F.col("curve")).alias("block"))
        cells, asked = part(cells), part(asked.where((F.col("block") >= 0) & (F.col("block") <= (total - 1) // step)))
        met = _compare(cells, asked, dim, k + 1)
        best = _merge(met.groupBy("asker", "vec_id").agg(F.max("score").alias("score")), k + 1)

    lists = best.groupBy("asker").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))
    who = asking.join(heads, "vec").select("query_id", F.col("id").alias("head"))
    out = who.join(lists, F.col("head") == F.col("asker")).withColumn(
        "found", F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    )
    out = out.select("query_id", F.posexplode("found").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score"
    )
    return out, chosen


def _in_order(folded: DataFrame, heads: DataFrame, fitted: Curves, curves: int, dim: int, tasks: int) -> DataFrame:
    """Vectors and queries once a curve, range-partitioned and sorted by curve and key: id, vec,
    asked, curve, task, and local, how many vectors of its curve the task had before."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(2).to_numpy(zero_copy_only=False)
            keys = fitted.keys(_matrix(batch.column(1), dim), asked)
            for c in range(curves):
                yield pa.record_batch([*batch.columns, pa.array(np.full(len(asked), c, np.int32)), pa.array(keys[:, c])], ["id", "vec", "asked", "curve", "key"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before = TaskContext.get().partitionId(), np.zeros(curves, np.int64)
        for batch in batches:
            vectors = ~batch.column(2).to_numpy(zero_copy_only=False)
            curve, local = batch.column(3).to_numpy(), np.zeros(batch.num_rows, np.int64)
            for c in np.unique(curve):
                mine = curve == c
                so_far = np.cumsum(vectors[mine])
                local[mine] = before[c] + so_far - vectors[mine]
                before[c] += so_far[-1]
            yield pa.record_batch([*batch.columns[:4], pa.array(np.full(batch.num_rows, at, np.int32)), pa.array(local)], ["id", "vec", "asked", "curve", "task", "local"])

    rows = folded.withColumn("asked", F.lit(False)).unionByName(heads.select("id", "vec").withColumn("asked", F.lit(True)))
    placed = rows.select("id", "vec", "asked").mapInArrow(keyed, "id long, vec array<double>, asked boolean, curve int, key long")
    ordered = placed.repartitionByRange(max(tasks, 1), "curve", "key", "id").sortWithinPartitions("curve", "key", "id")
    return ordered.mapInArrow(counted, "id long, vec array<double>, asked boolean, curve int, task int, local long")


def _numbered(ordered: DataFrame) -> DataFrame:
    """``ordered`` with row, the place along the curve over all tasks.

    What is broadcast is one number a task and curve that it holds rows of.
    """
    before = Window.partitionBy("curve").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = ordered.groupBy("curve", "task").agg(F.count_if(~F.col("asked")).alias("n"))
    starts = counts.select("curve", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return ordered.join(F.broadcast(starts), ["curve", "task"]).withColumn("row", F.col("local") + F.col("start"))
