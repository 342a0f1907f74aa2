"""Toxicity by a classifier chain of linear models.

Categories are predicted in a fixed order. Each one's model reads which words and word
beginnings a text holds (hashed), and the probabilities that the models before it gave. Those
are out-of-fold when the chain is trained: a row's probabilities come from models that did not
see it, so that a later model learns how far an earlier one can be trusted on new texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirespark.llm.quality import fold

SPACE = 1 << 18
_WORD = re.compile(r"\w+")


def features(text: str | None) -> np.ndarray:
    """Sorted distinct feature numbers of one whole text: its words, and beginnings of 4 and 5."""
    words = set(_WORD.findall((text or "").lower()))
    crc = zlib.crc32
    out = {crc(w.encode("utf-8", "surrogatepass")) for w in words}
    for n in (4, 5):
        out |= {crc(b.encode("utf-8", "surrogatepass"), n) for b in {w[:n] for w in words if len(w) > n}}
    return np.unique(np.fromiter(out, np.uint32, len(out)) >> np.uint32(14)).astype(np.int32)


@dataclass(frozen=True)
class Rows:
    """Feature numbers of many texts, one after another, and where each text's begin."""

    numbers: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> Rows:
        sizes = np.array([len(p) for p in parts], np.int64)
        return cls(np.concatenate(parts) if parts else np.zeros(0, np.int32), np.r_[0, np.cumsum(sizes)])

    def take(self, which: np.ndarray) -> Rows:
        return Rows.of([self.numbers[self.starts[i] : self.starts[i + 1]] for i in which])

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of ``values`` over every text's features."""
        total = np.r_[0.0, np.cumsum(values[self.numbers])]
        return total[self.starts[1:]] - total[self.starts[:-1]]


@dataclass(frozen=True)
class Linear:
    weights: np.ndarray
    bias: float
    earlier: np.ndarray

    def log_odds(self, rows: Rows, earlier: np.ndarray) -> np.ndarray:
        return np.clip(rows.sums(self.weights) + earlier @ self.earlier + self.bias, -30, 30)

    def probability(self, rows: Rows, earlier: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(rows, earlier)))

    @classmethod
    def fit(cls, rows: Rows, earlier: np.ndarray, y: np.ndarray, keep: int, rounds: int = 80, ridge: float = 2e-4) -> Linear:
        """Logistic regression on the ``keep`` features that tell the classes apart best."""
        n, ones = len(y), float(y.sum())
        if not 0 < ones < n:
            odds = float(np.clip(np.log((ones + 0.5) / (n - ones + 0.5)), -10, 10))
            return cls(np.zeros(SPACE, np.float32), odds, np.zeros(earlier.shape[1]))
        owner = np.repeat(np.arange(n), np.diff(rows.starts))
        seen = np.bincount(rows.numbers, minlength=SPACE)
        hits = np.bincount(rows.numbers, y[owner], SPACE)
        share = seen / n
        apart = hits / ones - (seen - hits) / (n - ones)
        z = apart / np.sqrt(np.maximum(share * (1 - share), 1 / n) * (1 / ones + 1 / (n - ones)))
        z[seen < 2] = 0
        best = np.argsort(-np.abs(z), kind="stable")[:keep]
        best = best[np.abs(z[best]) > 4]
        number = np.full(SPACE, -1, np.int64)
        number[best] = np.arange(len(best))
        column = number[rows.numbers]
        owner, column = owner[column >= 0], column[column >= 0]
        w, e, b = np.zeros(len(best)), np.zeros(earlier.shape[1]), float(np.log(ones / (n - ones)))
        scale = np.full(len(best) + len(e) + 1, 1e-8)
        for _ in range(rounds):
            odds = np.bincount(owner, w[column], n) + earlier @ e + b
            wrong = (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y) / n
            slope = np.r_[np.bincount(column, wrong[owner], len(best)) + ridge * w, earlier.T @ wrong + ridge * e, wrong.sum()]
            scale += slope * slope
            step = 0.5 * slope / np.sqrt(scale)
            w, e, b = w - step[: len(best)], e - step[len(best) : -1], b - float(step[-1])
        full = np.zeros(SPACE, np.float32)
        full[best] = w
        return cls(full, b, e)


@dataclass(frozen=True)
class Chain:
    categories: list[str]
    models: list[Linear]

    @classmethod
    def fit(cls, categories: list[str], rows: Rows, labels: np.ndarray, folds: np.ndarray, keep: int) -> Chain:
        """labels: rows x categories, NaN where a category is not labelled."""
        models, earlier = [], np.zeros((len(labels), 0))
        for c in range(len(categories)):
            known = ~np.isnan(labels[:, c])
            y = np.nan_to_num(labels[:, c])
            out = np.zeros(len(y))
            for f in np.unique(folds):
                learn, test = np.flatnonzero(known & (folds != f)), np.flatnonzero(folds == f)
                part = Linear.fit(rows.take(learn), earlier[learn], y[learn], keep)
                out[test] = part.probability(rows.take(test), earlier[test])
            learn = np.flatnonzero(known)
            models.append(Linear.fit(rows.take(learn), earlier[learn], y[learn], keep))
            earlier = np.c_[earlier, out]
        return cls(categories, models)

    def predict(self, rows: Rows) -> np.ndarray:
        """Probabilities, rows x categories."""
        earlier = np.zeros((len(rows.starts) - 1, 0))
        for model in self.models:
            earlier = np.c_[earlier, model.probability(rows, earlier)]
        return earlier


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [features(t.as_py()).tobytes() for t in batch.column(0)]
        sums = pa.array([zlib.crc32(r) for r in raw], pa.int64())
        yield pa.record_batch([pa.array(raw, pa.binary()), sums, *batch.columns[1:]], ["features", "crc", "h", *[f"y{i}" for i in range(batch.num_columns - 2)]])


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, categories: dict[str, str], id_col: str = "doc_id", text_col: str = "text",
    sample: int = 8192, keep: int = 2048, folds: int = 3,
) -> Chain | None:
    """Fit on at most ``sample`` labelled rows, those of the smallest hash of the id.

    ``categories`` names each category, in the chain's order, and its 0/1 label as SQL over
    ``labels``. Texts become features where they are read: what is sorted and gathered is four
    bytes a distinct word or beginning. Rows of the held-out fold and null ids are left out; of
    an id labelled more than once the mean is rounded, and rows of one id go in the order of
    their features' checksum. None if nothing is left to learn from.
    """
    names = list(categories)
    chosen = (
        labels.where(F.col(id_col).isNotNull() & (fold(id_col) != 2))
        .select(F.col(id_col).alias("id"), *[F.expr(e).cast("double").alias(f"y{i}") for i, e in enumerate(categories.values())])
        .groupBy("id").agg(*[F.round(F.avg(f"y{i}")).alias(f"y{i}") for i in range(len(names))])
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    # At most ``sample`` rows of a few numbers are broadcast.
    learned = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    ys = [f"y{i}" for i in range(len(names))]
    rows = (
        learned.select("text", F.xxhash64("id").alias("h"), *ys)
        .mapInArrow(_features_of, "features binary, crc long, h long, " + ", ".join(f"{y} double" for y in ys))
        .orderBy("h", "crc").limit(sample).collect()
    )
    if not rows:
        return None
    found = Rows.of([np.frombuffer(r["features"], np.int32) for r in rows])
    y = np.array([[np.nan if r[c] is None else r[c] for c in ys] for r in rows])
    return Chain.fit(names, found, y, np.array([r["h"] % folds for r in rows]), keep)


def score_toxicity(docs: DataFrame, chain: Chain | None, threshold: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, a probability p_<category> each, and predicted (1 if the last category's
    reaches the threshold).

    Null texts are empty ones and get the probability of a text without any known word. Very
    long texts are read whole, and a word counts once however often it is there; equal texts
    have equal probabilities, and one that equals the threshold is predicted. Without a model there are no p_ columns and predicted is 0. Repeated rows give repeated
    rows, an empty table an empty result; other columns are not read.
    """
    names = [] if chain is None else chain.categories
    sent = docs.sparkSession.sparkContext.broadcast(chain)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            columns = [batch.column(0)]
            if model is not None:
                made = [model.predict(Rows.of([features(t.as_py()) for t in batch.column(1)[at : at + 512]])) for at in range(0, batch.num_rows, 512)]
                columns += [pa.array(p) for p in (np.concatenate(made).T if made else np.zeros((len(names), 0)))]
            yield pa.record_batch(columns, ["id", *[f"p{i}" for i in range(len(names))]])

    kinds = "".join(f", p{i} double" for i in range(len(names)))
    made = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        score, f"id {docs.schema[id_col].dataType.simpleString()}{kinds}"
    )
    last = F.col(f"p{len(names) - 1}") >= threshold if names else F.lit(False)
    return made.select(
        F.col("id").alias(id_col), F.coalesce(fold("id") == 2, F.lit(False)).alias("held_out"),
        *[F.col(f"p{i}").alias(f"p_{n}") for i, n in enumerate(names)], last.cast("int").alias("predicted"),
    )
