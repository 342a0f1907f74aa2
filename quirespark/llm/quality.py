"""Quality by nearest-neighbour voting over latent-semantic vectors.

A text becomes counts of hashed byte trigrams, of hashed four-grams of character classes, and
of a few binned statistics (repeated words and lines, marks, capitals). These terms, weighted
by inverse document frequency, are projected onto the leading right singular vectors of a
bounded sample of labelled texts. That sample's vectors are the neighbours: they are sent to
every task (their size is ``sample`` x ``rank`` floats, whatever the corpus), each batch of
documents is multiplied with all of them in blocks, and the nearest ones' labels are averaged
with weights that grow with their cosine.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quirespark.llm._common import fresh, named

TRIGRAMS, SHAPES, BINS, STATS = 4096, 1024, 12, 8
#: Words are looked for again within so many, so that long texts don't seem repetitive.
WINDOW = 200
TERMS = TRIGRAMS + SHAPES + BINS * STATS

_CLASS = np.full(256, 3, np.uint8)
for _c in range(128):
    _s = chr(_c)
    _CLASS[_c] = 0 if _s.islower() else 1 if _s.isupper() else 2 if _s.isdigit() else 4 if _s == " " else 5 if _s == "\n" else (
        6 if _s in ".,;:'" else 7 + (_c % 5))


def terms(text: str | None) -> np.ndarray:
    """Term weights of one whole text (float32, before inverse document frequencies)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(TERMS, np.float32)
    b = np.frombuffer(raw, np.uint8)
    n = len(b)
    if n >= 3:
        w = b.astype(np.uint32)
        h = (w[:-2] * np.uint32(0x9E3779B1) + w[1:-1] * np.uint32(0x85EBCA77) + w[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20)
        out[:TRIGRAMS] = np.sqrt(np.bincount(h, minlength=TRIGRAMS) / len(h))
    if n >= 4:
        c = _CLASS[b].astype(np.uint32)
        h = ((c[:-3] * 4913 + c[1:-2] * 289 + c[2:-1] * 17 + c[3:]) * np.uint32(0x9E3779B1)) >> np.uint32(22)
        out[TRIGRAMS : TRIGRAMS + SHAPES] = np.sqrt(np.bincount(h, minlength=SHAPES) / len(h))
    words, lines = raw.split(), raw.split(b"\n")
    m = max(len(words), 1)
    kinds = np.bincount(_CLASS[b], minlength=12) / max(n, 1)
    same = sum(x == y for x, y in zip(words, words[1:]))
    stats = (
        1 - sum(len(set(words[i : i + WINDOW])) for i in range(0, m, WINDOW)) / m,
        same / m,
        1 - len(set(lines)) / len(lines),
        float(kinds[7:].sum()) * 4,
        float(kinds[1]) * 2,
        float(kinds[2]) * 4,
        len(lines) / m * 4,
        min(n / m / 20, 1.0),
    )
    at = TRIGRAMS + SHAPES
    for k, s in enumerate(stats):
        x = min(max(s, 0.0), 1.0) * (BINS - 1)
        low = int(x)
        out[at + k * BINS + low] = (1 - (x - low)) * 0.5
        if low + 1 < BINS:
            out[at + k * BINS + low + 1] = (x - low) * 0.5
    return out


@dataclass(frozen=True)
class QualityModel:
    """Projection of terms, and the labelled vectors with their labels; all of bounded size."""

    weight: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int = 15
    sharpness: float = 20.0

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    @classmethod
    def fit(cls, found: np.ndarray, labels: np.ndarray, rank: int, neighbours: int, sharpness: float) -> QualityModel:
        seen = (found > 0).sum(0)
        weight = (np.log((1 + len(found)) / (1 + seen)) + 1).astype(np.float32)
        a = found.astype(np.float32)  # the only copy; all else is done in place
        a *= weight
        a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-9)
        values, left = np.linalg.eigh((a @ a.T).astype(np.float64))
        keep = values > max(values[-1] * 1e-9, 1e-12)
        values, left = values[keep][::-1][:rank], left[:, keep][:, ::-1][:, :rank]
        axes = (a.T @ (left / np.sqrt(values))).astype(np.float32)
        return cls(weight, axes, cls._unit(a @ axes), labels.astype(np.float64), min(neighbours, len(labels)), sharpness)

    def _nearest(self, near: np.ndarray) -> np.ndarray:
        """Columns of the largest values of each row; among equal ones the first."""
        k = self.neighbours
        best = np.argpartition(-near, k - 1, axis=1)[:, :k]
        kth = np.take_along_axis(near, best, 1).min(1, keepdims=True)
        tied = np.flatnonzero((near >= kth).sum(1) > k)
        if len(tied):
            best[tied] = np.argsort(-near[tied], axis=1, kind="stable")[:, :k]
        return best

    def score(self, found: np.ndarray, block: int = 8192) -> np.ndarray:
        """Exact cosines with every labelled vector, block by block, keeping the nearest."""
        mine = self._unit(self._unit(found * self.weight) @ self.axes)
        near = np.full((len(mine), self.neighbours), -np.inf, np.float32)
        vote = np.zeros((len(mine), self.neighbours))
        for at in range(0, len(self.labels), block):
            cosine = mine @ self.vectors[at : at + block].T
            near = np.concatenate([near, cosine], axis=1)
            vote = np.concatenate([vote, np.broadcast_to(self.labels[at : at + block], cosine.shape)], axis=1)
            best = self._nearest(near)
            near, vote = np.take_along_axis(near, best, 1), np.take_along_axis(vote, best, 1)
        pull = np.exp(self.sharpness * (near.astype(np.float64) - near.max(1, keepdims=True)))
        return np.clip((pull * vote).sum(1) / pull.sum(1), 0.0, 1.0)


def fold(id_col: str) -> F.Column:
    """crc32 of the id as text, modulo 4; rows where it is 2 are never learned from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4))


def _terms_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = [(t.as_py() or "") for t in batch.column(0)]
        sums = pa.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in raw], pa.int64())
        rows = pa.array([terms(t).astype(np.float16).tobytes() for t in raw], pa.binary())
        yield pa.record_batch([rows, sums, *batch.columns[1:]], ["terms", "crc", "label", "h", "id"])


def fit_quality(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    sample: int = 2048, rank: int = 64, neighbours: int = 15, sharpness: float = 20.0,
) -> QualityModel | None:
    """Fit on at most ``sample`` labelled rows, those of the smallest hash of the id.

    Texts become terms, in half precision, where they are read; the terms are what is sorted
    and gathered: ``sample`` times 10 KB, at any corpus size and whatever a text's length.
    Rows of the held-out fold, null ids and null labels are left out; an id labelled more
    than once counts with the mean, and rows of one id go in the order of their text's
    checksum. None if nothing is left to learn from.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold(id_col) != 2))
        .groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).alias("label"))
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # At most ``sample`` rows of two numbers are broadcast.
    learned = texts.join(F.broadcast(chosen), "id").select("text", "label", F.xxhash64("id").alias("h"), F.col("id").cast("string").alias("id"))
    made = learned.mapInArrow(_terms_of, "terms binary, crc long, label double, h long, id string")
    rows = made.orderBy("h", "id", "crc").limit(sample).select("terms", "label").collect()
    if not rows:
        return None
    found, y = np.stack([np.frombuffer(r["terms"], np.float16) for r in rows]), np.array([r["label"] for r in rows])
    del rows
    return QualityModel.fit(found, y, rank, neighbours, sharpness)


def _voted(docs: DataFrame, model: QualityModel | None, threshold: float, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """Columns k0, k1 ... (those of ``keep``), held_out, score, predicted."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [f"k{i}" for i in range(len(keep))]

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            score = np.full(len(texts), 0.5)
            if model is not None:
                for at in range(0, len(texts), 256):
                    part = texts[at : at + 256]
                    score[at : at + 256] = model.score(np.stack([terms(t.as_py()) for t in part]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], [*names, "held_out", "score"])

    held_out = F.coalesce(fold(id_col) == 2, F.lit(False)).alias("held_out")
    rows = docs.select(*[named(c).alias(n) for n, c in zip(names, keep)], held_out, named(text_col).cast("string").alias("text"))
    schema = StructType([*rows.schema.fields[:-1], StructField("score", DoubleType())])
    return rows.mapInArrow(vote, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def score_quality(
    docs: DataFrame, model: QualityModel | None, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """A row a row of ``docs``: the columns ``keep`` (the id if not given), held_out, score, predicted.

    Only the text is scored; equal texts have equal scores, but for the rounding of 32-bit sums. A null text is scored as an empty
    one: it has none of the n-grams, and the vectors that it is nearest to are those of texts
    with the fewest marks and repeats. Very long texts are read whole. Among equal cosines the
    neighbour that was learned first counts. Without a model every score is 0.5. Repeated rows
    give repeated rows, an empty table an empty result. A result column that has the name of a
    kept one gets an underscore behind it; columns that are not kept are not read.
    """
    keep = keep or [id_col]
    made = _voted(docs, model, threshold, id_col, text_col, keep)
    return made.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(c).alias(fresh(c, keep)) for c in ("held_out", "score", "predicted")]
    )


def keep_quality(docs: DataFrame, model: QualityModel | None, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are predicted to be of quality 1, with all their columns."""
    made = _voted(docs, model, threshold, id_col, text_col, docs.columns).where("predicted = 1")
    return made.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
