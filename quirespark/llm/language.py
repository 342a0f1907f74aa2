"""Language identification by rank-order profiles of letter n-grams.

A profile lists a language's most frequent n-grams (one to three letters, word boundaries
included) by rank. A document's own most frequent n-grams are ranked alike; its distance to a
language sums how far each n-gram is out of place, and an n-gram that the profile lacks costs
the whole profile length. The nearest language is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from quirespark.llm._common import fresh, materialise, named
from quirespark.llm.quality import fold

UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """For every code point, 1 (a boundary) or, for a letter, a number from 2 to 1023."""
    out = np.ones(0x110000, np.int32)
    points = np.fromiter((c for c in range(0x110000) if chr(c).isalpha()), np.int64)
    near = points < 0x250
    out[points[near]] = points[near] + 2
    out[points[~near]] = 600 + (points[~near] * 2654435761 >> 7) % 424
    return out


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a whole text (as numbers) and their counts; none without a letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.concatenate([[1], _letters()[points], [1]]).astype(np.int32)
    x = x[np.r_[True, (x[1:] != 1) | (x[:-1] != 1)]]
    if len(x) < 2 or not (x != 1).any():
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    two = (x[:-1] << 10) | x[1:]
    three = (two[:-1] << 10) | x[2:]
    # A boundary inside an n-gram would join two words.
    three = three[x[1:-1] != 1]
    return np.unique(np.concatenate([x[x != 1], two, three]), return_counts=True)


def ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, ties by number."""
    return grams[np.lexsort((grams, -counts))[:size]]


@dataclass(frozen=True)
class LanguageProfiles:
    languages: list[str]
    grams: np.ndarray
    place: np.ndarray
    size: int

    @classmethod
    def build(cls, rows: list[tuple[str, int, int]], size: int) -> LanguageProfiles:
        """From (language, n-gram, rank) rows."""
        languages = sorted({r[0] for r in rows})
        grams = np.unique(np.array([r[1] for r in rows], np.int32))
        place = np.full((len(grams), len(languages)), -1, np.int32)
        for lang, gram, rank in rows:
            place[np.searchsorted(grams, gram), languages.index(lang)] = rank
        return cls(languages, grams, place, size)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, and its share: the runner-up's distance over the sum of both."""
        grams, counts = ngrams(text)
        if not len(grams) or not self.languages:
            return UNKNOWN, 0.0
        mine = ranked(grams, counts, self.size)
        at = np.minimum(np.searchsorted(self.grams, mine), len(self.grams) - 1)
        place = np.where((self.grams[at] == mine)[:, None], self.place[at], -1)
        apart = np.abs(place - np.arange(len(mine), dtype=np.int32)[:, None])
        far = np.where(place < 0, self.size, apart).sum(0, dtype=np.int64)
        best = int(far.argmin())
        others = np.delete(far, best)
        other = int(others.min()) if len(others) else self.size * len(mine)
        total = other + int(far[best])
        return self.languages[best], other / total if total else 0.5


def fit_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 2000, size: int = 400, few: int = 100_000
) -> LanguageProfiles:
    """Profiles from at most ``sample`` documents a language outside the held-out fold.

    The documents of the smallest hash of the id are taken. They are found without sorting a
    language: counts by hash bucket are summed before the shuffle, and only the buckets that
    hold the first ``sample`` rows are ranked. Their ids are broadcast to the texts if there
    are at most ``few`` (languages times ``sample``), and else joined.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != 2)).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col).alias("h"),
        F.shiftrightunsigned(F.xxhash64(id_col), 52).alias("bucket"),
    )
    so_far = Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        rows.groupBy("lang", "bucket").agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0))).where(F.col("before") < sample).select("lang", "bucket")
    )
    first = Window.partitionBy("lang").orderBy("h", "id")
    chosen = (
        rows.join(buckets, ["lang", "bucket"]).withColumn("n", F.row_number().over(first)).where(F.col("n") <= sample)
        .select("id", "lang").distinct()
    )
    chosen = materialise(chosen, "learned")
    if chosen.count() <= few:
        chosen = F.broadcast(chosen)
    texts = docs.where(fold(id_col) != 2).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                grams, counts = ngrams(text.as_py())
                yield pa.record_batch(
                    [pa.array([lang.as_py()] * len(grams), pa.string()), pa.array(grams), pa.array(counts.astype(np.int64))], ["lang", "gram", "n"]
                )

    total = (
        texts.join(chosen, ["id", "lang"]).select("lang", "text").mapInArrow(counted, "lang string, gram int, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = total.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < size)
    return LanguageProfiles.build([(r["lang"], r["gram"], r["place"]) for r in top.select("lang", "gram", "place").collect()], size)


def _identified(docs: DataFrame, profiles: LanguageProfiles, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """Columns k0, k1 ... (those of ``keep``), held_out, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)
    names = [f"k{i}" for i in range(len(keep))]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            made = [model.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())],
                [*names, "held_out", "lang_pred", "score"],
            )

    held_out = F.coalesce(fold(id_col) == 2, F.lit(False)).alias("held_out")
    rows = docs.select(*[named(c).alias(n) for n, c in zip(names, keep)], held_out, named(text_col).cast("string").alias("text"))
    return rows.mapInArrow(predict, StructType([*rows.schema.fields[:-1], StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def identify_languages(
    docs: DataFrame, profiles: LanguageProfiles, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """A row a row of ``docs``: the columns ``keep`` (the id if not given), held_out, lang_pred, score.

    ``und`` with score 0 where the text is null or has no letter, or nothing was learned.
    Equal distances go to the language that sorts first. Very long texts are read whole.
    Repeated rows give repeated rows, an empty table an empty result. A result column that has
    the name of a kept one gets an underscore behind it; columns that are not kept are not read.
    """
    keep = keep or [id_col]
    made = _identified(docs, profiles, id_col, text_col, keep)
    return made.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(c).alias(fresh(c, keep)) for c in ("held_out", "lang_pred", "score")]
    )


def keep_named(docs: DataFrame, profiles: LanguageProfiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is a learned one, with all their columns."""
    made = _identified(docs, profiles, id_col, text_col, docs.columns).where(F.col("lang_pred") != UNKNOWN)
    return made.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
