"""Pipeline over ``documents``: quality, language, near-duplicates, mixing, packing.

Every stage takes all that the one before it kept. run() writes each stage's result into the
shared folder and reads it back, so that no stage is computed twice and an executor's loss
costs no more than the stage that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm._common import materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose predicted quality is 1; labels come from the labels table.

    Null and empty texts are scored as empty ones and go or stay like any other; very long
    texts are read whole. A score equal to the threshold stays. Repeated rows stay or go
    together, an empty table stays empty, and columns may have any names.
    """
    from quirespark.llm.quality import fit_quality, keep_quality

    return keep_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, whatever the margin.

    Null, empty and letterless texts have none and go; so does everything if no document
    names a language. Ties go to the language that sorts first and stay. Repeated rows stay
    or go together, an empty table stays empty, and columns may have any names.
    """
    from quirespark.llm.language import fit_languages, keep_named

    return keep_named(docs, fit_languages(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: that of the smallest id, then text hash.

    Null ids come last; null, empty and blank texts are one group. Repeated rows are one
    document; rows of one id with unlike texts are several. Very long texts are read whole, an
    empty table stays empty, and columns may have any names.
    """
    from quirespark.llm.nearcopies import keep_first_copies

    return keep_first_copies(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, long ones with better odds.

    A null source is a source; null and empty texts have no words, and draw like any others.
    Ties of rank go to the smaller id, then size; repeated rows are taken together or not at
    all. An empty table stays empty, and columns may have any names.
    """
    from quirespark.llm.mixing import by_length, repeat_copies

    return repeat_copies(docs, importance=by_length(F.col("text")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document is packed.

    Null and empty texts are one piece; very long ones are cut. Repeated rows and null ids are
    packed like any others; an empty table gives no piece. Other columns are not read.
    """
    import public_tokenizers

    from quirespark.llm.packing import pack_documents

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language ID", language_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express neither the classifiers nor the tokeniser; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
