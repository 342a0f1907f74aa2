"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quirespark.llm.packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirespark.llm.mixing import by_length, mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"), importance=by_length(F.col("text"))).select("doc_id", "size", "source_size", "target", "taken")


def op3_lm_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirespark.llm.corpusparse import parse_corpus

    return parse_corpus(_table(spark, sf_dir, "documents"))


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirespark.llm.toxicity import fit_toxicity, score_toxicity

    docs = _table(spark, sf_dir, "documents")
    chain = fit_toxicity(docs, _table(spark, sf_dir, "labels"), {"junk": "1 - quality", "toxic": "toxic"})
    return score_toxicity(docs, chain)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirespark.llm.quality import fit_quality, score_quality

    docs = _table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, _table(spark, sf_dir, "labels")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirespark.llm.language import fit_languages, identify_languages

    docs = _table(spark, sf_dir, "documents")
    return identify_languages(docs, fit_languages(docs))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirespark.llm.simhash import simhash_groups

    return simhash_groups(_table(spark, sf_dir, "documents"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirespark.llm.neighbours import nearest

    return nearest(_table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirespark.llm.chat import format_chats, read_back

    said = "</s>[INST] ok [/INST]"
    chats = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).selectExpr("-1L", "id", "if(id = 0, 'user', 'assistant')", f"'{said}'")
    return read_back(format_chats(chats.unionAll(more)))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirespark.llm.media import media_column

    return media_column(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_source_mixing, op3_lm_cross_parsing, op4_toxicity_chain,
        op5_quality_classifier, op6_language_id, op7_simhash_near_dedup,
        op8_nearest_neighbours, op9_chat_formatting, op10_media_columns,
    )
}

_OP2 = r"""
WITH sized AS (
  SELECT *, CASE WHEN size < 50 THEN 0.5::DOUBLE WHEN size < 500 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w
  FROM (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents)
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS weight
  FROM sized GROUP BY source
), limits AS (
  SELECT *, source_size * 3.0::DOUBLE AS lim, source_size * 3.0::DOUBLE / weight AS level FROM sources
), shares AS (
  SELECT *, ((SELECT sum(source_size) FROM sources)::DOUBLE - coalesce(sum(lim) OVER v, 0.0::DOUBLE))
            / ((SELECT sum(weight) FROM sources) - coalesce(sum(weight) OVER v, 0.0::DOUBLE)) AS share
  FROM limits WINDOW v AS (ORDER BY level, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), common AS (
  SELECT arg_min(share, level) AS t FROM shares WHERE share < level
), targets AS (
  SELECT source, source_size,
         CASE WHEN t IS NULL THEN lim ELSE least(lim, t * weight) END AS target
  FROM limits CROSS JOIN common
), classes AS (
  SELECT source, w, coalesce(sum(words) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above,
         sum(words * w) OVER (PARTITION BY source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS mass
  FROM (SELECT source, w, sum(size)::BIGINT AS words FROM sized GROUP BY source, w)
), ratios AS (
  SELECT t.source, t.source_size, t.target, arg_max(r, w) FILTER (WHERE r * w < 3) AS ratio
  FROM (SELECT t.*, c.w, CASE WHEN c.mass > 0 THEN (t.target - 3.0::DOUBLE * c.above) / c.mass END AS r
        FROM targets t LEFT JOIN classes c ON t.source IS NOT DISTINCT FROM c.source) t
  GROUP BY ALL
), hoped AS (
  SELECT d.doc_id, d.size, p.source, p.source_size, p.target, CASE WHEN p.ratio IS NULL THEN 3.0::DOUBLE ELSE least(p.ratio * d.w, 3.0::DOUBLE) END AS expected
  FROM sized d JOIN ratios p ON d.source IS NOT DISTINCT FROM p.source
), drawn AS (
  SELECT *, floor(expected) AS certain, expected - floor(expected) AS rest,
         target - sum(floor(expected) * size) OVER (PARTITION BY source) AS missing,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u
  FROM hoped
), ranked AS (
  SELECT *, CASE WHEN rest > 0 THEN (u / (1 - u)) / (rest / (1 - rest)) ELSE 'infinity'::DOUBLE END AS rank FROM drawn
), summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM ranked
)
SELECT doc_id, size, source_size, target,
       ((certain + CASE WHEN rest > 0 AND before + size / 2.0::DOUBLE < missing THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM summed
"""

ORACLE_SQL = {"op2_source_mixing": _OP2}
