"""Mixing sources to target weights by Pareto order sampling; DataFrame functions only.

A document's expected copies are in proportion to its importance, never above the cap, and as
many as bring its source's words to the source's target. The whole part of them is certain. For the rest p, every document draws a fixed
uniform number u from its id and is ranked by its random odds over its inclusion odds,
(u / (1 - u)) / (p / (1 - p)); the lowest ranks are taken until the words still missing are
reached. Ranks are never sorted as a whole: words are summed by source and rank bucket before
any shuffle, the bucket in which a source's target falls is found from these sums, and only
that bucket's documents are put in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirespark.llm._common import fresh, materialise, named

BUCKETS = 4096
_UNIFORM = float(1 << 48)


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def by_length(text: F.Column, short: int = 50, long: int = 500) -> F.Column:
    """An importance for mixing: fragments of under ``short`` words have half the odds of a
    document, those of ``long`` words or more have double."""
    size = word_count(text)
    return F.when(size < short, F.lit(0.5)).when(size < long, F.lit(1.0)).otherwise(F.lit(2.0))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size, target) from (source, size); one row a source.

    Sources in code point order, null last, have ``weights`` in turn. Targets share the total
    size by weight; none is above ``cap`` times its source's size, and what is over goes to
    the others by weight until none is above. In order of cap over weight, a source is at its
    cap as long as the level that the others would get exceeds its own.
    """
    total = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    ranked = (
        total.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn))
        .withColumn("limit", F.col("source_size") * F.lit(float(cap)))
        .withColumn("level", F.col("limit") / F.col("weight"))
        .withColumn("all_size", F.sum("source_size").over(everything).cast("double"))
        .withColumn("all_weight", F.sum("weight").over(everything))
        .withColumn("left_size", F.col("all_size") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("share", F.col("left_size") / F.col("left_weight"))
    )
    # The first source that is not capped sets the level for all that follow it.
    level = F.min(F.when(F.col("share") < F.col("level"), F.struct("level", "share"))).over(everything)["share"]
    return ranked.withColumn("common", level).select(
        "source", "source_size",
        F.when(F.col("common").isNull(), F.col("limit"))
        .otherwise(F.least("limit", F.col("common") * F.col("weight"))).alias("target"),
    )


def uniform(key: F.Column) -> F.Column:
    """A number inside (0, 1) that only depends on the key, with 48 random bits."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(_UNIFORM)


def _with_plan(rows: DataFrame, plan: DataFrame, few: bool, salts: int = 16) -> DataFrame:
    """``rows`` with their source's plan. The plan has one row a source: broadcast if its
    count was found small, else joined on source and a salt, so that a hot source is split."""
    plan = plan.withColumnRenamed("source", "of")
    same = F.col("source").eqNullSafe(F.col("of"))
    if few:
        return rows.join(F.broadcast(plan), same).drop("of")
    plan = plan.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("salt_", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    return rows.join(plan, same & (F.col("salt_") == F.col("salt"))).drop("of", "salt", "salt_")


def _rounded(weight: F.Column) -> F.Column:
    """Importance to three significant digits, so that a source has few different ones."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(weight)))
    return F.when(weight > 0, F.round(weight / unit, 2) * unit).otherwise(F.lit(0.0))


def _levels(sizes: DataFrame, targets: DataFrame, cap: float) -> DataFrame:
    """(source, source_size, target, ratio): expected copies are ratio times importance, ``cap`` at most.

    In order of importance downwards, a class of documents is at the cap as long as the ratio
    that it and the less important ones would get brings it there; ratio is null where all are.
    One row a source and importance, summed before the shuffle.
    """
    classes = sizes.where("weight > 0").groupBy(F.col("source").alias("of"), "weight").agg(F.sum("size").alias("words"))
    down = Window.partitionBy("of").orderBy(F.desc("weight"))
    classes = classes.select(
        "of", "weight", F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"),
        F.sum(F.col("words") * F.col("weight")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("mass"),
    )
    share = (F.col("target") - F.lit(float(cap)) * F.col("above")) / F.col("mass")
    both = targets.join(classes, F.col("source").eqNullSafe(F.col("of")), "left").withColumn("share", F.when(F.col("mass") > 0, share))
    heaviest = F.max(F.when(F.col("share") * F.col("weight") < F.lit(float(cap)), F.struct("weight", "share")))
    return both.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), heaviest["share"].alias("ratio"))


def _drawn(rows: DataFrame, cap: float, buckets: int) -> DataFrame:
    """Every row's certain copies, the odds of one more, its Pareto rank and that's bucket."""
    u, p, rank = F.col("u"), F.col("rest"), F.col("rank")
    expected = F.when(F.col("weight") > 0, F.least(F.coalesce(F.col("ratio"), F.lit(float("inf"))) * F.col("weight"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    return (
        rows.withColumn("expected", expected)
        .withColumns({"certain": F.floor("expected").cast("long"), "rest": F.col("expected") - F.floor("expected"), "u": uniform(F.col("id"))})
        .withColumn("rank", F.when(p > 0, (u / (1 - u)) / (p / (1 - p))).otherwise(float("inf")))
        .withColumn("bucket", F.when(p > 0, F.least(F.floor(rank / (1 + rank) * buckets), F.lit(buckets - 1))).otherwise(buckets).cast("int"))
    )


def _placed(
    docs: DataFrame, keep: list[str], weights: tuple[float, ...], cap: float, id_col: str, text_col: str, source_col: str,
    importance: str | F.Column | None, buckets: int, few_sources: int,
) -> DataFrame:
    """Columns k0, k1 ... (those of ``keep``), size, source_size, target, copies: a row a row of ``docs``."""
    size = word_count(named(text_col).cast("string"))
    given = named(importance) if isinstance(importance, str) else importance
    weight = F.lit(1.0) if given is None else _rounded(F.coalesce(given.cast("double"), F.lit(0.0)))
    narrow = [named(id_col).alias("id"), named(source_col).alias("source"), size.alias("size"), weight.alias("weight")]
    sizes = materialise(docs.select(narrow), "sizes")
    plan = materialise(_levels(sizes, source_targets(sizes, weights, cap), cap), "plan")
    few = plan.count() <= few_sources
    ranked = _drawn(_with_plan(sizes, plan, few), cap, buckets)

    # Words by source and bucket; the last bucket holds those that can give no more copies.
    whole = Window.partitionBy("source")
    so_far = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = materialise(
        ranked.groupBy("source", "bucket")
        .agg(F.sum("size").alias("words"), F.sum(F.col("certain") * F.col("size")).alias("sure"), F.first("target").alias("target"))
        .withColumn("missing", F.col("target") - F.sum("sure").over(whole))
        .withColumn("before", F.coalesce(F.sum("words").over(so_far), F.lit(0)))
        .withColumn("here", (F.col("bucket") < buckets) & (F.col("before") < F.col("missing")) & (F.col("before") + F.col("words") >= F.col("missing")))
        # Where even all are too few, the edge is behind the last bucket.
        .groupBy("source").agg(F.min(F.when(F.col("here"), F.struct("bucket", "before"))).alias("found"), F.max("missing").alias("missing"),
                               F.sum(F.when(F.col("bucket") < buckets, F.col("words"))).alias("all"))
        .select("source", "missing", F.coalesce("found.bucket", F.when(F.col("missing") > F.col("all"), F.lit(buckets))).alias("edge"), "found.before"),
        "edge",
    )
    inside = Window.partitionBy("source").orderBy("rank", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    on_edge = _with_plan(ranked, edge, few).where(F.col("bucket") == F.col("edge"))
    cut = (
        on_edge.where(F.col("rest") > 0).groupBy("source", "rank", "id", "size")
        .agg(F.count("*").alias("n"), F.first("before").alias("before"), F.first("missing").alias("missing"))
        .withColumn("at", F.col("before") + F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)))
        # The last one is taken if that brings the sum nearer to what is missing.
        .where(F.col("at") + F.col("size") * F.col("n") / 2 < F.col("missing"))
        .groupBy("source").agg(F.max(F.struct("rank", "id", "size")).alias("last"))
    )
    edge = edge.select(F.col("source").alias("e_source"), "edge")
    cut = cut.withColumnRenamed("source", "c_source")
    final = materialise(
        plan.join(edge, plan.source.eqNullSafe(edge.e_source), "left").join(cut, plan.source.eqNullSafe(cut.c_source), "left")
        .select("source", "source_size", "target", "ratio", "edge", "last"),
        "cuts",
    )
    if keep == [id_col, source_col]:
        rows = sizes.select(F.col("id").alias("k0"), F.col("source").alias("k1"), "id", "source", "size", "weight")
    else:
        rows = docs.select(*[named(c).alias(f"k{i}") for i, c in enumerate(keep)], *narrow)
    placed = _drawn(_with_plan(rows, final, few), cap, buckets)
    mine = F.struct("rank", "id", "size")
    taken = (F.col("rest") > 0) & (
        (F.col("bucket") < F.col("edge")) | ((F.col("bucket") == F.col("edge")) & F.coalesce(mine <= F.col("last"), F.lit(False)))
    )
    copies = (F.col("certain") + F.when(taken, 1).otherwise(0)).cast("long")
    return placed.select(*[f"k{i}" for i in range(len(keep))], "size", "source_size", "target", copies.alias("copies"))


_RESULT = ("size", "source_size", "target", "copies", "taken")


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", importance: str | F.Column | None = None, keep: list[str] | None = None,
    buckets: int = BUCKETS, few_sources: int = 20_000,
) -> DataFrame:
    """A row a row of ``docs``: the columns ``keep`` (id and source if not given), then size,
    source_size, target, copies (how often the mix takes it) and taken (copies times size).

    ``importance`` is a column, or its name (null, zero and negative: never taken; others to
    three significant digits). Expected copies are in proportion to it within a source, never
    above ``cap``; without it all documents of a source have the same odds. A source whose
    important documents are too few for its target stays below it.

    Null text has size 0; null source is a source. Very long texts are counted whole. Rows of
    the same id draw the same number; among equal ranks the smaller id, then the smaller size,
    is taken first, and rows equal in all three are taken together or not at all. An empty
    table gives an empty result; other columns are not read. A result column that has the name
    of a kept one gets an underscore behind it. If all texts are blank, all targets are 0.
    Documents themselves are never shuffled: each source's last taken (rank, id, size) is found
    from narrow rows, and every document compares its own with it. The sources' totals, one row
    a source, are ordered in one task.
    """
    keep = keep or [id_col, source_col]
    made = _placed(docs, keep, weights, cap, id_col, text_col, source_col, importance, buckets, few_sources)
    made = made.withColumn("taken", F.col("copies") * F.col("size"))
    return made.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(c).alias(fresh(c, keep)) for c in _RESULT])


def repeat_copies(
    docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", importance: str | F.Column | None = None, buckets: int = BUCKETS, few_sources: int = 20_000,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as the mix takes it."""
    made = _placed(docs, docs.columns, weights, cap, id_col, text_col, source_col, importance, buckets, few_sources).where("copies > 0")
    made = made.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return made.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)])
