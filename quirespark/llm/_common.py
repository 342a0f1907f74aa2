"""Shared plumbing: the shared scratch folder, materialised tables, components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary one of our own only in local mode."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that every executor shares")
    made = tempfile.mkdtemp(prefix="quirespark-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def named(column: str) -> F.Column:
    """The column of exactly that name, dots and back quotes included."""
    return F.col("`" + column.replace("`", "``") + "`")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores behind it until no column in ``taken`` is called so."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: whatever executor is lost later, the rows are still there. The
    work is done once, and later readers prune columns.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete a table made by materialise() that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links -> (node, root), root being the smallest node that can be reached.

    Alternates large-star and small-star steps. A node's smallest neighbour is found by a
    hash aggregation (combined before the shuffle) and joined back, so that a hub with very
    many links is never gathered in one task. Each round is materialised. Raises if it has
    not converged after ``max_rounds``, which allows far more than log2 of any component.
    """
    now = materialise(
        edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .where("hi <> lo").distinct(),
        "links",
    )
    mark = None
    for _ in range(max_rounds):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(
            now.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
        )
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.where("v > u").join(least, "u")
            .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        )
        floor = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(floor, "hi")
            .select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")),
                                      F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
            .select("e.hi", "e.lo").where("hi <> lo").distinct()
        )
        after = materialise(small, "links")
        seen = after.agg(
            F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))
        ).first()
        release(now)
        now = after
        if seen == mark:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        mark = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
