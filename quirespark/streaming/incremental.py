"""Conversion of files as they arrive; content hashes are the manifest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quirespark.plans.convert import convert
from quirespark.schemas import Options
from quirespark.sources.files import name_of

_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, root: str, glob: str | None = None, files_per_trigger: int = 1000) -> DataFrame:
    """New files below ``root``: path, name, modified, length, content, sha1."""
    reader = spark.readStream.format("binaryFile").schema(_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(root)
    return df.select("path", name_of(F.col("path")).alias("name"), F.col("modificationTime").alias("modified"), "length", "content", F.sha1("content").alias("sha1"))


def once_each(files: DataFrame, delay: str = "7 days") -> DataFrame:
    """Files whose content was not seen within ``delay``: bounded state, by watermark."""
    return files.withWatermark("modified", delay).dropDuplicatesWithinWatermark(["sha1"])


def convert_stream(files: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, options: Options | None = None) -> StreamingQuery:
    """Convert each micro-batch and hand it to ``sink``. A batch that runs again has the same
    number, by which the sink can write it once."""
    return (
        files.writeStream.foreachBatch(lambda batch, n: sink(convert(batch.drop("modified"), options), n))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def status_counts(results: DataFrame, time_col: str, window: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Statuses by event-time window, for results that carry a time."""
    return results.withWatermark(time_col, delay).groupBy(F.window(time_col, window), "status").agg(F.count("*").alias("n"))
