"""A session with settings that suit document work."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """Adaptive plans, UTC, and small Arrow batches, since a row may be a whole document."""
    builder = SparkSession.builder.appName("quirespark")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "256", "spark.ui.showConsoleProgress": "false", **conf,
    }
    return builder.config(map=settings).getOrCreate()
