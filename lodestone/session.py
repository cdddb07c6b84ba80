"""Spark session with the settings the engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "lodestone", **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC, and shuffles sized by bytes rather than by a fixed count."""
    builder = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    } | conf
    return builder.config(map=settings).getOrCreate()
