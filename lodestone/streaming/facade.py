"""Structured Streaming forms of the engine's transforms. All use event time and a watermark, so state is bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", per_trigger: int = 16) -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", per_trigger).load(path)


def first_seen(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first row of each key while the watermark keeps it: duplicates, resubmitted tasks, repeated frames."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, key: str, gap: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Rows of a key at most ``gap`` apart, as one span."""
    s = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("parts"), F.max(ts).alias("last"))
    return s.select(key, F.col("w.start").alias("start_time"), F.col("last").alias("end_time"), "parts")


def sliding(events: DataFrame, size: str, step: str, by: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Sliding windows aligned to the epoch, with counts."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, size, step).alias("w"), *by).agg(F.count("*").alias("n"))
    return w.select(*by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def scanned(docs: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """The batch scan over a stream of documents: it is stateless, so it is the same transform."""
    from lodestone.operators.scans import pattern_spans

    return pattern_spans(docs, patterns)
