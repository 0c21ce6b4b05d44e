"""Streams of moments: rates per tumbling bucket, sessions and duplicates, with watermarks.

Extensions of the batch operators to Structured Streaming: the fixed buckets of
the running-time walk, the gap-based islands and the record store's duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucket_counts(events: DataFrame, keys: list[str], ts: str = "ts", width: str = "120 seconds", late: str = "10 minutes") -> DataFrame:
    """Events per key and tumbling bucket; buckets close when the watermark has passed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("window.start").alias("t0"), "n")


def islands(events: DataFrame, keys: list[str], ts: str = "ts", gap: str = "120 seconds", late: str = "10 minutes") -> DataFrame:
    """Runs of events that no gap splits."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n")).select(
        *keys, F.col("session_window.start").alias("lo"), F.col("session_window.end").alias("hi"), "n"
    )


def first_records(records: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """One record per key within the watermark."""
    return records.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
