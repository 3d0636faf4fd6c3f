"""Publishing cadence over a stream of events, with late rows held back by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, every: str = "1 day", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) for each tumbling window; works on streams and on tables."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need a zone
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_seen(events: DataFrame, key: str, ttl: str = "24 hours") -> DataFrame:
    """The first event of each key within the time to live."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
