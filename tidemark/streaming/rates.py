"""Streamed counts: the binned chat signal as an event-time aggregate with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counted(events: DataFrame, width: str, late: str) -> DataFrame:
    """Events (ts, series_id) per window; works on a stream and on a table."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy("series_id", F.window("ts", width)).agg(F.count("*").alias("n")).select("series_id", F.col("window.start").alias("start"), "n")
