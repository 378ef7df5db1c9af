"""Streaming forms of metering and of repeated messages. Extensions: the batch operators define the results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage_by_window(usage: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """usage: (org, event_type, quantity, created_at timestamp). Quantities by window, organisation and kind; rows later than `late` are dropped."""
    grouped = usage.withWatermark("created_at", late).groupBy(F.window("created_at", window), "org", "event_type")
    return grouped.agg(F.sum("quantity").cast("long").alias("total")).select(F.col("window.start").alias("start"), "org", "event_type", "total")


def once(messages: DataFrame, key: str, late: str = "1 day") -> DataFrame:
    """Messages (key, created_at) without repeats of a key within the watermark."""
    return messages.withWatermark("created_at", late).dropDuplicatesWithinWatermark([key])
