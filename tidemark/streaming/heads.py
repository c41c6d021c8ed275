"""Streams of versions: running heads and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_heads(versions: DataFrame, key: str = "id") -> DataFrame:
    """The newest version of each record so far (update or complete mode)."""
    return versions.groupBy(key).agg(F.max("version").alias("version"), F.max_by("retracted", "version").alias("retracted"))


def windowed_counts(events: DataFrame, time: str, kind: str, width: str, late: str) -> DataFrame:
    """Counts by window and kind; rows later than ``late`` are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"))
