"""Running history of a key over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_history(events: DataFrame, key: str, value: str, ts: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window, key, n, mean) of a streaming or batch table; rows later than ``late`` are left out of a stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
