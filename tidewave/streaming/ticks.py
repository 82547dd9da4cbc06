"""Time buckets over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_ticks(events: DataFrame, time: str, values: list[str], width: str, by: list[str], late: str = "1 hour") -> DataFrame:
    """Sums and counts in tumbling windows with a watermark: a window is final, and its state dropped, once events `late` beyond its end
    have come. Works alike on a batch."""
    w = F.window(time, width)
    return events.withWatermark(time, late).groupBy(w, *by).agg(F.count("*").alias("n"), *[F.sum(v).alias(v) for v in values]).select(F.col("window.start").alias("bucket"), *by, "n", *values)


def stream_distinct(events: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
