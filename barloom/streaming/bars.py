"""Bars from a stream of prints: closed windows only, late prints dropped at the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streamed_bars(events: DataFrame, width: str = "1 hour", grace: str = "15 minutes") -> DataFrame:
    """asset, ts, OHLC, volume of ``events`` (event_id, ts timestamp, event_type, value).

    An event id counts once within the grace; in append mode a window appears
    when the watermark has passed its end, which is when its bar is final.
    """
    key = F.struct("ts", "event_id")
    once = events.withWatermark("ts", grace).dropDuplicatesWithinWatermark(["event_id"])
    return (
        once.groupBy(F.col("event_type").alias("asset"), F.window("ts", width).alias("w"))
        .agg(
            F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
            F.max_by("value", key).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .select("asset", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )
