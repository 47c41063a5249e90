"""Stream forms of the flow and snapshot jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import snapshots as S


def sliding_hits(events: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Listing events per instrument over 60-day windows sliding by a day; late rows fall to the watermark."""
    days = (events.withWatermark("ts", watermark).groupBy(F.window("ts", "1 day").alias("day"), "ts_code")
            .agg(F.count(F.lit(1)).alias("hits"), F.sum("value").alias("value")))
    # windows begin at midnight, so a day's rows share all their windows: a day is copied into them, not each event
    return (days.groupBy(F.window(F.window_time("day"), "60 days", "1 day").alias("window"), "ts_code")
            .agg(F.sum("hits").alias("hits"), F.sum("value").alias("value")))


def bars_from_events(events: DataFrame, width: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """Event-time bars from single prices."""
    return (events.withWatermark("ts", watermark).groupBy(F.window("ts", width), "ts_code")
            .agg(F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
                 F.max_by("value", "ts").alias("close"), F.count(F.lit(1)).alias("trades"))
            .select("ts_code", F.col("window.start").alias("bar_start"), "open", "high", "low", "close", "trades"))


def snapshot_sink(spark: SparkSession, path: str):
    """A foreachBatch function that appends unseen snapshot rows; a replayed batch adds nothing."""

    def write(batch: DataFrame, _epoch: int) -> None:
        if batch.take(1):
            S.append_snapshots(spark, path, batch)

    return write
