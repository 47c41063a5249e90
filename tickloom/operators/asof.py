"""As-of joins between bars and dates.

Dates asked for are first reduced to distinct (ts_code, date) pairs, so a window
holds at most the calendar twice however often a pair is asked for. The answer is
joined back on the pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def _merged(bars: DataFrame, targets: DataFrame, date_col: str, payload: list[str]) -> DataFrame:
    keys = targets.select("ts_code", F.col(date_col).alias("_d")).distinct()
    shape = bars.select("ts_code", F.col("trade_date").alias("_d"), F.struct(*payload).alias("_bar"))
    return shape.withColumn("_ask", F.lit(0)).unionByName(
        keys.withColumn("_bar", F.lit(None).cast(shape.schema["_bar"].dataType)).withColumn("_ask", F.lit(1)))


def _answer(merged: DataFrame, order: list[Column], targets: DataFrame, date_col: str, payload: list[str], has_bars: str | None) -> DataFrame:
    w = Window.partitionBy("ts_code").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = merged.withColumn("_hit", F.last("_bar", True).over(w))
    extra = []
    if has_bars:
        found = found.withColumn(has_bars, F.count("_bar").over(Window.partitionBy("ts_code")) > 0)
        extra = [has_bars]
    found = found.where("_ask = 1").select(
        "ts_code", F.col("_d").alias(date_col), *[F.col(f"_hit.{p}").alias(p) for p in payload], *extra)
    return targets.join(found, ["ts_code", date_col], "left")


def last_bar_at_or_before(bars: DataFrame, targets: DataFrame, date_col: str, payload: list[str]) -> DataFrame:
    """Adds `payload` of the last bar with trade_date <= the target date."""
    m = _merged(bars, targets, date_col, payload)
    return _answer(m, [F.asc("_d"), F.asc("_ask")], targets, date_col, payload, None)


def first_bar_after(bars: DataFrame, targets: DataFrame, date_col: str, payload: list[str], has_bars: str | None = None) -> DataFrame:
    """Adds `payload` of the first bar with trade_date > the target date."""
    m = _merged(bars, targets, date_col, payload)
    return _answer(m, [F.desc("_d"), F.desc("_ask")], targets, date_col, payload, has_bars)
