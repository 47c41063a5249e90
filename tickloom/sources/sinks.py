"""Sinks: Parquet tables, formatted top lists, event traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.readers import keep_last, merge_feeds, read_table, upsert_quarters
from tickloom.sources.workspace import saved


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def merge_statements(spark: SparkSession, path: str, feeds: list[DataFrame], keep: int = 12, parts: int = 64) -> None:
    """Merges statement feeds into a stored table, fresh quarters winning, the last `keep` quarters of each instrument staying.

    The table is partitioned by a hash of the instrument, as a merge needs all quarters of one. Only the partitions that the feeds touch are
    read, and written over; files of others stay as they are. A rerun with the same feeds gives the same rows."""
    fresh = merge_feeds(feeds).where("ts_code IS NOT NULL AND end_date IS NOT NULL").withColumn("part", F.pmod(F.xxhash64("ts_code"), F.lit(parts)).cast("int"))
    fresh = saved(keep_last(fresh.withColumn("_seq", F.monotonically_increasing_id()), ["ts_code", "end_date"], "_seq").drop("_seq"), "feeds")
    touched = [r.part for r in fresh.select("part").distinct().collect()]  # `parts` rows at most
    stored = read_table(spark, path, "parquet", fresh.schema).where(F.col("part").isin(touched))
    merged = saved(upsert_quarters(stored, fresh, keep), "merged")  # a table can't be written over while it is read
    merged.repartition("part").sortWithinPartitions("part", "ts_code", "end_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def top_candidates(df: DataFrame, n: int = 50) -> DataFrame:
    """Best rows with the columns of the exported list, numbers as text."""
    return df.orderBy(F.desc("composite_score"), "ts_code").limit(n).select(
        "ts_code", "name", "industry", F.format_string("%.2f", "composite_score").alias("composite_score"),
        F.format_string("%.1f亿", F.col("market_cap") / 1e8).alias("market_cap"), F.format_string("%.2f%%", F.col("volatility") * 100).alias("volatility"))


def save_top(df: DataFrame, path: str, fmt: str = "json", n: int = 50) -> None:
    w = top_candidates(df, n).coalesce(1).write.mode("overwrite")
    w.json(path) if fmt == "json" else w.option("header", True).csv(path)


def append_trace(spark: SparkSession, path: str, events: DataFrame) -> None:
    """Appends {ts, event, payload} lines."""
    events.select("ts", "event", F.col("payload").cast("string").alias("payload")).write.mode("append").json(path)
