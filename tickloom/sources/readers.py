"""Readers: normalise names, types and duplicates once, at the source."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

BAR_NUMBERS = ("open", "high", "low", "close", "pre_close", "vol", "amount", "turnover_rate", "total_mv", "pe", "pe_ttm", "pb", "ps", "ps_ttm")
DATE_ALIASES = ("end_date", "report_date", "ann_date", "f_ann_date", "trade_date")


def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | None = None) -> DataFrame:
    """A table by its suffix (parquet, csv, json); with a schema a missing path reads as empty."""
    kind = fmt or ("csv" if path.endswith((".csv", ".txt")) else "json" if path.endswith((".json", ".jsonl")) else "parquet")
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        reader = reader.option("header", True)
    try:
        df = reader.format(kind).load(path)
        df.schema  # noqa: B018  resolves the path now
        return df
    except AnalysisException as exc:
        if schema is not None and "PATH_NOT_FOUND" in str(exc):
            return spark.createDataFrame([], schema)
        raise


def to_day(c: Column) -> Column:
    """A date from 'YYYYMMDD' text, ISO text or a date."""
    text = c.cast("string")
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyyMMdd")), F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))).cast("date")


def normalise_bars(raw: DataFrame) -> DataFrame:
    """Bars with date keys and double measures; `volume` becomes `vol`, non-positive prices go."""
    if "volume" in raw.columns and "vol" not in raw.columns:
        raw = raw.withColumnRenamed("volume", "vol")
    nums = [F.col(c).try_cast("double").alias(c) for c in BAR_NUMBERS if c in raw.columns]
    out = raw.select("ts_code", to_day(F.col("trade_date")).alias("trade_date"), *nums)
    ok = F.col("trade_date").isNotNull()
    for c in ("open", "high", "low", "close"):
        ok = ok & (F.col(c) > 0)
    return out.where(ok)


def read_bars(spark: SparkSession, path: str) -> DataFrame:
    """Per-instrument bar files with differing columns, united by name."""
    return normalise_bars(spark.read.option("mergeSchema", True).parquet(path))


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """Statement files whose columns differ, united by name, with one date column `end_date`: the first of DATE_ALIASES that
    a row has as a date. Rows without any go; the other alias columns stay as they are."""
    raw = spark.read.option("mergeSchema", True).parquet(path)
    known = [c for c in DATE_ALIASES if c in raw.columns]
    if not known:
        raise ValueError(f"no date column of {DATE_ALIASES} in {path}")
    return raw.withColumn("end_date", F.coalesce(*[to_day(F.col(c)) for c in known])).where("end_date IS NOT NULL")


def keep_last(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The last loaded row per key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(seq))
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def long_histories(bars: DataFrame, min_rows: int = 120) -> DataFrame:
    """Bars of instruments with enough rows."""
    n = bars.groupBy("ts_code").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows).select("ts_code")
    return bars.join(n, "ts_code", "left_semi")


def consolidate(bars: DataFrame, path: str, min_rows: int = 120) -> None:
    """Writes one sorted dataset of the instruments with enough rows."""
    long_histories(bars, min_rows).repartition("ts_code").sortWithinPartitions("ts_code", "trade_date").write.mode("overwrite").parquet(path)


def recent_days(bars: DataFrame, days: int, limit: int = 240) -> DataFrame:
    """Bars of the last calendar days before an instrument's own last date, newest first."""
    w = Window.partitionBy("ts_code")
    r = bars.withColumn("_last", F.max("trade_date").over(w)).where(F.col("trade_date") >= F.date_sub("_last", days))
    back = F.row_number().over(w.orderBy(F.desc("trade_date")))
    return r.withColumn("recency", back).where(F.col("recency") <= limit).drop("_last")


def instrument_codes(df: DataFrame) -> DataFrame:
    col = next(c for c in ("ts_code", "code", "symbol") if c in df.columns)
    return df.select(F.col(col).cast("string").alias("ts_code")).where("ts_code is not null").distinct()


def merge_feeds(feeds: list[DataFrame]) -> DataFrame:
    """Statement feeds joined on instrument and quarter; the first feed's column wins over a later one's."""
    keys = ["ts_code", "end_date"]
    out = feeds[0]
    for f in feeds[1:]:
        shared = [c for c in f.columns if c in out.columns and c not in keys]
        f2 = f.select(*keys, *[F.col(c).alias(f"_r_{c}") if c in shared else F.col(c) for c in f.columns if c not in keys])
        out = out.join(f2, keys, "full_outer")
        out = out.withColumns({c: F.coalesce(F.col(c), F.col(f"_r_{c}")) for c in shared}).drop(*[f"_r_{c}" for c in shared]) if shared else out
    return out


def upsert_quarters(stored: DataFrame, fresh: DataFrame, keep: int = 12) -> DataFrame:
    """Stored and fresh quarters, the fresh ones winning, cut to the last quarters per instrument."""
    u = stored.withColumn("_seq", F.lit(0)).unionByName(fresh.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    u = keep_last(u, ["ts_code", "end_date"], "_seq").drop("_seq")
    w = Window.partitionBy("ts_code").orderBy(F.desc("end_date"))
    return u.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= keep).drop("_k")


def last_completed_quarter(as_of: Column, grace_days: int = 7) -> Column:
    """End of the last quarter that was over `grace_days` ago."""
    return F.date_sub(F.trunc(F.date_sub(as_of, grace_days), "quarter"), 1)


def staleness_plan(instruments: DataFrame, stored: DataFrame, as_of: str, grace_days: int = 7) -> DataFrame:
    """new -> full load, stale -> reload from three months before the newest quarter, else skip."""
    have = stored.groupBy("ts_code").agg(F.max("end_date").alias("newest"))
    due = last_completed_quarter(F.lit(as_of).cast("date"), grace_days)
    j = instruments.select("ts_code").join(have, "ts_code", "left")
    action = F.when(F.col("newest").isNull(), "full").when(F.col("newest") < due, "stale").otherwise("skip")
    return j.select("ts_code", "newest", action.alias("action"), F.when(action == "stale", F.add_months("newest", -3)).alias("start_date"))


def latest_partition(df: DataFrame, date_col: str = "trade_date") -> DataFrame:
    return df.join(df.agg(F.max(date_col).alias(date_col)), date_col, "left_semi")


def merge_live(history: DataFrame, live: DataFrame) -> DataFrame:
    """History with today's live bar in place of a stored row of the same date; the origin is named."""
    u = history.withColumn("source", F.lit("history")).withColumn("_p", F.lit(0)).unionByName(
        live.withColumn("source", F.lit("live")).withColumn("_p", F.lit(1)), allowMissingColumns=True)
    return keep_last(u, ["ts_code", "trade_date"], "_p").drop("_p")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Event trace lines {ts, event, payload}; malformed lines are skipped."""
    return spark.read.schema("ts string, event string, payload string").option("mode", "DROPMALFORMED").json(path)
