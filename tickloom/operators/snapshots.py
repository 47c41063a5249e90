"""Immutable signal snapshots: normalised cells, payload hashes, conflict check and append."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.sources.workspace import saved

KEY = ["run_id", "signal_date", "ts_code"]
UNHASHED = ("snapshot_created_at", "signal_payload_hash")


def config_hash(config: dict) -> str:
    """First 16 hex digits of the SHA-256 of a configuration as canonical JSON."""
    text = json.dumps(config, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def parse_signal_date(c: Column) -> Column:
    """A date from 'YYYYMMDD' or an ISO date or timestamp text."""
    text = c.cast("string")
    return F.when(text.rlike(r"^\d{8}$"), F.try_to_timestamp(text, F.lit("yyyyMMdd")).cast("date")).otherwise(
        F.try_to_timestamp(text).cast("date"))


def normalise_cells(df: DataFrame) -> DataFrame:
    """Nested cells become JSON text, NaN becomes null."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.when(c.isNotNull(), F.to_json(c))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def payload_hash(columns: list[str]) -> Column:
    """SHA-256 over the row as JSON with sorted keys; nulls are kept in the text."""
    cols = sorted(c for c in columns if c not in UNHASHED)
    return F.sha2(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}), 256)


def prepare(candidates: DataFrame, version: str, cfg_hash: str, created_at: str) -> DataFrame:
    rows = normalise_cells(candidates).select(
        "*", F.lit(version).alias("agent_version"), F.lit(cfg_hash).alias("config_hash"),
        F.lit(created_at).alias("snapshot_created_at"))
    return rows.withColumn("signal_payload_hash", payload_hash(rows.columns))


def duplicate_keys(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


def conflicts(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Keys stored before with another payload."""
    old = existing.select(*KEY, F.col("signal_payload_hash").alias("_old"))
    return new.join(old, KEY).where(F.col("signal_payload_hash") != F.col("_old")).select(*KEY)


def to_append(new: DataFrame, existing: DataFrame) -> DataFrame:
    return new.join(existing.select(*KEY), KEY, "left_anti")


def append_snapshots(spark: SparkSession, path: str, new: DataFrame, idempotent: bool = True) -> int:
    """Checks keys and payloads, then adds only unseen rows as new files; stored rows are never rewritten.

    The hash covers candidate columns alone, so a re-run at another time stays idempotent.
    """
    new = saved(new, "snapshot")  # the candidates are computed once
    if not new.take(1):
        raise ValueError("cannot snapshot an empty candidate table")
    dup = duplicate_keys(new).take(5)
    if dup:
        raise ValueError(f"duplicate snapshot keys: {dup}")
    days = [r.signal_date for r in new.select("signal_date").distinct().collect()]  # a calendar's size
    existing = stored_days(spark, path, days)
    rows = new
    if existing is not None:
        # conflict and novelty from one join with the stored rows of the same days
        old = existing.select(*KEY, F.coalesce("signal_payload_hash", F.lit("")).alias("_old"))
        met = saved(new.join(old, KEY, "left"), "met")
        clash = met.where("_old IS NOT NULL AND NOT (signal_payload_hash <=> _old)").select(*KEY).take(5)
        if clash:
            raise ValueError(f"conflicting immutable snapshot rows: {clash}")
        if not idempotent and met.where("_old IS NOT NULL").take(1):
            raise ValueError("snapshot rows already exist")
        rows = met.where("_old IS NULL").drop("_old")
    fresh = rows.count()
    if fresh:
        rows.repartition("signal_date").sortWithinPartitions("signal_date", "run_id", "ts_code").write.mode("append").partitionBy(
            "signal_date").parquet(path)
    return fresh


def stored_days(spark: SparkSession, path: str, days: list) -> DataFrame | None:
    """Stored rows of these days; files of other days are not read. None where there is no table yet."""
    try:
        return spark.read.parquet(path).where(F.col("signal_date").isin(days))
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return None
