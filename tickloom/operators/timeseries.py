"""Per-instrument window helpers. Every window uses the same partition and order
(`ts_code`, `trade_date`), so one exchange and one sort serve all of them.

A (ts_code, trade_date) pair is unique after the bar source, so a window never
holds more rows than the calendar has dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.window import WindowSpec

EPS = 1e-9
EMA_BLOCK = 512


def by_date() -> WindowSpec:
    return Window.partitionBy("ts_code").orderBy("trade_date")


def rows(a: int, b: int) -> WindowSpec:
    return by_date().rowsBetween(a, b)


def to_date_rows() -> WindowSpec:
    return by_date().rowsBetween(Window.unboundedPreceding, 0)


def whole() -> WindowSpec:
    return Window.partitionBy("ts_code")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def full(agg: Column, value, n: int) -> Column:
    """A trailing n-row aggregate, null until n non-null values are in the frame."""
    w = rows(-(n - 1), 0)
    return F.when(F.count(_c(value)).over(w) == n, agg.over(w))


def sma(value, n: int) -> Column:
    return full(F.avg(_c(value)), value, n)


def true_range() -> Column:
    pc = F.lag("close").over(by_date())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - pc), F.abs(F.col("low") - pc))


def with_row_number(df: DataFrame, name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(by_date()))


def add_ema(df: DataFrame, span: int, columns: dict[str, str], start: int = 1) -> DataFrame:
    """Recursive mean y = (1-a)*y + a*x with y = x on row `start`, for several columns at once.

    y is a weighted prefix sum. Weights are taken relative to blocks of 512 rows so
    that they stay finite on long histories; what reaches past the previous block is
    below (1-a)^512, far under double precision for the spans in use. Needs `rn`.
    """
    a = 2.0 / (span + 1)
    keep = 1.0 - a
    if keep ** EMA_BLOCK > 1e-12:
        raise ValueError(f"span {span} reaches past the {EMA_BLOCK} rows that are carried")
    idx = F.col("rn") - start
    block = F.floor(idx / EMA_BLOCK)
    pos = idx - block * EMA_BLOCK
    df = df.withColumn("_blk", F.when(idx >= 0, block)).withColumn("_pos", F.when(idx >= 0, pos))
    local = Window.partitionBy("ts_code", "_blk").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    weight = F.when(idx == 0, F.lit(1.0)).otherwise(F.lit(a))
    for src, dst in columns.items():
        part = F.sum(weight * F.col(src) * F.pow(F.lit(keep), -F.col("_pos"))).over(local)
        df = df.withColumn(f"_loc_{dst}", part * F.pow(F.lit(keep), F.col("_pos")))
    before = Window.partitionBy("ts_code").orderBy("_blk").rangeBetween(-1, -1)
    for dst in columns.values():
        carry = F.max_by(f"_loc_{dst}", "_pos").over(before)
        df = df.withColumn(
            dst,
            F.when(F.col("_pos").isNotNull(),
                   F.col(f"_loc_{dst}") + F.coalesce(carry * F.pow(F.lit(keep), F.col("_pos") + 1), F.lit(0.0))),
        )
    return df.drop("_blk", "_pos", *[f"_loc_{d}" for d in columns.values()])


def latest(df: DataFrame) -> DataFrame:
    """Last row per instrument."""
    return (
        df.withColumn("_back", F.row_number().over(Window.partitionBy("ts_code").orderBy(F.col("trade_date").desc())))
        .where("_back = 1").drop("_back")
    )


def is_last() -> Column:
    """True on the last bar without re-sorting: no following row in the shared window."""
    return F.lead("trade_date").over(by_date()).isNull()
