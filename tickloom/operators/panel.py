"""The factor panel: window features of every bar and forward returns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scores import snapped
from tickloom.operators.timeseries import by_date, rows, whole

HORIZONS = (1, 3, 5, 10, 20)

PANEL_FEATURES = (
    "breakout_proximity_20d", "breakout_proximity_60d", "lps_pullback", "ma_short_term_slope", "ma_trend_spread",
    "ma20_slope_5d", "vol_ratio", "vol_contraction", "gap_pct", "lower_wick_pct", "upper_wick_pct",
    "price_position_20d", "price_position_60d", "atr_pct", "bb_width", "joc_interaction", "turnover_accel",
    "range_pct_20d", "range_pct_60d",
)


def add_base_windows(bars: DataFrame) -> DataFrame:
    """Moving averages, ranges and deviation over partial frames, all in one window stage."""
    w = {n: rows(-(n - 1), 0) for n in (5, 10, 14, 20, 60)}
    return bars.select(
        "*",
        *[F.avg("close").over(w[n]).alias(f"ma{n}") for n in (5, 10, 20, 60)],
        *[F.avg("vol").over(w[n]).alias(f"vol_ma{n}") for n in (5, 20)],
        *[F.max("high").over(w[n]).alias(f"high_{n}d") for n in (5, 10, 20, 60)],
        *[F.min("low").over(w[n]).alias(f"low_{n}d") for n in (5, 20, 60)],
        F.avg(F.col("high") - F.col("low")).over(w[14]).alias("tr_avg_14"),
        F.max(F.col("high") - F.col("low")).over(w[14]).alias("tr_max_14"),
        F.stddev_samp("close").over(w[20]).alias("std_20d"),
        F.stddev_samp("close").over(w[60]).alias("std_60d"),
        F.avg("turnover_rate").over(w[20]).alias("turnover_ma20"),
        F.lag("close", 14).over(by_date()).alias("close_14_ago"),
        F.count(F.lit(1)).over(whole()).alias("stock_rows"),
        *[F.lead("close", h).over(by_date()).alias(f"_lead{h}") for h in HORIZONS],
    )


def add_features(base: DataFrame, exact_ties: bool = True) -> DataFrame:
    """Ratio features; a zero denominator gives null instead of an infinity.

    With `exact_ties` ratios of means that are equal are exactly 1; without, they are the doubles that adding rows in their order gives."""
    div = F.try_divide
    of_means = (lambda a, b: snapped(div(a, b))) if exact_ties else div
    c = F.col
    low_of_body = F.least("open", "close")
    high_of_body = F.greatest("open", "close")
    out = base.withColumn("_ma20_5", F.lag("ma20", 5).over(by_date()))
    return out.select(
        *base.columns,
        div(c("close") - c("high_20d"), c("high_20d")).alias("breakout_proximity_20d"),
        div(c("close") - c("high_60d"), c("high_60d")).alias("breakout_proximity_60d"),
        div(c("ma20") - c("close"), c("tr_avg_14")).alias("lps_pullback"),
        (c("ma5") - c("ma10")).alias("ma_short_term_slope"),
        (c("ma20") - c("ma60")).alias("ma_trend_spread"),
        div(c("ma20") - c("_ma20_5"), c("_ma20_5")).alias("ma20_slope_5d"),
        of_means(c("vol"), c("vol_ma20")).alias("vol_ratio"),
        of_means(c("vol_ma5"), c("vol_ma20")).alias("vol_contraction"),
        div(c("open") - c("pre_close"), c("pre_close")).alias("gap_pct"),
        F.when(c("open") > c("pre_close") * 1.005, 1.0).otherwise(0.0).alias("gap_up_flag"),
        div(low_of_body - c("low"), c("high") - c("low")).alias("lower_wick_pct"),
        div(c("high") - high_of_body, c("high") - c("low")).alias("upper_wick_pct"),
        div(c("close") - c("low_20d"), c("high_20d") - c("low_20d")).alias("price_position_20d"),
        div(c("close") - c("low_60d"), c("high_60d") - c("low_60d")).alias("price_position_60d"),
        div(c("tr_avg_14"), c("close")).alias("atr_pct"),
        div(c("std_20d") * 2, c("ma20")).alias("bb_width"),
        (div(c("vol"), c("vol_ma20")) * (div(c("close") - c("high_20d"), c("high_20d")) + 0.01)).alias("joc_interaction"),
        of_means(c("turnover_rate"), c("turnover_ma20")).alias("turnover_accel"),
        div(c("high_20d") - c("low_20d"), c("close")).alias("range_pct_20d"),
        div(c("high_60d") - c("low_60d"), c("close")).alias("range_pct_60d"),
        div(div(c("tr_avg_14"), c("close")), div(c("tr_avg_14"), c("close_14_ago"))).alias("adx_proxy"),
        *[div(c(f"_lead{h}") - c("close"), c("close")).alias(f"fwd_ret_{h}d") for h in HORIZONS],
    ).drop(*[f"_lead{h}" for h in HORIZONS])


def factor_panel(bars: DataFrame, min_rows: int = 120, exact_ties: bool = True) -> DataFrame:
    return add_features(add_base_windows(bars), exact_ties).where(F.col("stock_rows") >= min_rows)
