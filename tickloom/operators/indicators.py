"""Technical indicators on every bar, from one shared per-instrument window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.scores import snapped
from tickloom.operators.timeseries import EPS, add_ema, by_date, full, rows, sma, to_date_rows, true_range

OBV_DIVERGENCE_NORM = 0.05
OBV_DIVERGENCE_PRICE = 0.03


def _seen(value: Column, default: float) -> Column:
    return F.coalesce(value, F.lit(default))


def add_indicators(bars: DataFrame) -> DataFrame:
    """Every indicator the screen and the signals read; null until its window is full."""
    c, w = F.col, by_date()
    df = bars.select(
        "*", F.row_number().over(w).alias("rn"), true_range().alias("tr"), F.lag("close").over(w).alias("prev_close"),
        F.lag("high").over(w).alias("prev_high"), F.lag("low").over(w).alias("prev_low"))
    up, down = c("high") - c("prev_high"), c("prev_low") - c("low")
    delta = c("close") - c("prev_close")
    df = df.select(
        "*", F.when((up > down) & (up > 0), up).otherwise(0.0).alias("plus_dm"),
        F.when((down > up) & (down > 0), down).otherwise(0.0).alias("minus_dm"),
        F.greatest(delta, F.lit(0.0)).alias("gain"), F.greatest(-delta, F.lit(0.0)).alias("loss"),
        F.sum(F.signum(delta) * c("vol")).over(to_date_rows()).alias("obv_raw"))
    df = df.withColumn("obv", F.when(c("rn") > 1, c("obv_raw"))).drop("obv_raw")
    df = add_ema(df, 20, {"close": "ema20"})
    df = add_ema(df, 14, {"tr": "_etr", "plus_dm": "_epdm", "minus_dm": "_emdm"})
    df = df.withColumn("plus_di", c("_epdm") / (c("_etr") + EPS) * 100).withColumn("minus_di", c("_emdm") / (c("_etr") + EPS) * 100)
    df = df.withColumn("_dx", F.abs(c("plus_di") - c("minus_di")) / (c("plus_di") + c("minus_di") + EPS) * 100)
    df = add_ema(df, 14, {"_dx": "adx"})
    df = add_ema(df, 14, {"gain": "_eg", "loss": "_el"}, start=2)
    sd20 = full(F.stddev_pop("close"), "close", 20)
    tp = (c("high") + c("low") + c("close")) / 3
    wv = rows(-19, 0)
    df = df.select(
        "*", sma("tr", 14).alias("atr14"), *[sma("close", n).alias(f"sma{n}") for n in (20, 60, 120, 250)],
        (sd20 * 4 / (sma("close", 20) + EPS)).alias("bb_width"),
        (100 - 100 / (1 + c("_eg") / (c("_el") + EPS))).alias("rsi14"),
        F.when(F.count("vol").over(wv) == 20, F.sum(tp * c("vol")).over(wv) / (F.sum("vol").over(wv) + EPS)).alias("vwap20"),
        F.regr_slope("obv", "rn").over(wv).alias("_slope"), F.avg("vol").over(wv).alias("_vol20"),
        F.count("obv").over(wv).alias("_obvs"),
        F.max("high").over(rows(-119, 0)).alias("box_high"), F.min("low").over(rows(-119, 0)).alias("box_low"),
        F.max("high").over(rows(-119, -1)).alias("box_high_prev"),
        F.avg("turnover_rate").over(rows(-119, 0)).alias("avg_turnover"), F.avg("turnover_rate").over(rows(-9, 0)).alias("turnover10"),
        F.max("high").over(rows(-60, -1)).alias("_prior60"),
        F.avg("vol").over(rows(-4, 0)).alias("_vol5"), F.avg("vol").over(rows(-59, 0)).alias("_vol60"),
        F.avg("amount").over(rows(-59, 0)).alias("amount60"),
        *[F.lag("close", n).over(w).alias(f"_c{n}") for n in (5, 10, 20)],
        F.max("high").over(rows(-59, 0)).alias("high60"), F.min("low").over(rows(-59, 0)).alias("low60"),
    )
    lo3, hi3 = F.least("sma60", "sma120", "sma250"), F.greatest("sma60", "sma120", "sma250")
    lo2, hi2 = F.least("sma20", "sma60", "sma120"), F.greatest("sma20", "sma60", "sma120")
    df = df.select(
        "*", F.when(c("sma250").isNotNull(), (hi3 - lo3) / (lo3 + EPS)).alias("_sp3"),
        F.when(c("sma120").isNotNull(), (hi2 - lo2) / (lo2 + EPS)).alias("_sp2"),
        F.lag("atr14", 59).over(w).alias("_atr_ago"), F.lag("adx", 4).over(w).alias("_adx_ago"),
        F.min("bb_width").over(rows(-119, 0)).alias("_bbmin"), F.max("bb_width").over(rows(-119, 0)).alias("_bbmax"),
        F.count("bb_width").over(rows(-119, 0)).alias("_bbn"), F.lag("sma20", 5).over(w).alias("sma20_5ago"),
        F.when((c("rn") >= 2) & (c("close") > F.max("high").over(rows(-60, -1))), 1).otherwise(0).alias("_newhigh"),
    )
    slope = F.when(c("_obvs") >= 2, c("_slope")).otherwise(0.0)
    norm = F.when(c("_vol20") > EPS, slope / (c("_vol20") + EPS)).otherwise(0.0)

    def ret(n: int) -> Column:
        return F.when(c(f"_c{n}") > EPS, c("close") / (c(f"_c{n}") + EPS) - 1).otherwise(0.0)

    df = df.select(
        "*", F.avg("_sp3").over(rows(-49, 0)).alias("ma_spread"), F.stddev_pop("_sp3").over(rows(-49, 0)).alias("ma_spread_std"),
        F.avg("_sp2").over(rows(-19, 0)).alias("ma_spread_20"), F.stddev_pop("_sp2").over(rows(-19, 0)).alias("ma_spread_std_20"),
        F.max("_newhigh").over(rows(-20, 0)).alias("_bos20"),
        slope.alias("obv_slope"), norm.alias("obv_slope_norm"),
        *[ret(n).alias(f"return_{n}d") for n in (5, 10, 20)],
        F.when((c("rn") >= 60) & (c("_vol60") > EPS), c("_vol5") / (c("_vol60") + EPS)).otherwise(1.0).alias("volume_ratio_5d_vs_60d"),
        ((c("rn") >= 61) & (c("close") >= c("_prior60"))).alias("fresh_breakout"),
        ((c("rn") >= 61) & (c("close") >= c("_prior60") * 0.95)).alias("near_breakout"),
        ((c("box_high") - c("box_low")) / (c("box_low") + EPS)).alias("volatility"),
        ((c("close") - c("box_low")) / (c("box_high") - c("box_low") + EPS)).alias("price_position"),
        (c("turnover10") / (c("avg_turnover") + EPS)).alias("volume_boost"),
        F.when((c("_atr_ago") > EPS) & c("atr14").isNotNull(), c("atr14") / (c("_atr_ago") + EPS)).otherwise(1.0).alias("atr_ratio"),
        (c("adx") - F.coalesce("_adx_ago", "adx")).alias("adx_slope"),
        F.when((c("_bbn") > 1) & c("bb_width").isNotNull(), (c("bb_width") - c("_bbmin")) / (c("_bbmax") - c("_bbmin") + EPS))
        .otherwise(0.5).alias("bbw_percentile"),
        (c("close") / (c("vwap20") + EPS)).alias("vwap_ratio"),
        F.when((c("sma60") > c("sma120")) & (c("sma120") > c("sma250")), "bullish")
        .when((c("sma60") < c("sma120")) & (c("sma120") < c("sma250")), "bearish").otherwise("neutral").alias("ma_trend"),
    )
    df = df.withColumn("price_change_20d", c("return_20d")).withColumn(
        "obv_divergence", (c("obv_slope_norm") >= OBV_DIVERGENCE_NORM) & (c("return_20d") <= OBV_DIVERGENCE_PRICE))
    return df.drop(*[x for x in df.columns if x.startswith("_") and x != "_bos20"]).withColumnRenamed("_bos20", "bos_flag")


def box_signals(df: DataFrame) -> DataFrame:
    """Breakout, ignition and squeeze signals per bar, on top of the indicators."""
    c = F.col
    top = F.coalesce("box_high_prev", "box_high")
    dist = (top - c("close")) / (top + EPS)
    already = c("close") > top
    ignition = (c("volume_boost") >= 1.2) & (c("volume_boost") <= 3.0)
    window_ok = ~already & (dist >= 0) & (dist <= 0.03)
    atr = F.coalesce("atr14", (c("high60") - c("low60")) * 0.05)
    return df.select(
        "*", dist.alias("dist_to_box_top"), c("price_position").alias("close_position"), c("volume_boost").alias("turnover_mult"),
        ignition.alias("ignition"), already.alias("already_breakout"), (c("close") >= top * 1.03).alias("extended_breakout"),
        window_ok.alias("breakout_window_ok"),
        F.coalesce(ignition & window_ok & (c("close") >= c("sma20")), F.lit(False)).alias("ready_to_break"),
        (c("atr_ratio") < 0.7).alias("atr_squeeze"), (c("bbw_percentile") < 0.2).alias("bbw_squeeze"),
        ((c("adx") < 25) & (c("adx_slope") > 0)).alias("adx_inflecting"), (c("obv_slope_norm") > 0).alias("obv_accumulating"),
        F.when(atr > 0, atr / (c("close") + EPS)).otherwise(0.0).alias("atr_pct"),
        ((c("high60") - c("low60")) / (c("close") + EPS)).alias("range_pct_60d"),
        F.when(c("high60") > c("low60"), (c("close") - c("low60")) / (c("high60") - c("low60") + EPS)).otherwise(0.5).alias("price_position_60d"),
        ((c("rn") >= 30) & (c("bos_flag") == 1)).alias("bos_20d"),
        F.when((c("sma20") > F.coalesce("sma20_5ago", "sma20")) & (atr > 0), (c("sma20") - c("close")) / (atr + EPS)).otherwise(0.0).alias("lps_pullback"),
    )


def turnover_spikes(df: DataFrame, n: int = 20, mult: float = 1.5, exact_ties: bool = True) -> DataFrame:
    """Bars whose turnover exceeds a multiple of its full trailing mean; without `exact_ties` the doubles are compared as they are."""
    above = snapped(F.try_divide("turnover_rate", "_m")) > mult if exact_ties else F.col("turnover_rate") > F.col("_m") * mult
    return df.withColumn("_m", sma("turnover_rate", n)).where(above).drop("_m")
