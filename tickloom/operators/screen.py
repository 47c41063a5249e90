"""The screen: filters and scores on the latest bar of every instrument."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tickloom.functions import scores as S
from tickloom.operators import ranking as R


@dataclass(frozen=True)
class ScreenParams:
    min_bars: int = 180
    cap_min: float = 1e9
    cap_max: float = 5e10
    pe_cap: float = 300.0
    ipo_grace_bars: int = 500
    min_amount: float = 3e5
    exclude_st: bool = False
    peer_min: int = 5
    outlier_pct: float = 0.97


# Valuation weights and absolute caps.
VALUATION_WEIGHTS = {"pe": 0.5, "pb": 0.3, "ps_ttm": 0.2}
VALUATION_CAPS = {"pe": 250.0, "pb": 25.0, "ps_ttm": 40.0}


def skip_reason(last: DataFrame, p: ScreenParams) -> DataFrame:
    """First failed technical filter of each latest bar; null passes."""
    c = F.col
    cap = c("total_mv") * 10000
    st = c("name").contains("ST") if p.exclude_st else F.lit(False)
    reason = (
        F.when(c("name").isNull() | st, "no_data").when(c("rn") < p.min_bars, "insufficient")
        .when(~cap.between(p.cap_min, p.cap_max), "market_cap")
        .when((c("pe").isNull() & (c("rn") >= p.ipo_grace_bars)) | (c("pe") > p.pe_cap), "pe")
        .when(c("amount60") < p.min_amount, "liquidity").when(c("sma250").isNull(), "ma_history")
    )
    return last.select("*", cap.alias("market_cap"), reason.alias("skip_reason"))


def technical_scores(df: DataFrame) -> DataFrame:
    c = F.col
    return df.select(
        "*", S.consolidation(c("volatility"), c("ma_spread"), c("ma_spread_std"), c("price_position"), c("volume_boost")).alias("consolidation_score"),
        S.squeeze(c("atr_ratio"), c("bbw_percentile"), c("adx")).alias("squeeze_readiness"))


def relative_valuation(df: DataFrame, bound: int, p: ScreenParams = ScreenParams(), plain_rows: int = R.PLAIN_ROWS) -> DataFrame:
    """Share of peers at or below each multiple: the industry with enough peers, else the whole market."""
    c = F.col
    df = df.withColumn("industry", F.coalesce("industry", F.lit("Unknown")))
    base = df.columns
    df = df.withColumns({f"_v_{m}": S.positive(c(m)) for m in VALUATION_WEIGHTS}).withColumn("_all", F.lit(0))
    for scope, out in (("industry", "i"), ("_all", "m")):
        df = R.shares_at_most(df, [scope], {f"_v_{m}": f"_{out}_{m}" for m in VALUATION_WEIGHTS}, bound, plain_rows)
    if bound <= plain_rows:
        w = Window.partitionBy("industry")
        df = df.select("*", *[F.count(f"_v_{m}").over(w).alias(f"_n_{m}") for m in VALUATION_WEIGHTS])
    else:
        peers = df.groupBy("industry").agg(*[F.count(f"_v_{m}").alias(f"_n_{m}") for m in VALUATION_WEIGHTS])
        df = df.join(peers, "industry")
    df = df.select("*", *[F.when(c(f"_n_{m}") >= p.peer_min, c(f"_i_{m}")).otherwise(c(f"_m_{m}")).alias(f"{m}_percentile_industry")
                          for m in VALUATION_WEIGHTS],
                   *[F.when(c(f"_n_{m}") >= p.peer_min, "industry").otherwise("market").alias(f"{m}_baseline_source") for m in VALUATION_WEIGHTS])
    pct = {m: c(f"{m}_percentile_industry") for m in VALUATION_WEIGHTS}
    points = sum((F.when(pct[m].isNotNull(), 1).otherwise(0) for m in pct), F.lit(0))
    weight = sum((F.when(pct[m].isNotNull(), w).otherwise(0.0) for m, w in VALUATION_WEIGHTS.items()), F.lit(0.0))
    total = sum((F.coalesce(pct[m], F.lit(0.0)) * w for m, w in VALUATION_WEIGHTS.items()), F.lit(0.0))
    df = df.withColumn("valuation_data_points", points).withColumn(
        "valuation_stretch_score", F.when(points == 0, 50.0).otherwise(F.try_divide(total, weight) * 100))
    over = F.lit(False)
    for m, cap in VALUATION_CAPS.items():
        over = over | F.coalesce(c(f"_v_{m}") > cap, F.lit(False))
    s = c("valuation_stretch_score")
    return df.select(
        *base, *[f"{m}_percentile_industry" for m in pct], *[f"{m}_baseline_source" for m in pct], "valuation_data_points",
        "valuation_stretch_score", (100 - s).alias("valuation_quality_score"), S.valuation_label(s).alias("valuation_label"),
        (over | (s >= p.outlier_pct * 100) | ((c("valuation_data_points") == 0) & c("_v_pe").isNull())).alias("valuation_outlier"))


#: What a universe without valuation columns gets.
VALUATION_DEFAULTS = {"valuation_quality_score": 50.0, "valuation_stretch_score": 50.0, "valuation_label": "估值待补充", "valuation_outlier": False,
                      "pe_percentile_industry": None, "pb_percentile_industry": None, "ps_ttm_percentile_industry": None}


def with_valuation_columns(df: DataFrame) -> DataFrame:
    """df with all valuation columns: neutral ones where they are missing, and blank labels told by the stretch score."""
    made = {c: F.lit(v) if v is not None else F.lit(None).cast("double") for c, v in VALUATION_DEFAULTS.items() if c not in df.columns}
    out = df.withColumns(made) if made else df
    blank = F.trim(F.coalesce("valuation_label", F.lit(""))) == ""
    return out.withColumn("valuation_label", F.when(blank, S.valuation_label(F.col("valuation_stretch_score"))).otherwise(F.col("valuation_label")))


def obv_scores(df: DataFrame, bound: int, plain_rows: int = R.PLAIN_ROWS) -> DataFrame:
    """Percentile of positive OBV slopes over the universe, plus a divergence bonus."""
    c = F.col
    df = df.withColumn("_all", F.lit(0)).withColumn("_pos", F.when(c("obv_slope_norm") > 0, c("obv_slope_norm")))
    df = R.average_rank(df, ["_all"], "_pos", "_pct", bound, pct=True, plain_rows=plain_rows)
    bonus = F.when(c("obv_divergence"), 15.0).otherwise(0.0)
    return df.withColumn("obv_accumulation_score", S.clamp(F.coalesce("_pct", F.lit(0.0)) * 85 + bonus, 0, 100)).drop("_all", "_pos", "_pct")


def universe_scores(df: DataFrame, bound: int, plain_rows: int = R.PLAIN_ROWS) -> DataFrame:
    c = F.col
    df = obv_scores(df, bound, plain_rows)
    return df.select(
        "*", S.volume_quality(c("volume_boost"), c("avg_turnover"), c("obv_accumulation_score")).alias("volume_quality_score"),
        S.trend_emergence(c("return_5d"), c("return_10d"), c("return_20d"), c("volume_ratio_5d_vs_60d"), c("fresh_breakout"),
                          c("near_breakout"), c("obv_accumulation_score")).alias("trend_emergence_score"))


def screen(last: DataFrame, fundamentals: DataFrame, bound: int, p: ScreenParams = ScreenParams()) -> DataFrame:
    """Latest bars with instrument data to the scored universe; `fundamentals` has ts_code, score and stage."""
    kept = technical_scores(skip_reason(last, p).where("skip_reason is null"))
    valued = relative_valuation(kept, bound, p).where("not valuation_outlier")
    scored = universe_scores(valued, bound)
    j = scored.join(fundamentals, "ts_code", "left")
    c = F.col
    j = j.withColumn("fundamental_quality_score", F.coalesce("fundamental_quality_score", F.lit(50.0))).withColumn(
        "lifecycle_stage", F.coalesce("lifecycle_stage", F.lit("unknown")))
    return j.withColumn("composite_score", S.composite(c("consolidation_score"), c("volume_quality_score"), c("squeeze_readiness"),
                                                       c("valuation_quality_score"), c("fundamental_quality_score")))
