"""Signals overlay, report order and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of a candidate that take the place of the signal's.
OVERLAY = ("ema20", "ma60", "ma120", "ma250", "ma_trend", "volume_quality_score", "obv_slope", "obv_slope_norm", "obv_accumulation_score", "obv_divergence", "adx", "adx_slope",
           "bbw_percentile", "vwap_ratio", "price_change_20d", "return_5d", "return_10d", "return_20d", "volume_ratio_5d_vs_60d", "fresh_breakout", "near_breakout",
           "trend_emergence_score", "consolidation_score", "squeeze_readiness")


def overlay(signals: DataFrame, candidates: DataFrame, columns: tuple[str, ...] = OVERLAY) -> DataFrame:
    """signals where each of the columns that a candidate of the same code has a value for is the candidate's; columns that only candidates have are added."""
    taken = [c for c in columns if c in candidates.columns]
    own = candidates.select("ts_code", *[F.col(c).alias(f"_c_{c}") for c in taken])
    j = signals.join(own, "ts_code", "left")
    over = {c: F.coalesce(f"_c_{c}", c) if c in signals.columns else F.col(f"_c_{c}") for c in taken}
    return j.select(*[over[c].alias(c) if c in over else F.col(c) for c in signals.columns], *[over[c].alias(c) for c in taken if c not in signals.columns])


def report_order(sections: DataFrame) -> DataFrame:
    """Sections (ts_code, close_position, position) by place in the box, low first; one without a place counts as the middle; equal ones keep their order."""
    return sections.orderBy(F.coalesce(F.nanvl("close_position", F.lit(None).cast("double")), F.lit(0.5)), "position")


def _told(c: str, digits: int, default: float) -> Column:
    return F.format_string(f"%.{digits}f", F.coalesce(F.col(c).cast("double"), F.lit(default)))


def _stock() -> Column:
    return F.concat(F.coalesce("name", "ts_code"), F.lit("("), "ts_code", F.lit(")"))


def theme_table(candidates: DataFrame, top: int = 5) -> DataFrame:
    """The first theme names in candidate order as text: stock, first two themes, strength, valuation, quality and score."""
    rows = candidates.where(F.col("list_type").isin("theme_driven", "both")).orderBy("position").limit(top)
    themes = F.array_join(F.slice(F.coalesce("matched_themes", F.array().cast("array<string>")), 1, 2), ", ")
    return rows.select("position", _stock().alias("stock"), F.when(themes == "", "待确认").otherwise(themes).alias("themes"), _told("theme_strength_score", 2, 0.0).alias("strength"),
                       F.coalesce("valuation_label", F.lit("估值待补充")).alias("valuation"), _told("fundamental_quality_score", 1, 50.0).alias("quality"), _told("alpha_rank_score", 1, 0.0).alias("alpha"))


def core_table(candidates: DataFrame, top: int = 8) -> DataFrame:
    """The first technical names as text: stock, themes, valuation, place in the box, shape, confidence and reason. confidence is null without an audit."""
    rows = candidates.where(F.col("list_type").isin("technical", "both")).orderBy("position").limit(top)
    themes = F.array_join(F.slice(F.coalesce("matched_themes", F.array().cast("array<string>")), 1, 2), ", ")
    box = F.when(F.col("close_position").isNotNull(), F.concat(F.format_string("%.0f", F.col("close_position") * 100), F.lit("%分位"))).otherwise("—")
    shape = F.concat(F.lit("横盘分"), _told("consolidation_score", 0, 0.0), F.lit("，量能"), _told("volume_boost", 2, 0.0))
    why = F.concat(F.lit("alpha评分"), _told("alpha_rank_score", 1, 0.0), F.lit("；拥挤度"), _told("toplist_recency_score", 2, 0.0))
    return rows.select("position", _stock().alias("stock"), F.when(themes == "", "技术形态入选").otherwise(themes).alias("themes"), F.coalesce("valuation_label", F.lit("估值待补充")).alias("valuation"),
                       box.alias("box"), shape.alias("shape"), _told("confidence", 2, 0.5).alias("confidence"), why.alias("reason"))
