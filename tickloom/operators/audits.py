"""Look-ahead checks: each one counts violations, zero means clean."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators.patterns import RETEST_BARS, ROLLED, SWING
from tickloom.operators.timeseries import by_date, rows, to_date_rows


def leak_violations(df: DataFrame) -> DataFrame:
    """One row per check over a pattern panel with patterns, rolled maxima and panel features.

    Each condition is recomputed in another way than the operator does it.
    """
    c, w = F.col, by_date()
    known = F.collect_list(F.when(c("swing_high").isNotNull(), F.struct("rn", "swing_high"))).over(to_date_rows())
    past = F.filter("_known", lambda s: s["rn"] + SWING <= c("rn"))
    df = df.select(
        "*", known.alias("_known"),
        F.collect_list(F.struct("rn", "bos", "last_swing", "pattern_atr")).over(rows(-RETEST_BARS, -1)).alias("_breaks"),
        F.collect_list("high").over(rows(-19, 0)).alias("_highs"),
        F.collect_list("low").over(rows(-10, 0)).alias("_lows"),
        F.collect_list("bos").over(rows(-19, 0)).alias("_bos"),
        F.lag("pre_close", 10).over(w).alias("_gap_pc"),
        F.lead("close", 5).over(w).alias("_close5"),
        F.lag("swing_high", SWING).over(w).alias("_at_confirm"),
        F.lead("trade_date", 5).over(w).alias("_date5"),
    )
    low, close = c("low"), c("close")
    traced = F.exists("_breaks", lambda b: (b["bos"] == 1) & (low >= b["last_swing"] - b["pattern_atr"] * 0.3)
                      & (low <= b["last_swing"] + b["pattern_atr"] * 0.2) & (close > b["last_swing"] - b["pattern_atr"] * 0.3))
    near = lambda a, b: F.abs(a - b) > 1e-9
    checks = {
        "confirmation_lag": c("confirmed_swing").isNotNull() & ((c("rn") <= SWING) | (c("_at_confirm") != c("confirmed_swing"))),
        "last_swing_traceable": c("last_swing").isNotNull() & (F.try_element_at(past, F.lit(-1))["swing_high"] != c("last_swing")),
        "bos_traceable": (c("bos") == 1) & ~F.coalesce(close > F.try_element_at(past, F.lit(-1))["swing_high"], F.lit(False)),
        "gap_window_held": (c("gap_hold") == 1) & F.exists("_lows", lambda x: x < c("_gap_pc") * 0.999),
        "proximity_recomputed": near(c("breakout_proximity_20d"), (close - F.array_max("_highs")) / F.array_max("_highs")),
        "forward_return_recomputed": near(c("fwd_ret_5d"), (c("_close5") - close) / close),
        "retest_traceable": (c("true_bos") == 1) & ~traced,
        "rolling_max_equal": c("bos_20d") != F.array_max("_bos"),
        "target_after_feature": c("fwd_ret_5d").isNotNull() & ~(c("_date5") > c("trade_date")),
    }
    counts = df.agg(*[F.sum(F.coalesce(cond, F.lit(False)).cast("long")).alias(name) for name, cond in checks.items()])
    return counts.select(F.stack(
        F.lit(len(checks)), *[x for name in checks for x in (F.lit(name), F.col(name))]).alias("check_name", "violations"))


def trigger_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of bars on which each pattern fires."""
    means = df.agg(*[F.avg(c).alias(c) for c in columns])
    return means.select(F.stack(F.lit(len(columns)), *[x for c in columns for x in (F.lit(c), F.col(c))])
                        .alias("pattern", "trigger_rate"))


__all__ = ["ROLLED", "leak_violations", "trigger_rates"]
