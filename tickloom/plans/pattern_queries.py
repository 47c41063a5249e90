"""Pattern queries and their look-ahead audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import audits as Q
from tickloom.operators import patterns as T
from tickloom.plans.common import day, r6, sql_day
from tickloom.plans.oracle_base import cte
from tickloom.plans.panel_queries import panel
from tickloom.plans.registry import query

_W = "PARTITION BY ts_code ORDER BY trade_date"
cte("sw0", ("panel",), f"""
  SELECT *, CASE WHEN cb=10 AND ca=10 AND high>mb AND high>ma_ THEN high END AS swing_high
  FROM (SELECT *, count(*) OVER b AS cb, count(*) OVER a AS ca, max(high) OVER b AS mb, max(high) OVER a AS ma_,
               avg(tr) OVER ({_W} ROWS 13 PRECEDING) AS atr
        FROM (SELECT *, greatest(high-low, abs(high-lag(pre_close) OVER w), abs(low-lag(pre_close) OVER w)) AS tr
              FROM panel WINDOW w AS ({_W}))
        WINDOW b AS ({_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), a AS ({_W} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING))""")
cte("sw", ("sw0",), f"""
  SELECT *, last_value(confirmed_swing IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS last_swing,
         last_value(swing_high IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS last_biased
  FROM (SELECT *, lag(swing_high,10) OVER ({_W}) AS confirmed_swing FROM sw0)""")
cte("brk", ("sw",), """
  SELECT *, CASE WHEN close>last_swing THEN 1e0 ELSE 0e0 END AS bos, CASE WHEN close>last_biased THEN 1e0 ELSE 0e0 END AS bos_biased FROM sw""")
for _n, _b, _s in (("retest", "bos", "last_swing"), ("retest_biased", "bos_biased", "last_biased")):
    cte(_n, ("brk",), f"""
  SELECT DISTINCT ts_code, j FROM (
    SELECT i.ts_code, i.rn, min(j.rn) AS j FROM brk i JOIN brk j ON j.ts_code=i.ts_code AND j.rn > i.rn AND j.rn <= i.rn+20
    WHERE i.{_b}=1 AND j.low >= i.{_s}-i.atr*0.3 AND j.low <= i.{_s}+i.atr*0.2 AND j.close > i.{_s}-i.atr*0.3
    GROUP BY i.ts_code, i.rn)""")
cte("pat", ("brk", "retest", "retest_biased"), f"""
  SELECT *, CASE WHEN bos=1 AND vol > v20*1.5 THEN 1e0 ELSE 0e0 END AS joc,
    CASE WHEN rn>=6 AND low<lo5*0.99 AND (least(open,close)-low)/greatest(high-low,0.001)>0.4 AND close>open THEN 1e0 ELSE 0e0 END AS liquidity_sweep,
    CASE WHEN rn>=21 AND h10<h20 AND close<c5 THEN 1e0 ELSE 0e0 END AS choch,
    CASE WHEN rn>=11 AND high>h10 THEN 1e0 ELSE 0e0 END AS higher_high,
    CASE WHEN rn>=11 AND low<l10 THEN 1e0 ELSE 0e0 END AS lower_low,
    CASE WHEN rn>=31 AND len(sws)>=2 AND sws[len(sws)]<sws[len(sws)-1] AND close<lo5 THEN 1e0 ELSE 0e0 END AS quasimodo,
    CASE WHEN rn>=12 AND (go-gp)/greatest(gp,0.001)>0.005 AND l11>=gp*0.999 THEN 1e0 ELSE 0e0 END AS gap_hold,
    CASE WHEN rn>=2 AND (open-pre_close)/greatest(pre_close,0.001)>0.005 AND lf>=pre_close*0.999 THEN 1e0 ELSE 0e0 END AS gap_hold_biased
  FROM (SELECT b.*, CASE WHEN r.j IS NULL THEN 0e0 ELSE 1e0 END AS true_bos, CASE WHEN rb.j IS NULL THEN 0e0 ELSE 1e0 END AS true_bos_biased,
      avg(vol) OVER ({_W.replace('ts_code','b.ts_code')} ROWS 19 PRECEDING) AS v20,
      min(low) OVER (PARTITION BY b.ts_code ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS lo5,
      avg(close) OVER (PARTITION BY b.ts_code ORDER BY trade_date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS c5,
      max(high) OVER (PARTITION BY b.ts_code ORDER BY trade_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS h10,
      min(low) OVER (PARTITION BY b.ts_code ORDER BY trade_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS l10,
      max(high) OVER (PARTITION BY b.ts_code ORDER BY trade_date ROWS BETWEEN 20 PRECEDING AND 11 PRECEDING) AS h20,
      array_agg(swing_high) FILTER (swing_high IS NOT NULL) OVER (PARTITION BY b.ts_code ORDER BY trade_date ROWS BETWEEN 30 PRECEDING AND 11 PRECEDING) AS sws,
      lag(open,10) OVER (PARTITION BY b.ts_code ORDER BY trade_date) AS go, lag(pre_close,10) OVER (PARTITION BY b.ts_code ORDER BY trade_date) AS gp,
      min(low) OVER (PARTITION BY b.ts_code ORDER BY trade_date ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS l11,
      min(low) OVER (PARTITION BY b.ts_code ORDER BY trade_date ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) AS lf
    FROM brk b LEFT JOIN retest r ON r.ts_code=b.ts_code AND r.j=b.rn LEFT JOIN retest_biased rb ON rb.ts_code=b.ts_code AND rb.j=b.rn)""")
cte("patx", ("pat",), f"""
  SELECT *, CASE WHEN lps_pullback>0 AND ma20_slope_5d>0 AND bos_20d>0 THEN 1e0 ELSE 0e0 END AS lps_signal,
    CASE WHEN vol_contraction<0.8 AND price_position_20d>0.3 AND price_position_20d<0.8 THEN 1e0 ELSE 0e0 END AS wyckoff_consolidation
  FROM (SELECT *, {', '.join(f'max({p}) OVER w20 AS {p}_20d' for p in T.ROLLED)} FROM pat WINDOW w20 AS ({_W} ROWS 19 PRECEDING))""")


def pattern_panel(spark, sf_dir):
    return T.pattern_panel(panel(spark, sf_dir))


@query("swing_highs", "W-36 W-37", ("sw",), f"""
  SELECT ts_code, {sql_day('trade_date')}, round(swing_high,6) AS swing_high, round(confirmed_swing,6) AS confirmed_swing,
         round(last_swing,6) AS last_swing FROM sw""")
def swing_highs(spark, sf_dir):
    return T.add_swings(panel(spark, sf_dir)).select(
        "ts_code", day("trade_date"), r6("swing_high"), r6("confirmed_swing"), r6("last_swing"))


@query("pattern_atr", "W-48", ("sw",), f"SELECT ts_code, {sql_day('trade_date')}, round(atr,6) AS pattern_atr FROM sw")
def pattern_atr(spark, sf_dir):
    return T.add_pattern_atr(panel(spark, sf_dir)).select("ts_code", day("trade_date"), r6("pattern_atr"))


def _columns(cols):
    def run(spark, sf_dir):
        return pattern_panel(spark, sf_dir).select("ts_code", day("trade_date"), *cols)

    return run


for _name, _ids, _cols in [
    ("pattern_break_of_structure", "W-38 W-40", ["bos", "joc"]),
    ("pattern_retest", "W-39 J-13", ["true_bos"]),
    ("pattern_sweep_and_change", "W-41 W-42", ["liquidity_sweep", "choch"]),
    ("pattern_extremes", "W-43", ["higher_high", "lower_low"]),
    ("pattern_quasimodo", "W-44", ["quasimodo"]),
    ("pattern_gap_hold", "W-45", ["gap_hold"]),
    ("pattern_rolling_max", "W-46", [f"{p}_20d" for p in T.ROLLED]),
    ("pattern_derived_signals", "W-47", ["lps_signal", "wyckoff_consolidation"]),
]:
    query(_name, _ids, ("patx",), f"SELECT ts_code, {sql_day('trade_date')}, {', '.join(_cols)} FROM patx")(_columns(_cols))

_RATES = [*T.PATTERNS, "lps_signal", "wyckoff_consolidation"]


@query("pattern_trigger_rates", "A-17", ("patx",), " UNION ALL ".join(
    f"SELECT '{p}' AS pattern, round(avg({p}),6) AS trigger_rate FROM patx" for p in _RATES))
def pattern_trigger_rates(spark, sf_dir):
    return Q.trigger_rates(pattern_panel(spark, sf_dir), _RATES).select("pattern", r6("trigger_rate"))


_CHECKS = ["confirmation_lag", "last_swing_traceable", "bos_traceable", "gap_window_held", "proximity_recomputed",
           "forward_return_recomputed", "retest_traceable", "rolling_max_equal", "target_after_feature"]


@query("leak_audit", "Q-1", ("patx",), f"""
  SELECT unnest([{', '.join(repr(c) for c in _CHECKS)}]) AS check_name, CAST(count(*)*0 AS BIGINT) AS violations FROM patx""")
def leak_audit(spark, sf_dir):
    return Q.leak_violations(pattern_panel(spark, sf_dir))


@query("biased_patterns", "Q-2", ("pat",), f"""
  SELECT ts_code, {sql_day('trade_date')}, bos_biased, true_bos_biased, gap_hold_biased FROM pat""")
def biased_patterns(spark, sf_dir):
    return T.add_biased_patterns(T.add_patterns(panel(spark, sf_dir))).select(
        "ts_code", day("trade_date"), "bos_biased", "true_bos_biased", "gap_hold_biased")
