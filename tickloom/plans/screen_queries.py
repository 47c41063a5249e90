"""Indicator, screen and timing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import scores as S
from tickloom.operators import fundamentals as B
from tickloom.operators import indicators as N
from tickloom.operators import ranking as R
from tickloom.operators import screen as C
from tickloom.operators import timing as M
from tickloom.operators.timeseries import is_last
from tickloom.plans.common import day, flag, rounded, sql_day, sql_round
from tickloom.plans.oracle_base import cte
from tickloom.plans.registry import query
from tickloom.sources import adapters as A

_W = "PARTITION BY ts_code ORDER BY trade_date"


def _ema(x: str, span: int, out: str, start: int = 1) -> str:
    a = 2.0 / (span + 1)
    i = f"(rn-{start})"
    return (f"CASE WHEN rn>={start} THEN pow({1 - a!r},{i})*sum(CASE WHEN rn>={start} THEN (CASE WHEN rn={start} THEN 1.0 ELSE {a!r} END)*{x}"
            f"*pow({1 - a!r},-{i}) END) OVER ({_W} ROWS UNBOUNDED PRECEDING) END AS {out}")


def _full(agg: str, col: str, n: int) -> str:
    f = f"OVER ({_W} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({col}) {f}={n} THEN {agg} {f} END"


cte("ind0", ("vbars",), f"""
  SELECT *, coalesce(greatest(high-low, abs(high-pc), abs(low-pc)), high-low) AS tr,
    CASE WHEN high-ph > pl-low AND high-ph>0 THEN high-ph ELSE 0 END AS pdm, CASE WHEN pl-low > high-ph AND pl-low>0 THEN pl-low ELSE 0 END AS mdm,
    greatest(close-pc,0) AS gain, greatest(pc-close,0) AS loss,
    CASE WHEN rn>1 THEN sum(sign(close-pc)*vol) OVER ({_W} ROWS UNBOUNDED PRECEDING) END AS obv
  FROM (SELECT *, lag(close) OVER ({_W}) AS pc, lag(high) OVER ({_W}) AS ph, lag(low) OVER ({_W}) AS pl FROM vbars)""")
cte("ind1", ("ind0",), f"""
  SELECT *, {_ema('close', 20, 'ema20')}, {_ema('tr', 14, 'etr')}, {_ema('pdm', 14, 'ep')}, {_ema('mdm', 14, 'em')},
    {_ema('gain', 14, 'eg', 2)}, {_ema('loss', 14, 'el', 2)}, {_full('avg(tr)', 'tr', 14)} AS atr14,
    {', '.join(f"{_full('avg(close)', 'close', n)} AS sma{n}" for n in (20, 60, 120, 250))},
    4*{_full('stddev_pop(close)', 'close', 20)[:-4]} END/({_full('avg(close)', 'close', 20)}+1e-9) AS bb_width,
    {_full('sum((high+low+close)/3*vol)', 'vol', 20)}/({_full('sum(vol)', 'vol', 20)}+1e-9) AS vwap20,
    regr_slope(obv,rn) OVER ({_W} ROWS 19 PRECEDING) AS slope, count(obv) OVER ({_W} ROWS 19 PRECEDING) AS obvs, avg(vol) OVER ({_W} ROWS 19 PRECEDING) AS vol20,
    max(high) OVER ({_W} ROWS 119 PRECEDING) AS box_high, min(low) OVER ({_W} ROWS 119 PRECEDING) AS box_low,
    max(high) OVER ({_W} ROWS BETWEEN 119 PRECEDING AND 1 PRECEDING) AS box_high_prev,
    avg(turnover_rate) OVER ({_W} ROWS 119 PRECEDING) AS avg_turnover, avg(turnover_rate) OVER ({_W} ROWS 9 PRECEDING) AS turnover10,
    max(high) OVER ({_W} ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS prior60, avg(vol) OVER ({_W} ROWS 4 PRECEDING) AS vol5,
    avg(vol) OVER ({_W} ROWS 59 PRECEDING) AS vol60, avg(amount) OVER ({_W} ROWS 59 PRECEDING) AS amount60,
    lag(close,5) OVER ({_W}) AS c5, lag(close,10) OVER ({_W}) AS c10, lag(close,20) OVER ({_W}) AS c20,
    max(high) OVER ({_W} ROWS 59 PRECEDING) AS high60, min(low) OVER ({_W} ROWS 59 PRECEDING) AS low60
  FROM ind0""".replace("4*CASE WHEN", "CASE WHEN").replace("THEN stddev_pop(close)", "THEN 4*stddev_pop(close)").replace(" END END/(", " END/("))
cte("ind2", ("ind1",), f"""
  SELECT *, 100*(ep/(etr+1e-9)) AS plus_di, 100*(em/(etr+1e-9)) AS minus_di,
    100*abs(100*(ep/(etr+1e-9))-100*(em/(etr+1e-9)))/(100*(ep/(etr+1e-9))+100*(em/(etr+1e-9))+1e-9) AS dx, 100-100/(1+eg/(el+1e-9)) AS rsi14,
    CASE WHEN sma250 IS NOT NULL THEN (greatest(sma60,sma120,sma250)-least(sma60,sma120,sma250))/(least(sma60,sma120,sma250)+1e-9) END AS sp3,
    CASE WHEN sma120 IS NOT NULL THEN (greatest(sma20,sma60,sma120)-least(sma20,sma60,sma120))/(least(sma20,sma60,sma120)+1e-9) END AS sp2,
    lag(atr14,59) OVER ({_W}) AS atr_ago, min(bb_width) OVER ({_W} ROWS 119 PRECEDING) AS bbmin, max(bb_width) OVER ({_W} ROWS 119 PRECEDING) AS bbmax,
    count(bb_width) OVER ({_W} ROWS 119 PRECEDING) AS bbn, lag(sma20,5) OVER ({_W}) AS sma20_5ago, CASE WHEN rn>=2 AND close>prior60 THEN 1 ELSE 0 END AS newhigh
  FROM ind1""")
cte("ind3", ("ind2",), f"SELECT *, {_ema('dx', 14, 'adx')} FROM ind2")
cte("ind", ("ind3",), f"""
  SELECT *, adx-coalesce(lag(adx,4) OVER ({_W}), adx) AS adx_slope,
    avg(sp3) OVER ({_W} ROWS 49 PRECEDING) AS ma_spread, stddev_pop(sp3) OVER ({_W} ROWS 49 PRECEDING) AS ma_spread_std,
    avg(sp2) OVER ({_W} ROWS 19 PRECEDING) AS ma_spread_20, stddev_pop(sp2) OVER ({_W} ROWS 19 PRECEDING) AS ma_spread_std_20,
    max(newhigh) OVER ({_W} ROWS 20 PRECEDING) AS bos_flag, CASE WHEN obvs>=2 THEN slope ELSE 0 END AS obv_slope,
    CASE WHEN vol20>1e-9 THEN (CASE WHEN obvs>=2 THEN slope ELSE 0 END)/(vol20+1e-9) ELSE 0 END AS obv_slope_norm,
    coalesce(close/(c5+1e-9)-1,0) AS return_5d, coalesce(close/(c10+1e-9)-1,0) AS return_10d, coalesce(close/(c20+1e-9)-1,0) AS return_20d,
    CASE WHEN rn>=60 AND vol60>1e-9 THEN vol5/(vol60+1e-9) ELSE 1 END AS volume_ratio_5d_vs_60d,
    rn>=61 AND close>=prior60 AS fresh_breakout, rn>=61 AND close>=prior60*0.95 AS near_breakout, (box_high-box_low)/(box_low+1e-9) AS volatility,
    (close-box_low)/(box_high-box_low+1e-9) AS price_position, turnover10/(avg_turnover+1e-9) AS volume_boost,
    CASE WHEN atr_ago>1e-9 AND atr14 IS NOT NULL THEN atr14/(atr_ago+1e-9) ELSE 1 END AS atr_ratio,
    CASE WHEN bbn>1 AND bb_width IS NOT NULL THEN (bb_width-bbmin)/(bbmax-bbmin+1e-9) ELSE 0.5 END AS bbw_percentile, close/(vwap20+1e-9) AS vwap_ratio,
    CASE WHEN sma60>sma120 AND sma120>sma250 THEN 'bullish' WHEN sma60<sma120 AND sma120<sma250 THEN 'bearish' ELSE 'neutral' END AS ma_trend FROM ind3""")
cte("sig", ("ind",), """
  SELECT *, (top-close)/(top+1e-9) AS dist_to_box_top, price_position AS close_position, volume_boost AS turnover_mult,
    volume_boost BETWEEN 1.2 AND 3.0 AS ignition, close>top AS already_breakout, close>=top*1.03 AS extended_breakout,
    NOT (close>top) AND (top-close)/(top+1e-9) BETWEEN 0 AND 0.03 AS breakout_window_ok,
    coalesce(volume_boost BETWEEN 1.2 AND 3.0 AND NOT (close>top) AND (top-close)/(top+1e-9) BETWEEN 0 AND 0.03 AND close>=sma20, false) AS ready_to_break,
    atr_ratio<0.7 AS atr_squeeze, bbw_percentile<0.2 AS bbw_squeeze, adx<25 AND adx_slope>0 AS adx_inflecting, obv_slope_norm>0 AS obv_accumulating,
    obv_slope_norm>=0.05 AND return_20d<=0.03 AS obv_divergence,
    CASE WHEN atrx>0 THEN atrx/(close+1e-9) ELSE 0 END AS atr_pct, (high60-low60)/(close+1e-9) AS range_pct_60d,
    CASE WHEN high60>low60 THEN (close-low60)/(high60-low60+1e-9) ELSE 0.5 END AS price_position_60d, rn>=30 AND bos_flag=1 AS bos_20d,
    CASE WHEN sma20>coalesce(sma20_5ago,sma20) AND atrx>0 THEN (sma20-close)/(atrx+1e-9) ELSE 0 END AS lps_pullback
  FROM (SELECT *, coalesce(box_high_prev,box_high) AS top, coalesce(atr14,(high60-low60)*0.05) AS atrx FROM ind)""")
cte("siglast", ("sig",), "SELECT * FROM sig WHERE rn=nbars")


def indicators(spark, sf_dir):
    return N.add_indicators(A.bars(spark, sf_dir))


def signals_last(spark, sf_dir):
    """Signals of the latest bar with its valuation columns; only one row per instrument meets the join."""
    s = N.box_signals(indicators(spark, sf_dir))
    last = s.withColumn("_last", is_last()).where("_last").drop("_last")
    return A.with_valuation(spark, sf_dir, last)


def _ind(cols, flags=(), texts=(), last=False):
    def run(spark, sf_dir):
        df = signals_last(spark, sf_dir) if last else N.box_signals(indicators(spark, sf_dir))
        return df.select("ts_code", day("trade_date"), *rounded(cols), *map(flag, flags), *texts)

    return run


for _name, _ids, _cols, _flags, _texts, _last in [
    ("indicator_moving_averages", "W-5 W-6", ["sma20", "sma60", "sma120", "sma250", "ema20"], [], [], False),
    ("indicator_true_range", "W-7", ["tr", "atr14"], [], [], False),
    ("indicator_adx", "W-8", ["plus_di", "minus_di", "adx", "adx_slope"], [], [], False),
    ("indicator_bollinger", "W-9", ["bb_width", "bbw_percentile"], [], [], False),
    ("indicator_obv", "W-10 W-11", ["obv", "obv_slope", "obv_slope_norm"], ["obv_divergence"], [], False),
    ("indicator_trend_features", "W-13", ["return_5d", "return_10d", "return_20d", "volume_ratio_5d_vs_60d"], ["fresh_breakout", "near_breakout"], [], False),
    ("indicator_rsi", "W-14", ["rsi14"], [], [], False),
    ("indicator_vwap", "W-15", ["vwap20", "vwap_ratio"], [], [], False),
    ("indicator_box", "W-16", ["box_high", "box_low", "volatility", "price_position"], [], [], False),
    ("indicator_ma_spread", "W-17 W-19", ["ma_spread", "ma_spread_std", "ma_spread_20", "ma_spread_std_20"], [], ["ma_trend"], False),
    ("indicator_boost_and_atr_ratio", "W-18", ["volume_boost", "atr_ratio"], [], [], False),
    ("signals_box_top", "W-21", ["dist_to_box_top", "turnover_mult"],
     ["ignition", "already_breakout", "extended_breakout", "breakout_window_ok", "ready_to_break"], [], True),
    ("signals_squeeze", "W-22", ["atr_ratio", "bbw_percentile"], ["atr_squeeze", "bbw_squeeze", "adx_inflecting", "obv_accumulating"], [], True),
    ("signals_pullback", "W-23", ["atr_pct", "range_pct_60d", "price_position_60d", "lps_pullback"], ["bos_20d"], [], True),
]:
    query(_name, _ids, ("siglast" if _last else "sig",), f"SELECT ts_code, {sql_day('trade_date')}, {sql_round(_cols)}"
          + "".join(f", CAST({f} AS INTEGER) AS {f}" for f in _flags) + "".join(f", {t}" for t in _texts)
          + f" FROM {'siglast' if _last else 'sig'}")(_ind(_cols, _flags, _texts, _last))


@query("turnover_spikes", "W-20", ("bars",), f"""
  SELECT ts_code, {sql_day('trade_date')}, round(turnover_rate,6) AS turnover_rate FROM (
    SELECT *, {_full('avg(turnover_rate)', 'turnover_rate', 20)} AS m FROM bars) WHERE turnover_rate > m*1.5""")
def turnover_spikes(spark, sf_dir):
    return N.turnover_spikes(A.bars(spark, sf_dir), exact_ties=False).select("ts_code", day("trade_date"), *rounded(["turnover_rate"]))


# the weekly bars of the given tables: smaller turnover than daily markets, shorter history
PARAMS = C.ScreenParams(ipo_grace_bars=300, min_amount=1e5)


def screen_input(spark, sf_dir):
    basic = A.stock_basic(spark, sf_dir).select("ts_code", "name", "industry", "market", "exchange", "area")
    return signals_last(spark, sf_dir).join(basic, "ts_code", "left")


cte("scr0", ("siglast", "stock_basic"), """
  SELECT s.*, name, industry, market, exchange, total_mv*10000 AS market_cap,
    CASE WHEN rn<180 THEN 'insufficient' WHEN NOT total_mv*10000 BETWEEN 1e9 AND 5e10 THEN 'market_cap'
      WHEN (pe IS NULL AND rn>=300) OR pe>300 THEN 'pe' WHEN amount60<1e5 THEN 'liquidity' WHEN sma250 IS NULL THEN 'ma_history' END AS skip_reason
  FROM siglast s JOIN stock_basic b USING (ts_code)""")


def _lin(v, lo, hi, pts, inv=False):
    t = f"greatest(0,least(1,(({v})-({lo}))/({hi}-({lo}))))"
    return f"{pts}*(1-{t})" if inv else f"{pts}*{t}"


def _rng(v, lo, hi, pts):
    w = hi - lo
    return (f"CASE WHEN {v} BETWEEN {lo} AND {hi} THEN {pts} WHEN {v}<{lo} THEN greatest(0,{pts}*(1-({lo}-{v})/({w!r}+1e-9))) "
            f"ELSE greatest(0,{pts}*(1-({v}-{hi})/({w!r}+1e-9))) END")


cte("scr1", ("scr0",), f"""
  SELECT *, floor(least(100, greatest(0,1-volatility/0.5)*40+greatest(0,1-ma_spread/0.15)*25+greatest(0,1-ma_spread_std/0.03)*5
      +greatest(0,1-abs(price_position-0.5)/0.2)*20+greatest(0,(volume_boost-1)/0.5)*10)) AS consolidation_score,
    least(100, {_lin('atr_ratio', 0.5, 1.0, 40, True)}+{_lin('bbw_percentile', 0, 0.5, 30, True)}+30*exp(-0.5*pow((adx-15)/(10+1e-9),2))) AS squeeze_readiness
  FROM scr0 WHERE skip_reason IS NULL""")
_PV = {"pe": "pe", "pb": "pb", "ps_ttm": "ps_ttm"}
cte("val", ("scr1",), f"""
  SELECT *, 100-stretch AS valuation_quality_score, stretch AS valuation_stretch_score,
    CASE WHEN stretch>=85 THEN '显著高估' WHEN stretch>=65 THEN '偏贵' WHEN stretch>=40 THEN '适中溢价' ELSE '合理' END AS valuation_label,
    coalesce(pe>250,false) OR coalesce(pb>25,false) OR coalesce(ps_ttm>40,false) OR stretch>=97 OR (pts=0 AND NOT coalesce(pe>0,false)) AS valuation_outlier
  FROM (SELECT *, (p_pe IS NOT NULL)::INT+(p_pb IS NOT NULL)::INT+(p_ps_ttm IS NOT NULL)::INT AS pts,
     coalesce((coalesce(p_pe,0)*0.5+coalesce(p_pb,0)*0.3+coalesce(p_ps_ttm,0)*0.2)/nullif((p_pe IS NOT NULL)::INT*0.5+(p_pb IS NOT NULL)::INT*0.3+(p_ps_ttm IS NOT NULL)::INT*0.2,0)*100,50) AS stretch
   FROM (SELECT a.*, {', '.join(f'''CASE WHEN a.{m}>0 THEN CASE WHEN (SELECT count(*) FROM scr1 x WHERE x.industry=a.industry AND x.{m}>0)>=5
      THEN (SELECT avg(CASE WHEN x.{m}<=a.{m} THEN 1.0 ELSE 0.0 END) FROM scr1 x WHERE x.industry=a.industry AND x.{m}>0)
      ELSE (SELECT avg(CASE WHEN x.{m}<=a.{m} THEN 1.0 ELSE 0.0 END) FROM scr1 x WHERE x.{m}>0) END END AS p_{m},
      CASE WHEN (SELECT count(*) FROM scr1 x WHERE x.industry=a.industry AND x.{m}>0)>=5 THEN 'industry' ELSE 'market' END AS {m}_baseline_source''' for m in _PV)} FROM scr1 a))""")
cte("uni", ("val",), f"""
  SELECT *, least(100, {_lin('oas', 0, 100, 40)}+{_rng('volume_boost', 1.2, 3.0, 35)}+{_rng('avg_turnover', 1.0, 5.0, 25)}) AS volume_quality_score,
    least(100, (CASE WHEN return_20d>0.45 THEN least(8,{_lin('return_20d', 0, 0.45, 25)}) WHEN return_20d<=0.25 THEN {_lin('return_20d', 0, 0.05, 25)} ELSE 8 END)
      +(CASE WHEN return_5d>0 THEN {_lin('return_5d', 0, 0.08, 10)} ELSE 0 END)+(CASE WHEN return_10d>0 THEN {_lin('return_10d', 0, 0.15, 6)} ELSE 0 END)
      +(CASE WHEN return_5d>return_20d/4 THEN 4 ELSE 0 END)
      +(CASE WHEN volume_ratio_5d_vs_60d>4 THEN least(12,{_lin('volume_ratio_5d_vs_60d', 1, 2.5, 20)}) ELSE {_lin('volume_ratio_5d_vs_60d', 1, 2.5, 20)} END)
      +(CASE WHEN fresh_breakout THEN 0 WHEN near_breakout THEN 5 ELSE 15 END)+{_lin('oas', 0, 100, 15)}) AS trend_emergence_score, oas AS obv_accumulation_score
  FROM (SELECT *, greatest(0,least(100,coalesce((rank() OVER (PARTITION BY obv_slope_norm>0 ORDER BY obv_slope_norm)
      +(count(*) OVER (PARTITION BY obv_slope_norm)-1)/2.0)/nullif(CASE WHEN obv_slope_norm>0 THEN count(*) OVER (PARTITION BY obv_slope_norm>0) END,0)*85,0)
      +CASE WHEN obv_divergence THEN 15 ELSE 0 END)) AS oas FROM val WHERE NOT valuation_outlier)""")

_BASIC_COLS = ["market_cap", "consolidation_score", "squeeze_readiness"]


@query("screen_filters", "P-1 P-2 P-3 P-4 P-5 P-6 J-1", ("scr0",), """
  SELECT ts_code, name, coalesce(skip_reason,'kept') AS outcome, round(market_cap,2) AS market_cap FROM scr0""")
def screen_filters(spark, sf_dir):
    return C.skip_reason(screen_input(spark, sf_dir), PARAMS).select(
        "ts_code", "name", F.coalesce("skip_reason", F.lit("kept")).alias("outcome"), F.round("market_cap", 2).alias("market_cap"))


@query("screen_skip_counts", "Q-3", ("scr0",), "SELECT coalesce(skip_reason,'kept') AS outcome, count(*) AS instruments FROM scr0 GROUP BY 1")
def screen_skip_counts(spark, sf_dir):
    return C.skip_reason(screen_input(spark, sf_dir), PARAMS).groupBy(F.coalesce("skip_reason", F.lit("kept")).alias("outcome")).agg(
        F.count(F.lit(1)).alias("instruments"))


@query("screen_technical_scores", "F-1 F-2 F-7 F-8", ("scr1",), f"SELECT ts_code, {sql_round(_BASIC_COLS)} FROM scr1")
def screen_technical_scores(spark, sf_dir):
    kept = C.skip_reason(screen_input(spark, sf_dir), PARAMS).where("skip_reason is null")
    return C.technical_scores(kept).select("ts_code", *rounded(_BASIC_COLS))


_VAL = ["valuation_stretch_score", "valuation_quality_score"]


@query("industry_relative_valuation", "A-5 F-4 F-10 P-7", ("val",), f"""
  SELECT ts_code, industry, {sql_round(_VAL)}, valuation_label, CAST(valuation_outlier AS INTEGER) AS valuation_outlier,
    pe_baseline_source, pb_baseline_source FROM val""")
def industry_relative_valuation(spark, sf_dir):
    kept = C.technical_scores(C.skip_reason(screen_input(spark, sf_dir), PARAMS).where("skip_reason is null"))
    return C.relative_valuation(kept, A.instrument_count(spark, sf_dir), PARAMS).select(
        "ts_code", "industry", *rounded(_VAL), "valuation_label", flag("valuation_outlier"), "pe_baseline_source", "pb_baseline_source")


cte("valr", ("stock_basic", "vbars"), """
  SELECT ts_code, area AS industry, pe, pb FROM stock_basic JOIN (SELECT * FROM vbars WHERE rn=nbars) USING (ts_code)""")


@query("valuation_within_regions", "A-5", ("valr",), """
  SELECT ts_code, industry, round(CASE WHEN pb>0 THEN (SELECT avg(CASE WHEN x.pb<=a.pb THEN 1.0 ELSE 0.0 END) FROM valr x WHERE x.industry=a.industry) END,6) AS pb_percentile,
    CASE WHEN (SELECT count(*) FROM valr x WHERE x.industry=a.industry AND pe>0)>=5 THEN 'industry' ELSE 'market' END AS pe_source FROM valr a""")
def valuation_within_regions(spark, sf_dir):
    b = A.bars(spark, sf_dir)
    last = A.with_valuation(spark, sf_dir, b.withColumn("_last", is_last()).where("_last").drop("_last"))
    r = last.join(A.stock_basic(spark, sf_dir).select("ts_code", F.col("area").alias("industry")), "ts_code")
    return C.relative_valuation(r, A.instrument_count(spark, sf_dir)).select(
        "ts_code", "industry", F.round("pb_percentile_industry", 6).alias("pb_percentile"), F.col("pe_baseline_source").alias("pe_source"))


def universe(spark, sf_dir):
    n = A.instrument_count(spark, sf_dir)
    kept = C.technical_scores(C.skip_reason(screen_input(spark, sf_dir), PARAMS).where("skip_reason is null"))
    return C.universe_scores(C.relative_valuation(kept, n, PARAMS).where("not valuation_outlier"), n)


_UNI = ["obv_accumulation_score", "volume_quality_score", "trend_emergence_score"]


@query("universe_volume_and_trend_scores", "W-12 F-3 F-5 F-6", ("uni",), f"SELECT ts_code, {sql_round(_UNI)} FROM uni")
def universe_volume_and_trend_scores(spark, sf_dir):
    return universe(spark, sf_dir).select("ts_code", *rounded(_UNI))


def quality(spark, sf_dir):
    return B.fundamental_quality(A.financial(spark, sf_dir), A.stock_basic(spark, sf_dir))


def screened(spark, sf_dir):
    q = quality(spark, sf_dir).where("quarter_count >= 2").select("ts_code", "fundamental_quality_score", F.col("stage").alias("lifecycle_stage"))
    return C.screen(screen_input(spark, sf_dir), q, A.instrument_count(spark, sf_dir), PARAMS)


cte("scr", ("uni", "quality"), """
  SELECT u.*, coalesce(fq,50) AS fundamental_quality_score, coalesce(stage,'unknown') AS lifecycle_stage,
    consolidation_score*0.48+volume_quality_score*0.05+squeeze_readiness*0.15+valuation_quality_score*0.10+coalesce(fq,50)*0.22 AS composite_score
  FROM uni u LEFT JOIN (SELECT ts_code AS qc, fundamental_quality_score AS fq, stage FROM quality WHERE quarter_count>=2) ON qc=u.ts_code""")
_SCR = ["consolidation_score", "volume_quality_score", "squeeze_readiness", "valuation_quality_score", "fundamental_quality_score",
        "trend_emergence_score", "composite_score"]


@query("screen_universe", "F-9 J-1 J-2 K-1 B-15", ("scr", "stock_company"), f"""
  SELECT ts_code, name, industry, lifecycle_stage, main_business, {sql_round(_SCR, 4)} FROM scr LEFT JOIN stock_company USING (ts_code)
  ORDER BY scr.composite_score DESC, ts_code""")
def screen_universe(spark, sf_dir):
    company = A.stock_company(spark, sf_dir).select("ts_code", "main_business")
    return screened(spark, sf_dir).join(company, "ts_code", "left").orderBy(F.desc("composite_score"), "ts_code").select(
        "ts_code", "name", "industry", "lifecycle_stage", "main_business", *rounded(_SCR, 4))


@query("score_distribution", "A-20", ("scr",), " UNION ALL ".join(
    f"SELECT '{s}' AS score, round(quantile_cont({s},0.25),4) AS p25, round(quantile_cont({s},0.5),4) AS p50, round(quantile_cont({s},0.75),4) AS p75 FROM scr"
    for s in ("composite_score", "consolidation_score", "squeeze_readiness", "volume_quality_score", "trend_emergence_score")))
def score_distribution(spark, sf_dir):
    names = ["composite_score", "consolidation_score", "squeeze_readiness", "volume_quality_score", "trend_emergence_score"]
    long = screened(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(n).alias("score"), F.col(n).alias("v")) for n in names])).alias("s")).select("s.*")
    return R.percentiles(long, ["score"], "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, A.instrument_count(spark, sf_dir)).select(
        "score", *rounded(["p25", "p50", "p75"], 4))


cte("top50", ("scr",), "SELECT * FROM scr ORDER BY composite_score DESC, ts_code LIMIT 50")


@query("top_composition", "A-21", ("top50",), """
  SELECT * FROM (SELECT 'industry' AS kind, industry AS bucket, count(*) AS names FROM top50 GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
  UNION ALL SELECT 'exchange', exchange, count(*) FROM top50 GROUP BY 2
  UNION ALL SELECT 'cap', b, count(*) FROM (SELECT CASE WHEN market_cap/1e8<50 THEN 'other' WHEN market_cap/1e8<=100 THEN '50-100' WHEN market_cap/1e8<=200 THEN '100-200'
     WHEN market_cap/1e8<=300 THEN '200-300' ELSE 'other' END AS b FROM top50) GROUP BY 2
  UNION ALL SELECT 'score', b, count(*) FROM (SELECT CASE WHEN composite_score<=40 THEN '0-40' WHEN composite_score<=60 THEN '40-60' WHEN composite_score<=80 THEN '60-80' ELSE '80-100' END AS b FROM top50) GROUP BY 2""")
def top_composition(spark, sf_dir):
    top = screened(spark, sf_dir).orderBy(F.desc("composite_score"), "ts_code").limit(50)
    cap, s = F.col("market_cap") / 1e8, F.col("composite_score")
    caps = F.when(cap < 50, "other").when(cap <= 100, "50-100").when(cap <= 200, "100-200").when(cap <= 300, "200-300").otherwise("other")
    bands = F.when(s <= 40, "0-40").when(s <= 60, "40-60").when(s <= 80, "60-80").otherwise("80-100")
    item = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("bucket")) for k, v in
                               [("industry", F.col("industry")), ("exchange", F.col("exchange")), ("cap", caps), ("score", bands)]]))
    counts = top.select(item.alias("i")).groupBy("i.kind", "i.bucket").agg(F.count(F.lit(1)).alias("names"))
    return R.top_n(counts, ["kind"], 10, F.desc("names"), F.col("bucket"))


cte("tm0", ("bars",), f"""
  SELECT *, CASE WHEN count(high) OVER b=10 AND count(high) OVER a=10 AND high>max(high) OVER b AND high>max(high) OVER a THEN high END AS swing,
    coalesce(greatest(high-low,abs(high-pc),abs(low-pc)),high-low) AS tr, {_full('avg(close)', 'close', 20)} AS ma20
  FROM (SELECT *, lag(close) OVER ({_W}) AS pc FROM bars)
  WINDOW b AS ({_W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), a AS ({_W} ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)""")
cte("tm1", ("tm0",), f"""
  SELECT *, {_full('avg(tr)', 'tr', 14)} AS atr, avg(vol) OVER ({_W} ROWS 19 PRECEDING) AS vol20, lag(ma20,5) OVER ({_W}) AS ma20_ago,
    last_value(swing IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sb,
    min(low) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later_low FROM tm0""")
cte("poc", ("bars",), """
  SELECT ts_code, CASE WHEN hi<=lo THEN lo ELSE lo+(hi-lo)/30*(bin+0.5) END AS poc FROM (
    SELECT ts_code, bin, any_value(lo) AS lo, any_value(hi) AS hi, sum(vol) AS v FROM (
      SELECT *, CASE WHEN hi>lo THEN least(29,greatest(0,floor((close-lo)/(hi-lo)*30-1e-9))) ELSE 0 END AS bin FROM (
        SELECT *, min(close) OVER (PARTITION BY ts_code) AS lo, max(close) OVER (PARTITION BY ts_code) AS hi FROM bars WHERE rn>nbars-60 AND nbars>=20))
    GROUP BY ts_code, bin) QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY v DESC, bin)=1""")
cte("tm", ("tm1", "poc"), """
  SELECT l.ts_code, l.trade_date, poc, coalesce(l.nbars>=21 AND l.close>l.sb,false) AS timing_bos,
    coalesce(l.nbars>=21 AND l.close>l.sb,false) AND coalesce((SELECT count(*)>0 FROM tm1 t, (SELECT min(x.rn) AS brn, any_value(p.sw) AS sw FROM tm1 x,
        (SELECT swing AS sw, rn AS prn FROM tm1 s WHERE s.ts_code=l.ts_code AND swing IS NOT NULL ORDER BY rn DESC LIMIT 1 OFFSET 1) p
        WHERE x.ts_code=l.ts_code AND x.rn>p.prn AND x.close>p.sw) z
      WHERE t.ts_code=l.ts_code AND t.rn>z.brn AND t.low>=z.sw-l.atr*0.3 AND t.low<=z.sw+l.atr*0.2 AND l.close>z.sw-l.atr*0.3 AND l.atr>0),false) AS timing_true_bos,
    coalesce(l.nbars>=21 AND l.close>l.sb AND l.vol>l.vol20*1.5,false) AS timing_joc, coalesce(l.atr>0 AND abs(l.close-poc)<=l.atr,false) AS timing_poc,
    coalesce(l.atr>0 AND abs(l.close-poc)<=l.atr AND l.nbars>=20 AND l.vol<l.vol20,false) AND
      (SELECT count(*)>0 FROM tm1 t WHERE t.ts_code=l.ts_code AND t.rn BETWEEN l.rn-5 AND l.rn-1 AND t.close>poc+l.atr*0.5) AS timing_poc_retest,
    l.nbars>=7 AND (SELECT count(*)>0 FROM tm1 t WHERE t.ts_code=l.ts_code AND (t.open-t.pc)/(t.pc+1e-9)>0.005 AND t.nbars-t.rn>=5 AND t.later_low>=t.pc*0.999) AS timing_gap_hold,
    coalesce(l.nbars>=60 AND l.atr>0 AND l.ma20>l.ma20_ago AND abs(l.close-l.ma20)<=l.atr AND l.vol<l.vol20,false) AND
      (SELECT count(*)>0 FROM tm1 t WHERE t.ts_code=l.ts_code AND t.rn BETWEEN l.rn-20 AND l.rn AND t.close>t.sb) AS timing_lps
  FROM (SELECT * FROM tm1 WHERE rn=nbars) l LEFT JOIN poc USING (ts_code)""")


@query("timing_detectors", "W-49 W-50 W-51 W-52 W-53 W-54 W-55 W-56", ("tm",), f"""
  SELECT ts_code, {', '.join(f'CAST({d} AS INTEGER) AS {d}' for d in M.DETECTORS)}, round(({'+'.join(f'CAST({d} AS INTEGER)' for d in M.DETECTORS)})/7.0,6) AS timing_score FROM tm""")
def timing_detectors(spark, sf_dir):
    return M.latest_timing(A.bars(spark, sf_dir)).select("ts_code", *map(flag, M.DETECTORS), *rounded(["timing_score"]))


@query("volume_profile_poc", "A-29", ("poc",), "SELECT ts_code, round(poc,6) AS poc FROM poc")
def volume_profile_poc(spark, sf_dir):
    return M.volume_profile_poc(A.bars(spark, sf_dir)).select("ts_code", *rounded(["poc"]))
