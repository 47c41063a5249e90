"""Capital-flow and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import scores as S
from tickloom.operators import flow as W
from tickloom.operators import ranking as R
from tickloom.operators import selection as X
from tickloom.operators import timing as M
from tickloom.plans.common import day, r6, rounded, sql_day, sql_round
from tickloom.plans.oracle_base import cte
from tickloom.plans.registry import query
from tickloom.plans.screen_queries import screened, signals_last
from tickloom.plans.validation_queries import snapshots
from tickloom.sources import adapters as A

AS_OF = "2024-01-31"
cte("tl", ("top_list", "stock_basic"), "SELECT t.*, industry, name FROM top_list t LEFT JOIN stock_basic USING (ts_code)")


@query("recent_top_list", "S-8 J-3", ("tl",), f"""
  SELECT event_id, {sql_day('trade_date')}, ts_code, industry, round(net_amount,4) AS net_amount FROM tl WHERE trade_date > DATE '{AS_OF}' - 10 AND trade_date <= DATE '{AS_OF}'""")
def recent_top_list(spark, sf_dir):
    basic = A.stock_basic(spark, sf_dir).select("ts_code", "industry")
    return W.recent(A.top_list(spark, sf_dir), AS_OF, 10).join(basic, "ts_code", "left").select(
        "event_id", day("trade_date"), "ts_code", "industry", r6("net_amount", 4))


@query("industry_heat", "A-1 A-2 J-3", ("tl", "top_inst"), """
  SELECT industry, count(*) AS hit_count, round(sum(net_amount),4) AS net_buy, any_value(h.hot) AS hot_stocks, round(any_value(m.north),6) AS north, round(any_value(m.inst),6) AS inst,
    CASE WHEN sum(net_amount) FILTER (r>n//2) > sum(net_amount) FILTER (r<=n//2)*1.2 THEN 'accelerating' WHEN sum(net_amount) FILTER (r>n//2) < sum(net_amount) FILTER (r<=n//2)*0.8 THEN 'declining' ELSE 'stable' END AS trend
  FROM (SELECT *, row_number() OVER (PARTITION BY industry ORDER BY trade_date, event_id) AS r, count(*) OVER (PARTITION BY industry) AS n FROM tl)
  LEFT JOIN (SELECT industry, string_agg(name,'|' ORDER BY net DESC, ts_code) AS hot FROM (SELECT industry, ts_code, any_value(name) AS name, sum(net_amount) AS net FROM tl GROUP BY 1,2
      QUALIFY row_number() OVER (PARTITION BY industry ORDER BY sum(net_amount) DESC, ts_code)<=5) GROUP BY 1) h USING (industry)
  LEFT JOIN (SELECT industry, sum(CASE WHEN regexp_matches(exalter,'沪股通|深股通') THEN buy ELSE 0 END)/sum(buy) AS north, sum(CASE WHEN exalter='机构专用' THEN buy ELSE 0 END)/sum(buy) AS inst
      FROM top_inst JOIN (SELECT DISTINCT ts_code, industry FROM tl) USING (ts_code) GROUP BY 1) m USING (industry) GROUP BY industry""")
def industry_heat(spark, sf_dir):
    h = W.industry_heat(A.top_list(spark, sf_dir), A.top_inst(spark, sf_dir), A.stock_basic(spark, sf_dir))
    return h.select("industry", "hit_count", r6("net_buy", 4), F.array_join("hot_stocks", "|").alias("hot_stocks"), r6("north"), r6("inst"), "trend")


@query("top_list_hits", "A-3 A-4", ("top_list",), "SELECT ts_code, count(*) AS toplist_hit_count, round(least(1.0,count(*)/5.0),6) AS toplist_recency_score FROM top_list GROUP BY 1")
def top_list_hits(spark, sf_dir):
    return W.hit_counts(A.top_list(spark, sf_dir)).select("ts_code", "toplist_hit_count", r6("toplist_recency_score"))


@query("crowding_modes", "P-9 A-3", ("top_list", "stock_basic"), """
  SELECT ts_code, coalesce(c,0) AS toplist_hit_count, CASE WHEN coalesce(c,0)>=4 THEN 'excluded' ELSE 'kept' END AS crowded FROM stock_basic LEFT JOIN (SELECT ts_code, count(*) AS c FROM top_list GROUP BY 1) USING (ts_code)""")
def crowding_modes(spark, sf_dir):
    h = W.hit_counts(A.top_list(spark, sf_dir))
    n = F.coalesce("toplist_hit_count", F.lit(0).cast("long"))
    return A.stock_basic(spark, sf_dir).join(h, "ts_code", "left").select(
        "ts_code", n.alias("toplist_hit_count"), F.when(n >= 4, "excluded").otherwise("kept").alias("crowded"))


@query("seat_flow_split", "A-32 A-35", ("top_inst",), """
  SELECT ts_code, CASE WHEN regexp_matches(exalter,'沪股通|深股通') THEN 'north' WHEN exalter='机构专用' THEN 'inst' ELSE 'hot_money' END AS seat, count(*) AS seats, round(sum(net_buy),4) AS net_buy FROM top_inst GROUP BY ALL""")
def seat_flow_split(spark, sf_dir):
    return A.top_inst(spark, sf_dir).groupBy("ts_code", W.seat_class("exalter").alias("seat")).agg(
        F.count(F.lit(1)).alias("seats"), F.round(F.sum("net_buy"), 4).alias("net_buy"))


@query("seats_of_listed_industry", "J-4", ("tl", "top_inst"), """
  SELECT event_id, exalter, round(buy,4) AS buy FROM top_inst WHERE ts_code IN (SELECT ts_code FROM tl WHERE industry='NATION_3')""")
def seats_of_listed_industry(spark, sf_dir):
    codes = A.top_list(spark, sf_dir).select("ts_code").join(A.stock_basic(spark, sf_dir).where("industry = 'NATION_3'").select("ts_code"), "ts_code")
    return A.top_inst(spark, sf_dir).join(codes, "ts_code", "left_semi").select("event_id", "exalter", r6("buy", 4))


@query("list_presence", "A-36", ("top_list",), """
  SELECT ts_code, count(*) AS appearances, round(sum(net_amount),4) AS net, arg_max(reason,event_id) AS last_reason FROM top_list GROUP BY 1""")
def list_presence(spark, sf_dir):
    return A.top_list(spark, sf_dir).groupBy("ts_code").agg(
        F.count(F.lit(1)).alias("appearances"), F.round(F.sum("net_amount"), 4).alias("net"), F.max_by("reason", "event_id").alias("last_reason"))


# thresholds of a market's size are parameters; the given amounts are small
_FLOOR = 1.0


@query("market_sentiment", "A-30", ("top_list", "top_inst"), f"""
  SELECT score, CASE WHEN n=0 THEN 'NO DATA' WHEN score>=70 THEN 'BULLISH' WHEN score>=55 THEN 'NEUTRAL-BULLISH' WHEN score>=45 THEN 'NEUTRAL' WHEN score>=30 THEN 'NEUTRAL-BEARISH' ELSE 'BEARISH' END AS label,
    round(f,2) AS capital_flow, round(b,2) AS breadth, round(t,2) AS theme_strength
  FROM (SELECT *, CAST(floor(round(f*0.4+b*0.3+t*0.3,2)*100) AS INTEGER) AS score FROM (
    SELECT count(*) AS n, (greatest(-1,least(1,sum(net_amount)/greatest(abs(sum(2*l_buy-net_amount)),{_FLOOR})))+1)/2 AS f, least(1.0,count(DISTINCT ts_code)/100.0) AS b FROM top_list),
    (SELECT (greatest(-1,least(1,sum(net_buy)/greatest(abs(sum(buy)+sum(sell)),{_FLOOR})))+1)/2 AS t FROM top_inst))""")
def market_sentiment(spark, sf_dir):
    return W.market_sentiment(A.top_list(spark, sf_dir), A.top_inst(spark, sf_dir), _FLOOR)


@query("market_breadth", "A-31", ("ind",), f"""
  SELECT {sql_day('trade_date')}, CASE WHEN count(*) FILTER (return_5d<0)>0 THEN round(count(*) FILTER (return_5d>0)/count(*) FILTER (return_5d<0),2) ELSE 1.0 END AS advance_decline_ratio,
    round(count(*) FILTER (close>sma20)/count(*)*100,1) AS pct_above_ma20, round(count(*) FILTER (close>sma60)/count(*)*100,1) AS pct_above_ma60, round(count(*) FILTER (v5/v20>1)/count(*)*100,1) AS volume_breadth
  FROM (SELECT *, avg(vol) OVER (w ROWS 4 PRECEDING) AS v5, CASE WHEN count(*) OVER (w ROWS 19 PRECEDING)=20 THEN avg(vol) OVER (w ROWS 19 PRECEDING) END AS v20 FROM ind WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date))
  GROUP BY trade_date""")
def market_breadth(spark, sf_dir):
    from tickloom.plans.screen_queries import indicators

    w = R.Window.partitionBy("ts_code").orderBy("trade_date")
    v20 = F.when(F.count(F.lit(1)).over(w.rowsBetween(-19, 0)) == 20, F.avg("vol").over(w.rowsBetween(-19, 0)))
    rows = indicators(spark, sf_dir).select("ts_code", "trade_date", "close", "sma20", "sma60", "return_5d", (F.avg("vol").over(w.rowsBetween(-4, 0)) / v20).alias("vol_ratio_5_20"))
    return W.breadth(rows).select(day("trade_date"), "advance_decline_ratio", "pct_above_ma20", "pct_above_ma60", "volume_breadth")


@query("theme_status", "J-22", ("tl", "stock_basic"), """
  SELECT coalesce(w.name,c.name) AS name, CASE WHEN w.name IS NOT NULL AND c.name IS NOT NULL THEN 'confirmed' WHEN c.name IS NOT NULL THEN 'capital_only' WHEN support>=2 THEN 'web_only' ELSE 'weak' END AS validation_status
  FROM (SELECT industry AS name, count(*) AS support FROM stock_basic WHERE name NOT LIKE 'ST%' GROUP BY 1) w FULL JOIN (SELECT industry AS name FROM tl GROUP BY 1 HAVING sum(net_amount)>0) c ON w.name=c.name""")
def theme_status(spark, sf_dir):
    basic = A.stock_basic(spark, sf_dir)
    web = basic.where("name not like 'ST%'").groupBy(F.col("industry").alias("name")).agg(F.count(F.lit(1)).alias("support"))
    cap = A.top_list(spark, sf_dir).join(basic.select("ts_code", "industry"), "ts_code").groupBy(F.col("industry").alias("name")).agg(
        F.sum("net_amount").alias("net")).where("net > 0")
    return W.theme_status(web, cap).select("name", "validation_status")


_RG = """CASE WHEN ma_trend='bearish' AND pos<0.5 AND adx_>25 THEN 'downtrend' WHEN pos<0.2 AND (ma_trend='bearish' OR obv_divergence) THEN 'bottom_fishing'
    WHEN pos>0.85 AND ignition AND dt<0.05 THEN 'breakout_zone' WHEN pos>0.8 AND adx_>30 AND adx_slope>0 THEN 'breakout_zone'
    WHEN ma_trend='bullish' AND adx_>30 AND bos_20d THEN 'uptrend' WHEN ma_trend='bullish' AND adx_>22 THEN 'uptrend' ELSE 'range' END"""
cte("reg", ("siglast", "tm"), f"""
  SELECT *, {_RG} AS market_regime, CASE WHEN ma_trend='bearish' AND pos<0.5 AND adx_>25 THEN least(0.9,adx_/50) WHEN pos<0.2 AND (ma_trend='bearish' OR obv_divergence) THEN CASE WHEN ma_trend='bearish' THEN 0.7 ELSE 0.55 END
    WHEN pos>0.85 AND ignition AND dt<0.05 THEN 0.85 WHEN pos>0.8 AND adx_>30 AND adx_slope>0 THEN 0.6 WHEN ma_trend='bullish' AND adx_>30 AND bos_20d THEN least(0.9,0.5+0.1*least(5,ts))
    WHEN ma_trend='bullish' AND adx_>22 THEN 0.5 WHEN adx_<18 THEN 0.75 ELSE 0.5 END AS regime_confidence
  FROM (SELECT s.*, timing_bos, ({'+'.join(f'CAST({d} AS INTEGER)' for d in M.DETECTORS)})/7.0 AS ts, coalesce(nullif(adx,0),20) AS adx_, coalesce(nullif(close_position,0),0.5) AS pos,
    coalesce(nullif(dist_to_box_top,0),0.10) AS dt FROM siglast s JOIN tm USING (ts_code))""")


def regimes(spark, sf_dir):
    t = M.latest_timing(A.bars(spark, sf_dir)).select("ts_code", "timing_bos", "timing_score")
    return X.add_regime(signals_last(spark, sf_dir).join(t, "ts_code"))


@query("market_regime", "F-12", ("reg",), "SELECT ts_code, market_regime, round(regime_confidence,6) AS regime_confidence FROM reg")
def market_regime(spark, sf_dir):
    return regimes(spark, sf_dir).select("ts_code", "market_regime", r6("regime_confidence"))


_C01 = lambda x: f"greatest(0,least(1,{x}))"
cte("afeat", ("aud",), """
  SELECT ts_code AS ac, max(CASE verdict WHEN 'fail' THEN 0.95 WHEN 'pass' THEN 0.1 ELSE 0.45 END)::DOUBLE AS risk, sum(len(f)) AS pf, len(list_distinct(flatten(array_agg(f)))) AS cd,
    avg(tier) AS sq, avg(coalesce(nullif(bq,0),50)) AS abq FROM aud GROUP BY 1""")
cte("alpha", ("reg", "scr", "top_list", "afeat"), f"""
  SELECT *, 100*{_C01('''quality*0.4+setup*0.35+audit*0.25-0.12*crowd-0.08*rough
    +CASE WHEN market_regime='uptrend' THEN pull*0.12 WHEN market_regime='range' AND pos<0.4 THEN pull*0.05 ELSE 0 END
    +CASE WHEN market_regime='range' THEN greatest(0,least(1,1-abs(pos-0.3)/0.4))*0.08*conf ELSE 0 END
    +CASE WHEN market_regime='breakout_zone' THEN -0.08*conf WHEN pos>0.9 THEN -0.05 ELSE 0 END
    +CASE WHEN market_regime='downtrend' THEN -0.06*conf WHEN market_regime='bottom_fishing' THEN -0.03*conf ELSE 0 END''')} AS alpha_rank_score
  FROM (SELECT c.*, r.market_regime, r.pos, r.regime_confidence AS conf, {_C01('coalesce(abq,50)/100')}*0.7+{_C01('valuation_quality_score/100')}*0.3 AS quality,
     {_C01('consolidation_score/100')}*0.5+{_C01('squeeze_readiness/100')}*0.25+{_C01('c.lps_pullback/5')}*0.25 AS setup, {_C01('coalesce(pf,0)/4')}*0.30+{_C01('coalesce(cd,0)/3')}*0.25+{_C01('coalesce(sq,0)')}*0.20+(1-{_C01('coalesce(risk,0.5)')})*0.25 AS audit,
     {_C01(f"0.65*least(1.0,coalesce(h,0)/5.0)+0.35*{_C01('(c.turnover_mult-3)/2')}")} AS crowd, {_C01('c.atr_pct/0.06+c.range_pct_60d/0.5')}/2 AS rough,
     CASE WHEN (timing_bos OR c.bos_20d) AND c.lps_pullback BETWEEN 0.5 AND 4 THEN {_C01('c.lps_pullback/3')} ELSE 0 END AS pull
   FROM scr c JOIN reg r ON r.ts_code=c.ts_code LEFT JOIN (SELECT ts_code AS hc, count(*) AS h FROM top_list GROUP BY 1) ON hc=c.ts_code LEFT JOIN afeat ON ac=c.ts_code)""")


@query("alpha_rank", "F-13 F-14 J-19", ("alpha",), "SELECT ts_code, market_regime, round(alpha_rank_score,4) AS alpha_rank_score FROM alpha")
def alpha_rank(spark, sf_dir):
    t = M.latest_timing(A.bars(spark, sf_dir)).select("ts_code", "timing_bos", "timing_score")
    u = screened(spark, sf_dir).join(t, "ts_code").join(W.hit_counts(A.top_list(spark, sf_dir)), "ts_code", "left")
    from tickloom.functions.text import source_tier
    from tickloom.plans.audit_queries import audits  # which imports this module

    u = u.join(X.audit_features(audits(spark, sf_dir), source_tier), "ts_code", "left")  # a name without audits gets the neutral values of add_alpha
    return X.add_alpha(X.add_regime(u)).select("ts_code", "market_regime", r6("alpha_rank_score", 4))


@query("post_audit_trim", "K-3 P-16", ("snap",), """
  SELECT run_id, ts_code, list_type, r AS final_rank FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY tier, p) AS r FROM (
    SELECT *, CASE WHEN list_type='theme_driven' AND p<=8 THEN 0 WHEN list_type='technical' THEN 1 ELSE 2 END AS tier FROM (
      SELECT *, row_number() OVER (PARTITION BY run_id, list_type ORDER BY alpha_rank_score DESC, ts_code) AS p FROM snap WHERE alpha_rank_score IS NOT NULL))) WHERE r<=15""")
def post_audit_trim(spark, sf_dir):
    s = snapshots(spark, sf_dir).where("alpha_rank_score is not null").select("run_id", "ts_code", "list_type", "alpha_rank_score")
    return X.trim_after_audit(s, ["run_id"]).select("run_id", "ts_code", "list_type", "final_rank")


@query("diversified_picks", "K-5", ("snap",), """
  WITH RECURSIVE ordered AS (
    SELECT run_id, ts_code, industry, market AS theme, row_number() OVER (PARTITION BY run_id ORDER BY alpha_rank_score DESC, ts_code) AS position
    FROM snap WHERE alpha_rank_score IS NOT NULL),
  walk AS (
    SELECT run_id, CAST(0 AS BIGINT) AS at_row, CAST([] AS VARCHAR[]) AS themes, CAST([] AS VARCHAR[]) AS industries, CAST([] AS BIGINT[]) AS taken FROM (SELECT DISTINCT run_id FROM ordered)
    UNION ALL
    SELECT run_id, position, CASE WHEN fits THEN list_append(themes, theme) ELSE themes END, CASE WHEN fits THEN list_append(industries, industry) ELSE industries END,
           CASE WHEN fits THEN list_append(taken, position) ELSE taken END
    FROM (SELECT w.*, o.position, o.theme, o.industry, len(taken)<10 AND len(list_filter(themes, lambda x: x=o.theme))<4 AND len(list_filter(industries, lambda x: x=o.industry))<4 AS fits
          FROM walk w JOIN ordered o ON o.run_id=w.run_id AND o.position=w.at_row+1)),
  last AS (SELECT run_id, arg_max(taken, at_row) AS taken FROM walk GROUP BY run_id),
  picked AS (SELECT o.*, CASE WHEN list_contains(taken, position) THEN 0 ELSE 1 END AS filled FROM ordered o JOIN last USING (run_id))
  SELECT run_id, ts_code, theme AS primary_theme, industry, position, CAST(row_number() OVER (PARTITION BY run_id ORDER BY filled, position) AS INTEGER) AS pick_order
  FROM picked QUALIFY pick_order<=10""")
def diversified_picks(spark, sf_dir):
    s = snapshots(spark, sf_dir).where("alpha_rank_score is not null")
    w = R.Window.partitionBy("run_id").orderBy(F.desc("alpha_rank_score"), "ts_code")
    ranked = s.select("run_id", "ts_code", "industry", F.col("market").alias("primary_theme"), F.row_number().over(w).alias("position"))
    return X.diversify(ranked, "run_id", "position").select("run_id", "ts_code", "primary_theme", "industry", "position", "pick_order")


cte("rounds", ("scr",), " UNION ALL ".join(
    f"SELECT {r} AS round, ts_code, composite_score AS s FROM scr WHERE consolidation_score>={X.RELAXATION[r][2]} QUALIFY row_number() OVER (ORDER BY composite_score DESC, ts_code)<={X.RELAXATION[r][3]}" for r in X.RELAXATION))


@query("technical_pool_rounds", "P-8 K-1", ("rounds",), "SELECT round, ts_code, round(s,4) AS composite_score FROM rounds")
def technical_pool_rounds(spark, sf_dir):
    u = screened(spark, sf_dir).select("ts_code", "composite_score", "consolidation_score")
    rounds = F.explode(F.array(*[F.struct(F.lit(r).alias("round"), F.lit(float(v[2])).alias("floor"), F.lit(v[3]).alias("cap")) for r, v in X.RELAXATION.items()]))
    long = u.select("*", rounds.alias("r")).select("ts_code", "composite_score", "consolidation_score", "r.*").where("consolidation_score >= floor")
    most = max(v[3] for v in X.RELAXATION.values())
    w = R.Window.partitionBy("round").orderBy(F.desc("composite_score"), "ts_code")
    top = long.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).where("k <= cap")
    return top.select("round", "ts_code", r6("composite_score", 4))


@query("pre_audit_score", "F-11", ("scr", "top_list"), """
  SELECT ts_code, round(0.35*fundamental_quality_score+0.15*valuation_quality_score+0.35*consolidation_score+0.15*squeeze_readiness-0.05*least(1.0,coalesce(h,0)/5.0),4) AS pre_audit
  FROM scr LEFT JOIN (SELECT ts_code AS hc, count(*) AS h FROM top_list GROUP BY 1) ON hc=ts_code""")
def pre_audit_score(spark, sf_dir):
    u = screened(spark, sf_dir).join(W.hit_counts(A.top_list(spark, sf_dir)), "ts_code", "left")
    c = F.col
    return u.select("ts_code", F.round(S.pre_audit(c("fundamental_quality_score"), c("valuation_quality_score"), c("consolidation_score"), c("squeeze_readiness"),
                                                   F.coalesce("toplist_recency_score", F.lit(0.0))), 4).alias("pre_audit"))


@query("trailing_returns", "J-20", ("bars",), """
  SELECT ts_code, round((close-c5)/greatest(c5,1e-9),6) AS ret_5d, round((close-c10)/greatest(c10,1e-9),6) AS ret_10d, round((close-c20)/greatest(c20,1e-9),6) AS ret_20d
  FROM (SELECT *, lag(close,5) OVER w AS c5, lag(close,10) OVER w AS c10, lag(close,20) OVER w AS c20 FROM bars WINDOW w AS (PARTITION BY ts_code ORDER BY trade_date)) WHERE rn=nbars""")
def trailing_returns(spark, sf_dir):
    from tickloom.operators.timeseries import by_date, is_last

    ret = lambda h: F.round((F.col("close") - F.lag("close", h).over(by_date())) / F.greatest(F.lag("close", h).over(by_date()), F.lit(1e-9)), 6)
    return A.bars(spark, sf_dir).select("ts_code", *[ret(h).alias(f"ret_{h}d") for h in (5, 10, 20)], is_last().alias("l")).where("l").drop("l")
