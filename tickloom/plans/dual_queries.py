"""Dual candidate list and audit confidence."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import scores as S
from tickloom.operators import evidence as V
from tickloom.operators import flow as W
from tickloom.operators import report as P
from tickloom.operators import selection as U
from tickloom.operators import timing as M
from tickloom.plans.audit_queries import audits
from tickloom.plans.common import r6
from tickloom.plans.evidence_queries import THEMES, _any
from tickloom.plans.oracle_base import cte
from tickloom.plans.registry import query
from tickloom.plans.screen_queries import screened, signals_last
from tickloom.sources import adapters as A
from tickloom.sources.workspace import saved

# a status and a capital signal for each theme of the fixed list
_THEME_ROWS = [("industry three", "confirmed", True), ("policy", "weak", False)]


def _universe(spark, sf_dir):
    c = F.col
    u = screened(spark, sf_dir).join(W.hit_counts(A.top_list(spark, sf_dir)), "ts_code", "left")
    score = S.pre_audit(c("fundamental_quality_score"), c("valuation_quality_score"), c("consolidation_score"), c("squeeze_readiness"), F.coalesce("toplist_recency_score", F.lit(0.0)))
    return u.select("ts_code", "composite_score", "consolidation_score", "volume_boost", F.round(score, 6).alias("pre_audit"))


def _matched(spark, sf_dir):
    b = A.stock_basic(spark, sf_dir).select("ts_code", F.concat_ws(" ", "industry", "name").alias("t"))
    return V.theme_matches(b, "t", THEMES, ["ts_code"])


cte("themed", ("stock_basic",), f"""
  SELECT ts_code, list_filter([{', '.join(f"CASE WHEN {_any(n, 't')} THEN '{n}' END" for n in THEMES)}], lambda x: x IS NOT NULL)[1:2] AS themes FROM (SELECT ts_code, industry||' '||name AS t FROM stock_basic)""")
cte("strong", ("themed",), """
  SELECT ts_code, max(CASE theme WHEN 'industry three' THEN 1.05 WHEN 'policy' THEN 0.4 ELSE 0.5 END)::DOUBLE AS strength FROM (SELECT ts_code, unnest(themes) AS theme FROM themed) GROUP BY 1""")
cte("pre", ("scr", "top_list"), """
  SELECT ts_code, composite_score, consolidation_score, volume_boost, round(0.35*fundamental_quality_score+0.15*valuation_quality_score+0.35*consolidation_score+0.15*squeeze_readiness-0.05*least(1.0,coalesce(h,0)/5.0),6) AS pre_audit
  FROM scr LEFT JOIN (SELECT ts_code AS hc, count(*) AS h FROM top_list GROUP BY 1) ON hc=ts_code""")


@query("theme_list_strength", "A-34", ("strong",), "SELECT ts_code, strength AS theme_strength_score FROM strong")
def theme_list_strength(spark, sf_dir):
    themes = spark.createDataFrame(_THEME_ROWS, "theme string, status string, capital_signal boolean")
    return U.list_strength(_matched(spark, sf_dir).where(F.size("matched_themes") > 0), themes)


cte("dual", ("pre", "strong"), """
  SELECT ts_code, list_type, pre_audit, strength AS theme_strength_score, CAST(row_number() OVER (ORDER BY list_type='technical', pre_audit DESC, ts_code) AS INTEGER) AS position
  FROM (
    WITH th AS (SELECT * FROM pre JOIN strong USING (ts_code) QUALIFY row_number() OVER (ORDER BY pre_audit DESC, ts_code)<=30),
    pool AS (SELECT ts_code FROM pre WHERE consolidation_score>=20 QUALIFY row_number() OVER (ORDER BY pre_audit DESC, ts_code)<=20)
    SELECT ts_code, pre_audit, strength, 'both' AS list_type FROM th WHERE ts_code IN (SELECT ts_code FROM th INTERSECT SELECT ts_code FROM pool)
    UNION ALL SELECT ts_code, pre_audit, strength, 'theme_driven' FROM th WHERE ts_code IN (SELECT ts_code FROM th EXCEPT SELECT ts_code FROM pool)
    UNION ALL SELECT ts_code, pre_audit, 0.0, 'technical' FROM (
      SELECT * FROM pre WHERE consolidation_score>=20 AND ts_code NOT IN (SELECT ts_code FROM th) QUALIFY row_number() OVER (ORDER BY pre_audit DESC, ts_code)<=20))""")


@query("dual_list", "K-2 K-4 U-1 U-2 U-3 J-5", ("dual",), "SELECT ts_code, list_type, round(pre_audit,4) AS pre_audit, theme_strength_score, position FROM dual")
def dual_list(spark, sf_dir):
    themes = spark.createDataFrame(_THEME_ROWS, "theme string, status string, capital_signal boolean")
    out = U.dual_list(_universe(spark, sf_dir), _matched(spark, sf_dir), themes, 2)
    return out.select("ts_code", "list_type", r6("pre_audit", 4), "theme_strength_score", "position")


_CONF = """greatest(0,least(1,CASE verdict WHEN 'pass' THEN least(1,c+0.2) WHEN 'fail' THEN greatest(0,c-0.3) ELSE c END+(bq-50)/250))"""
cte("conf", ("aud", "find"), f"""
  SELECT doc_id, ts_code, verdict, {_CONF} AS confidence FROM (
    SELECT aud.*, coalesce(0.3+0.5*m,0.5) AS c FROM aud LEFT JOIN (SELECT doc_id AS fd, avg(round((tier+least(1.0,k*0.3))/2::DOUBLE,2)) AS m FROM find GROUP BY 1) ON fd=doc_id)""")


def _confident(spark, sf_dir):
    return U.audit_confidence(audits(spark, sf_dir), V.positive_findings(A.search_hits(spark, sf_dir)))


@query("audit_confidence", "A-25", ("conf",), "SELECT doc_id, ts_code, verdict, round(confidence,6) AS confidence FROM conf")
def audit_confidence(spark, sf_dir):
    return _confident(spark, sf_dir).select("doc_id", "ts_code", "verdict", r6("confidence"))


@query("mean_audit_confidence", "A-26", ("conf",), "SELECT ts_code, round(avg(confidence),6) AS confidence, count(*) AS audits FROM conf GROUP BY 1")
def mean_audit_confidence(spark, sf_dir):
    return _confident(spark, sf_dir).groupBy("ts_code").agg(F.round(F.avg("confidence"), 6).alias("confidence"), F.count(F.lit(1)).alias("audits"))


@query("growth_catalysts", "A-24", ("find", "hits"), """
  SELECT ts_code, category, round(avg(confidence),6) AS confidence, arg_min(told, doc_id) AS description,
    CASE WHEN bool_or(regexp_matches(told,'近期|已')) THEN 'near_term' WHEN bool_or(regexp_matches(told,'规划|计划')) THEN 'long_term' ELSE 'medium_term' END AS timeframe
  FROM (SELECT f.ts_code, f.doc_id, category, round((tier+least(1.0,k*0.3))/2::DOUBLE,2) AS confidence, ['近期 ','规划 ',''][CAST(f.doc_id%3 AS INTEGER)+1]||title AS told
        FROM find f JOIN (SELECT doc_id, title FROM hits) h ON h.doc_id=f.doc_id) GROUP BY 1, 2""")
def growth_catalysts(spark, sf_dir):
    h = A.search_hits(spark, sf_dir)
    when = F.get(F.array(F.lit("近期 "), F.lit("规划 "), F.lit("")), (F.col("doc_id") % 3).cast("int"))  # the given titles tell no time
    told = h.select("doc_id", F.concat(when, F.col("title")).alias("description"))
    found = V.positive_findings(h).select("ts_code", "doc_id", "category", "confidence")
    return U.catalysts(found.join(told, "doc_id")).withColumn("confidence", F.round("confidence", 6))


def _round_sql(r: int, audited: str) -> str:
    """Theme and technical lists of one round; names are named where their number divides by 9."""
    boost, limit, floor, cap = U.RELAXATION[r]
    return f"""
  left{r} AS (SELECT * FROM pre WHERE ts_code NOT IN ({audited})),
  pool{r} AS (SELECT ts_code FROM (SELECT * FROM left{r} WHERE volume_boost>={boost} QUALIFY row_number() OVER (ORDER BY consolidation_score DESC, ts_code)<={limit}) UNION SELECT ts_code FROM stock_basic JOIN pre USING (ts_code) WHERE k%9=0),
  th{r} AS (SELECT pre.*, strength FROM pre JOIN strong USING (ts_code) WHERE ts_code IN (SELECT ts_code FROM pool{r}) QUALIFY row_number() OVER (ORDER BY pre_audit DESC, ts_code)<=30),
  te{r} AS (SELECT * FROM left{r} WHERE consolidation_score>={floor} AND ts_code NOT IN (SELECT ts_code FROM th{r}) QUALIFY row_number() OVER (ORDER BY pre_audit DESC, ts_code)<={cap}),
  all{r} AS (SELECT ts_code, 'theme_driven' AS list_type, 'theme_driven' AS filter_tier, strength, {r} AS round FROM th{r}
    UNION ALL SELECT ts_code, 'technical', CASE WHEN (SELECT count(*) FROM th{r})>0 THEN 'technical' ELSE 'OFF_THEME_FALLBACK' END, 0.0, {r} FROM te{r})"""


_PASSING = "SELECT ts_code FROM stock_basic WHERE k%20=1"


@query("refill_rounds", "P-8 P-16 U-1 U-3 K-1", ("pre", "strong", "stock_basic"), f"""
  WITH {_round_sql(0, "SELECT '' WHERE false")},
  sum0 AS (SELECT * FROM all0), {_round_sql(1, "SELECT ts_code FROM sum0")},
  sum1 AS (SELECT * FROM sum0 UNION ALL SELECT * FROM all1 WHERE (SELECT count(*) FROM sum0 WHERE ts_code IN ({_PASSING}))<5), {_round_sql(2, "SELECT ts_code FROM sum1")},
  sum2 AS (SELECT * FROM sum1 UNION ALL SELECT * FROM all2 WHERE (SELECT count(*) FROM sum1 WHERE ts_code IN ({_PASSING}))<5 AND (SELECT max(round) FROM sum1)=1)
  SELECT round, ts_code, list_type, filter_tier, strength::DOUBLE AS theme_strength_score FROM sum2""")
def refill_rounds(spark, sf_dir):
    themes = spark.createDataFrame(_THEME_ROWS, "theme string, status string, capital_signal boolean")
    b = A.stock_basic(spark, sf_dir).select("ts_code", "instrument_key")
    universe = saved(_universe(spark, sf_dir), "universe")
    out = U.refilled(universe, _matched(spark, sf_dir), b.where("instrument_key % 9 = 0"), themes, b.where("instrument_key % 20 = 1"))
    return out.select("round", "ts_code", "list_type", "filter_tier", "theme_strength_score")


# report tables: the dual list with its names, themes, valuation, place in the box and audits
cte("cand", ("dual", "scr", "themed", "siglast", "conf", "top_list"), """
  SELECT d.*, s.name, s.valuation_label, s.fundamental_quality_score, s.consolidation_score, s.volume_boost, t.themes, g.close_position, c.confidence, least(1.0,coalesce(h,0)/5.0) AS recency
  FROM dual d JOIN scr s ON s.ts_code=d.ts_code LEFT JOIN themed t ON t.ts_code=d.ts_code LEFT JOIN siglast g ON g.ts_code=d.ts_code
    LEFT JOIN (SELECT ts_code, avg(confidence) AS confidence FROM conf GROUP BY 1) c ON c.ts_code=d.ts_code LEFT JOIN (SELECT ts_code AS hc, count(*) AS h FROM top_list GROUP BY 1) ON hc=d.ts_code""")


def _candidates(spark, sf_dir):
    themes = spark.createDataFrame(_THEME_ROWS, "theme string, status string, capital_signal boolean")
    c = F.col
    screen = saved(screened(spark, sf_dir).join(W.hit_counts(A.top_list(spark, sf_dir)), "ts_code", "left").withColumn("toplist_recency_score", F.coalesce("toplist_recency_score", F.lit(0.0))), "screen")
    score = S.pre_audit(c("fundamental_quality_score"), c("valuation_quality_score"), c("consolidation_score"), c("squeeze_readiness"), c("toplist_recency_score"))
    universe = screen.select("ts_code", "composite_score", "consolidation_score", "volume_boost", F.round(score, 6).alias("pre_audit"))
    matched = _matched(spark, sf_dir).select("ts_code", "matched_themes")
    dual = U.dual_list(universe, matched, themes, 2).select("ts_code", "list_type", F.col("pre_audit").alias("alpha_rank_score"), "theme_strength_score", "position")
    more = screen.select("ts_code", "name", "valuation_label", "fundamental_quality_score", "consolidation_score", "volume_boost", "toplist_recency_score")
    sure = _confident(spark, sf_dir).groupBy("ts_code").agg(F.avg("confidence").alias("confidence"))
    place = signals_last(spark, sf_dir).select("ts_code", "close_position")
    return saved(dual.join(more, "ts_code").join(matched, "ts_code", "left").join(place, "ts_code", "left").join(sure, "ts_code", "left"), "candidates")


_TOLD = "coalesce(nullif(array_to_string(themes[1:2], ', '),''),'{}')"


@query("report_tables_of_names", "K-6 P-16", ("cand",), f"""
  SELECT 'theme' AS kind, position, name||'('||ts_code||')' AS stock, {_TOLD.format('待确认')} AS themes, valuation_label AS valuation,
    printf('%.2f',theme_strength_score)||' '||printf('%.1f',fundamental_quality_score)||' '||printf('%.1f',pre_audit) AS told FROM (SELECT * FROM cand WHERE list_type<>'technical' ORDER BY position LIMIT 5)
  UNION ALL SELECT 'core', position, name||'('||ts_code||')', {_TOLD.format('技术形态入选')}, valuation_label,
    CASE WHEN close_position IS NULL THEN '—' ELSE printf('%.0f',close_position*100)||'%分位' END||' 横盘分'||printf('%.0f',consolidation_score)||'，量能'||printf('%.2f',volume_boost)||' '||printf('%.2f',coalesce(confidence,0.5))
      ||' alpha评分'||printf('%.1f',pre_audit)||'；拥挤度'||printf('%.2f',recency) FROM (SELECT * FROM cand WHERE list_type<>'theme_driven' ORDER BY position LIMIT 10)
  UNION ALL SELECT 'order', CAST(row_number() OVER (ORDER BY coalesce(close_position,0.5), position) AS INTEGER), ts_code, '', '', '' FROM cand""")
def report_tables_of_names(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    theme = P.theme_table(c).select(F.lit("theme").alias("kind"), "position", "stock", "themes", "valuation", F.concat_ws(" ", "strength", "quality", "alpha").alias("told"))
    core = P.core_table(c, 10).select(F.lit("core"), "position", "stock", "themes", "valuation", F.concat_ws(" ", "box", "shape", "confidence", "reason"))
    w = Window.orderBy(F.coalesce("close_position", F.lit(0.5)), "position")  # two capped lists
    order = P.report_order(c).select(F.lit("order"), F.row_number().over(w), "ts_code", *[F.lit("")] * 3)
    return theme.union(core).union(order)


@query("signals_overlay", "J-21", ("siglast", "scr", "tm"), """
  SELECT ts_code, round(adx,6) AS adx, ma_trend, round(consolidation_score,4) AS consolidation_score,
    CASE WHEN ma_trend='bearish' AND pos<0.5 AND adx_>25 THEN 'downtrend' WHEN pos<0.2 AND (ma_trend='bearish' OR obv_divergence) THEN 'bottom_fishing' WHEN pos>0.85 AND ignition AND dt<0.05 THEN 'breakout_zone'
      WHEN pos>0.8 AND adx_>30 AND adx_slope>0 THEN 'breakout_zone' WHEN ma_trend='bullish' AND adx_>30 AND bos_20d THEN 'uptrend' WHEN ma_trend='bullish' AND adx_>22 THEN 'uptrend' ELSE 'range' END AS market_regime
  FROM (SELECT *, coalesce(nullif(adx,0),20) AS adx_, coalesce(nullif(close_position,0),0.5) AS pos, coalesce(nullif(dist_to_box_top,0),0.10) AS dt FROM (
    SELECT s.* REPLACE (coalesce(c.adx*1.5,s.adx) AS adx, coalesce(CASE WHEN c.k%2=0 THEN 'bullish' END,s.ma_trend) AS ma_trend), c.consolidation_score FROM siglast s JOIN tm USING (ts_code) LEFT JOIN scr c ON c.ts_code=s.ts_code))""")
def signals_overlay(spark, sf_dir):
    """Candidates with a changed ADX, and a trend for every second one, laid over the signals; the regime is judged after."""
    trend = F.when(F.col("instrument_key") % 2 == 0, "bullish")
    c = screened(spark, sf_dir).select("ts_code", (F.col("adx") * 1.5).alias("adx"), trend.alias("ma_trend"), "consolidation_score")
    t = M.latest_timing(A.bars(spark, sf_dir)).select("ts_code", "timing_bos", "timing_score")
    out = U.add_regime(P.overlay(signals_last(spark, sf_dir), c).join(t, "ts_code"))
    return out.select("ts_code", r6("adx"), "ma_trend", r6("consolidation_score", 4), "market_regime")
