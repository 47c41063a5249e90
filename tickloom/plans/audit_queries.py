"""Audit, recommendation, theme-status and report-field queries."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import functions as F

from tickloom.functions import labels_text as P
from tickloom.functions import scores as S
from tickloom.functions import text as X
from tickloom.operators import evidence as V
from tickloom.operators import flow as W
from tickloom.operators import screen as C
from tickloom.operators import selection as U
from tickloom.operators.ranking import top_n
from tickloom.operators.timeseries import by_date, is_last
from tickloom.plans.common import flag, r6, rounded, sql_round
from tickloom.plans.evidence_queries import AS_OF
from tickloom.plans.flow_queries import regimes
from tickloom.plans.oracle_base import cte
from tickloom.plans.registry import query
from tickloom.plans.screen_queries import indicators, quality, signals_last
from tickloom.sources import adapters as A
from tickloom.sources.workspace import saved

_CATS = list(X.FINDING_WORDS)


def audits(spark, sf_dir):
    """One audit per document: verdict from the veto rules, findings by category, its link as source.

    The texts are searched once, for words and not for patterns, and the audits, which hold no text, are written for all that reads them."""
    h = V.hard_veto(A.search_hits(spark, sf_dir), AS_OF, 60, 0.03)
    words = F.filter(F.array(*[F.when(reduce(or_, map(F.col("_told").contains, w)), k) for k, w in X.FINDING_WORDS.items()]), lambda k: k.isNotNull())
    hit = F.when(F.col("_told").contains(F.col("name")), words).otherwise(F.array().cast("array<string>"))
    h = h.withColumn("_told", F.concat_ws(" ", "title", "snippet")).select(
        "doc_id", "ts_code", "lang", "url", "veto", hit.alias("hit"), (F.length("snippet") % 101).cast("double").alias("business_quality_score"))
    return saved(h.select("doc_id", "ts_code", F.col("lang").alias("theme"), F.col("hit").alias("findings"), F.col("hit").alias("catalysts"), F.array("url").alias("sources"),
                          F.when(F.col("veto").isNotNull(), "fail").when(F.size("hit") > 0, "pass").otherwise("warn").alias("verdict"),
                          "business_quality_score", (F.col("doc_id") % 13).alias("quarters")), "audits")


_fk = ", ".join(f"CASE WHEN regexp_matches(t,'{'|'.join(w)}') AND contains(t,name) THEN '{k}' END" for k, w in X.FINDING_WORDS.items())
_tier = "CASE " + " ".join(f"WHEN contains(url,'{d}') THEN {w}" for d, w in X.SOURCE_TIERS) + " ELSE 0.6 END"
cte("aud", ("hits", "veto"), f"""
  SELECT *, CASE WHEN veto IS NOT NULL THEN 'fail' WHEN len(f)>0 THEN 'pass' ELSE 'warn' END AS verdict FROM (
    SELECT doc_id, ts_code, lang AS theme, veto, url, {_tier} AS tier, list_filter([{_fk}], lambda x: x IS NOT NULL) AS f, CAST(length(snippet)%101 AS DOUBLE) AS bq, doc_id%13 AS quarters
    FROM (SELECT h.*, h.title||' '||h.snippet AS t, v.veto FROM hits h LEFT JOIN (SELECT doc_id AS vd, veto FROM veto) v ON vd=h.doc_id))""")


@query("audit_features", "A-22", ("aud",), """
  SELECT ts_code, max(CASE verdict WHEN 'fail' THEN 0.95 WHEN 'pass' THEN 0.1 ELSE 0.45 END)::DOUBLE AS audit_risk_score, CAST(sum(len(f)) AS BIGINT) AS positive_finding_count,
    len(list_distinct(flatten(array_agg(f)))) AS catalyst_diversity, round(avg(tier),6) AS source_quality_score, round(avg(coalesce(nullif(bq,0),50)),6) AS business_quality_score FROM aud GROUP BY 1""")
def audit_features(spark, sf_dir):
    f = U.audit_features(audits(spark, sf_dir), X.source_tier)
    return f.select("ts_code", "audit_risk_score", "positive_finding_count", "catalyst_diversity", *rounded(["source_quality_score", "business_quality_score"]))


@query("audit_verdicts", "P-12", ("aud", "stock_basic"), """
  SELECT ts_code, coalesce(['pass','warn','fail'][m+1],'warn') AS worst_verdict FROM stock_basic LEFT JOIN (
    SELECT ts_code, max(CASE verdict WHEN 'fail' THEN 2 WHEN 'pass' THEN 0 ELSE 1 END) AS m FROM aud GROUP BY 1) USING (ts_code)""")
def audit_verdicts(spark, sf_dir):
    return U.worst_verdict(A.stock_basic(spark, sf_dir).select("ts_code"), audits(spark, sf_dir)).select("ts_code", "worst_verdict")


_PASSED = "SELECT ts_code FROM stock_basic WHERE ts_code IN (SELECT ts_code FROM aud GROUP BY 1 HAVING bool_and(verdict='pass'))"


@query("audit_gate", "P-12", ("aud", "stock_basic"), f"SELECT ts_code, 'pass' AS worst_verdict FROM ({_PASSED})")
def audit_gate(spark, sf_dir):
    kept, _ = U.passed_audit(A.stock_basic(spark, sf_dir).select("ts_code"), audits(spark, sf_dir))
    return kept.select("ts_code", "worst_verdict")


@query("audits_behind_gate", "P-12", ("aud", "stock_basic"), f"SELECT ts_code, doc_id, verdict FROM aud WHERE ts_code IN ({_PASSED})")
def audits_behind_gate(spark, sf_dir):
    _, kept = U.passed_audit(A.stock_basic(spark, sf_dir).select("ts_code"), audits(spark, sf_dir))
    return kept.select("ts_code", "doc_id", "verdict")


@query("business_quality_rollup", "A-23", ("aud",), """
  SELECT ts_code, doc_id, quarters, bq AS business_quality_score, CASE WHEN bq>=65 THEN '改善' WHEN bq<40 THEN '承压' ELSE '平稳' END AS label
  FROM aud QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY quarters DESC, bq DESC, doc_id)=1""")
def business_quality_rollup(spark, sf_dir):
    best = top_n(audits(spark, sf_dir).select("ts_code", "doc_id", "quarters", "business_quality_score"), ["ts_code"], 1,
                 F.desc("quarters"), F.desc("business_quality_score"), F.col("doc_id"))
    return best.withColumn("label", P.quality_label(F.col("business_quality_score")))


@query("audit_facts", "T-15", ("aud",), """
  SELECT ts_code, doc_id, verdict FROM aud WHERE len(f)>0 OR verdict='fail' QUALIFY row_number() OVER (PARTITION BY ts_code, verdict ORDER BY len(f) DESC, doc_id)<=12""")
def audit_facts(spark, sf_dir):
    a = audits(spark, sf_dir).where((F.size("findings") > 0) | (F.col("verdict") == "fail")).select("ts_code", "doc_id", "verdict", F.size("findings").alias("n"))
    return top_n(a, ["ts_code", "verdict"], 12, F.desc("n"), F.col("doc_id")).select("ts_code", "doc_id", "verdict")


@query("recommendation", "F-15", ("reg", "aud", "quality"), """
  SELECT ts_code, CASE WHEN coalesce(m,1)=2 THEN 'avoid' WHEN pe IS NULL AND q<45 THEN 'avoid' WHEN market_regime IN ('breakout_zone','downtrend','bottom_fishing') THEN 'watch'
    WHEN pos<=0.3 AND q>=50 AND k>=50 THEN 'strong_buy' WHEN pos<=0.5 AND q>=45 AND k>=40 THEN 'buy' ELSE 'watch' END AS recommendation
  FROM (SELECT r.ts_code, pe, market_regime, pos, coalesce(nullif(fundamental_quality_score,0),50) AS q,
      floor(least(100, greatest(0,1-volatility/0.5)*40+greatest(0,1-coalesce(ma_spread,0)/0.15)*25+greatest(0,1-coalesce(ma_spread_std,0)/0.03)*5+greatest(0,1-abs(price_position-0.5)/0.2)*20+greatest(0,(volume_boost-1)/0.5)*10)) AS k0,
      coalesce(nullif(k0,0),50) AS k, m
    FROM reg r JOIN quality f ON f.ts_code=r.ts_code LEFT JOIN (SELECT ts_code AS ac, max(CASE verdict WHEN 'fail' THEN 2 WHEN 'pass' THEN 0 ELSE 1 END) AS m FROM aud GROUP BY 1) ON ac=r.ts_code)""")
def recommendation(spark, sf_dir):
    c = F.col
    z = F.lit(0.0)
    r = regimes(spark, sf_dir).withColumn("consolidation_score", S.consolidation(
        c("volatility"), F.coalesce("ma_spread", z), F.coalesce("ma_spread_std", z), c("price_position"), c("volume_boost")))
    # statement bullets carry no single-quarter profit crash here; the audits' bullets are empty
    q = quality(spark, sf_dir).select("ts_code", "fundamental_quality_score", F.array().cast("array<string>").alias("bullets"))
    j = U.worst_verdict(r.join(q, "ts_code"), audits(spark, sf_dir)).withColumn("days_since_spike", F.lit(None).cast("int"))
    return j.select("ts_code", U.recommendation().alias("recommendation"))


@query("position_fields", "F-16 F-17 F-18", ("siglast",), """
  SELECT ts_code, CASE WHEN close_position<0.3 THEN '低位' WHEN close_position<0.6 THEN '中位' WHEN close_position<0.8 THEN '中高位' ELSE '高位' END AS band,
    '箱体位置 '||printf('%.1f%%',close_position*100)||' | 振幅 '||printf('%.1f%%',volatility*100)||' | 距箱顶 '||printf('%.1f%%',dist_to_box_top*100) AS card,
    CASE WHEN close_position>0.7 THEN '【高位】'||ma_trend ELSE ma_trend END AS tagged FROM siglast""")
def position_fields(spark, sf_dir):
    c = F.col
    return signals_last(spark, sf_dir).select("ts_code", P.box_band(c("close_position")).alias("band"),
                                              P.position_card(c("close_position"), c("volatility"), c("dist_to_box_top")).alias("card"),
                                              P.tag_position(c("ma_trend"), c("close_position")).alias("tagged"))


# wordings as they come, each with the verdict that a reader gives it
_WORDINGS = [("Passed", "pass"), ("did not pass: FAIL", "fail"), ("Warning, pass with care", "warn"), ("存疑，通过", "warn"), ("审核通过", "pass"), ("否决", "fail"), ("谨慎", "warn"), ("unclear", "warn"), ("ok", "warn")]


@query("verdict_wording", "F-16", (), f"""
  SELECT event_id, [{', '.join(f"'{v}'" for _, v in _WORDINGS)}][CAST(event_id%{len(_WORDINGS)} AS INTEGER)+1] AS verdict FROM events""")
def verdict_wording(spark, sf_dir):
    words = F.array(*[F.concat(F.lit(w + " "), F.col("event_type")) for w, _ in _WORDINGS])
    return A.table(spark, sf_dir, "events").select("event_id", P.verdict(F.get(words, (F.col("event_id") % len(_WORDINGS)).cast("int"))).alias("verdict"))


# every word that spoils a name, tried on part names, beside names that are fine but for their length
_THEME = "substr(p_name,1,6)||['股票','辨识度','传统经济','蓝筹','龙虎榜','游资','机构','复盘','涨停','芯片','', '市场'][CAST(p_partkey%12 AS INTEGER)+1]||CASE WHEN p_partkey%5=0 THEN p_name ELSE '' END"


@query("actionable_theme_names", "F-27", (), f"""
  SELECT p_partkey, CAST(p_partkey%12>=9 AND length(trim(t)) BETWEEN 1 AND 12 AS INTEGER) AS actionable FROM (SELECT p_partkey, {_THEME} AS t FROM part)""")
def actionable_theme_names(spark, sf_dir):
    ends = F.array(*map(F.lit, ["股票", "辨识度", "传统经济", "蓝筹", "龙虎榜", "游资", "机构", "复盘", "涨停", "芯片", "", "市场"]))
    p = F.col("p_partkey")
    name = F.concat(F.substring("p_name", 1, 6), F.get(ends, (p % 12).cast("int")), F.when(p % 5 == 0, F.col("p_name")).otherwise(""))
    return A.table(spark, sf_dir, "part").select("p_partkey", P.actionable_theme(name).cast("int").alias("actionable"))


@query("finding_normaliser", "F-29", ("aud",), """
  SELECT doc_id, len(f) AS kept, round(0.5*len(f),2)::DOUBLE AS confidence, CAST((len(f)+1)//2 AS BIGINT) AS other,
    array_to_string([k || CASE WHEN (i-1)%3=0 THEN '' ELSE '2024' END FOR k, i IN f], '|') AS told FROM aud""")
def finding_normaliser(spark, sf_dir):
    a = audits(spark, sf_dir)
    raw = F.transform("findings", lambda k, i: F.struct(
        F.when(i % 2 == 0, F.lit(" ")).otherwise(k).alias("category"), F.concat(F.lit(" "), k).alias("description"), k.alias("evidence"),
        F.when(i % 3 == 0, F.lit("")).otherwise("2024").alias("date"), F.lit(None).cast("double").alias("confidence"), F.col("sources")[0].alias("source_url")))
    blank = F.array(F.struct(*[F.lit(None).cast("string").alias(x) for x in ("category", "description", "evidence", "date")], F.lit(None).cast("double").alias("confidence"), F.lit("").alias("source_url")))
    raw = F.concat(raw, blank)  # a finding without a description goes
    empty = F.array().cast("array<struct<category:string,description:string,evidence:string,date:string,confidence:double,source_url:string>>")
    n = a.select("doc_id", P.normalise_findings(raw, [d for d, _ in X.SOURCE_TIERS], empty).alias("n"))
    told = F.array_join(F.transform("n", lambda x: F.concat(x["evidence"], F.coalesce(x["date"], F.lit("")))), "|")
    return n.select("doc_id", F.size("n").cast("long").alias("kept"), F.round(F.aggregate("n", F.lit(0.0), lambda s, x: s + x["confidence"]), 2).alias("confidence"),
                    F.size(F.filter("n", lambda x: x["category"] == "other")).cast("long").alias("other"), told.alias("told"))


@query("search_payload_hits", "T-1", (), "SELECT page_id, url, url AS title FROM pages")
def search_payload_hits(spark, sf_dir):
    u = F.col("url")
    body = F.to_json(F.struct(F.array(F.struct(u.alias("title"), u.alias("url")), F.struct(F.lit("again").alias("title"), u.alias("url"))).alias("results")))
    p = A.table(spark, sf_dir, "pages").select("page_id", body.alias("body"))
    return V.flatten_hits(p, "body", ["page_id"]).select("page_id", "url", "title")


# theme priorities by validation status, best first
_STATUS = ["confirmed", "web_only", "capital_only", "weak"]


@query("primary_themes", "P-15 P-16", ("tl", "stock_basic"), """
  WITH s AS (SELECT i.industry AS name, CASE WHEN net>0 THEN 'confirmed' WHEN net IS NULL THEN 'web_only' ELSE 'weak' END AS st FROM (SELECT DISTINCT industry FROM stock_basic) i
    LEFT JOIN (SELECT industry, sum(net_amount) AS net FROM tl GROUP BY 1) USING (industry))
  SELECT name, CASE WHEN st='confirmed' THEN 'primary' ELSE 'expanded' END AS tier FROM s WHERE st='confirmed' OR st='web_only'""")
def primary_themes(spark, sf_dir):
    basic = A.stock_basic(spark, sf_dir)
    net = A.top_list(spark, sf_dir).join(basic.select("ts_code", "industry"), "ts_code").groupBy("industry").agg(F.sum("net_amount").alias("net"))
    s = basic.select("industry").distinct().join(net, "industry", "left").select(
        F.col("industry").alias("name"), F.when(F.col("net") > 0, 0).when(F.col("net").isNull(), 1).otherwise(3).alias("p"))
    best = s.agg(F.min("p").alias("best"))
    j = s.crossJoin(best)  # one row
    return j.select("name", F.when(F.col("p") == F.col("best"), "primary").when(F.col("p") <= 2, "expanded").alias("tier")).where("tier is not null")


# a universe from before the valuation columns: stretch and label for some names only
_LEGACY = ["round(100*close_position,6) AS valuation_stretch_score", "CASE WHEN k%4=0 THEN NULL WHEN k%4=1 THEN ' ' ELSE '适中溢价' END AS valuation_label"]


@query("valuation_defaults", "P-10", ("siglast",), f"""
  SELECT ts_code, 50.0::DOUBLE AS valuation_quality_score, valuation_stretch_score, CASE WHEN trim(coalesce(valuation_label,''))<>'' THEN valuation_label WHEN valuation_stretch_score IS NULL THEN '估值待补充'
      WHEN valuation_stretch_score>=85 THEN '显著高估' WHEN valuation_stretch_score>=65 THEN '偏贵' WHEN valuation_stretch_score>=40 THEN '适中溢价' ELSE '合理' END AS valuation_label,
    0 AS valuation_outlier, NULL::DOUBLE AS pe_percentile_industry, NULL::DOUBLE AS pb_percentile_industry, NULL::DOUBLE AS ps_ttm_percentile_industry
  FROM (SELECT ts_code, {', '.join(_LEGACY)} FROM siglast)""")
def valuation_defaults(spark, sf_dir):
    legacy = signals_last(spark, sf_dir).withColumnRenamed("instrument_key", "k").selectExpr("ts_code", *_LEGACY)
    out = C.with_valuation_columns(legacy)
    return out.withColumn("valuation_outlier", F.col("valuation_outlier").cast("int"))


def filter_by(df, rules: dict):
    """Rows that satisfy a map of rules: name_max, name_min, or a list of allowed values."""
    for key, v in rules.items():
        if key.endswith("_max"):
            df = df.where(F.col(key[:-4]) <= v)
        elif key.endswith("_min"):
            df = df.where(F.col(key[:-4]) >= v)
        else:
            df = df.where(F.col(key).isin(v))
    return df


@query("candidate_screener", "P-13", ("siglast", "stock_basic"), """
  SELECT ts_code, round(pe,6) AS pe FROM siglast JOIN stock_basic USING (ts_code) WHERE pe<=20 AND volume_boost>=0.9 AND exchange IN ('SSE','SZSE')""")
def candidate_screener(spark, sf_dir):
    j = signals_last(spark, sf_dir).join(A.stock_basic(spark, sf_dir).select("ts_code", "exchange"), "ts_code")
    return filter_by(j, {"pe_max": 20, "volume_boost_min": 0.9, "exchange": ["SSE", "SZSE"]}).select("ts_code", r6("pe"))


_DIGITS = {"rsi14": 1, "adx": 1, "dist_ma20": 2, "dist_ma60": 2, "atr_pct": 2, "bbw": 2}


@query("factor_card", "A-33", ("sig",), f"""
  SELECT ts_code, horizon, round(arg_max(r, k) FILTER (k<=horizon),2) AS ret, {', '.join(f'round(max(CASE WHEN k=1 THEN {n} END),{d}) AS {n}' for n, d in _DIGITS.items())}
  FROM (SELECT ts_code, {{'v': return_5d}} AS rs, return_5d AS r, rsi14, adx, close/sma20-1 AS dist_ma20, close/sma60-1 AS dist_ma60, atr14/close AS atr_pct, bb_width AS bbw,
      row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) AS k FROM sig), (VALUES (5),(20),(60),(120)) h(horizon)
  WHERE k<=120 GROUP BY ts_code, horizon""")
def factor_card(spark, sf_dir):
    return W.factor_cards(indicators(spark, sf_dir))


@query("evidence_gaps", "P-17", ("find", "stock_basic"), f"""
  SELECT ts_code, CASE WHEN coalesce(n,0)<2 THEN array_to_string(list_filter({list(X.FINDING_WORDS)!r}, lambda x: NOT list_contains(coalesce(c,[]), x)),'|') ELSE '' END AS gaps
  FROM stock_basic LEFT JOIN (SELECT ts_code, count(*) AS n, list(DISTINCT category) AS c FROM find GROUP BY 1) USING (ts_code)""")
def evidence_gaps(spark, sf_dir):
    """Categories that nothing was found for, of names with fewer than two findings."""
    per = V.positive_findings(A.search_hits(spark, sf_dir)).groupBy("ts_code").agg(F.count(F.lit(1)).alias("n"), F.collect_set("category").alias("c"))
    j = A.stock_basic(spark, sf_dir).select("ts_code").join(per, "ts_code", "left")
    left = F.array_except(F.array(*map(F.lit, X.FINDING_WORDS)), F.coalesce("c", F.array().cast("array<string>")))
    return j.select("ts_code", F.when(F.coalesce("n", F.lit(0)) < 2, F.array_join(left, "|")).otherwise("").alias("gaps"))


@query("movers", "K-7", ("siglast",), "SELECT ts_code, round(return_20d,6) AS return_20d FROM siglast ORDER BY siglast.return_20d DESC, ts_code LIMIT 10")
def movers(spark, sf_dir):
    return signals_last(spark, sf_dir).orderBy(F.desc("return_20d"), "ts_code").limit(10).select("ts_code", r6("return_20d"))
