"""Fundamental-quality queries; the checking SQL works on one row per quarter and metric."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import fundamentals as B
from tickloom.plans.common import rounded, sql_round
from tickloom.plans.oracle_base import cte
from tickloom.plans.registry import query
from tickloom.plans.screen_queries import quality
from tickloom.sources import adapters as A

cte("finq", ("financial",), "SELECT *, count(*) OVER (PARTITION BY ts_code) AS qn FROM (SELECT * FROM financial QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY end_date DESC)<=12)")
cte("finm", ("finq",), """
  SELECT *, CASE WHEN roe0=0 THEN ni/total_hldr_eqy*100 ELSE roe END AS roe_, CASE WHEN dr0=0 THEN total_liab/total_assets*100 ELSE debt_to_assets END AS dr_
  FROM (SELECT *, CASE WHEN count(revenue) OVER w>=2 THEN revenue WHEN count(total_revenue) OVER w>=2 THEN total_revenue END AS rev,
    CASE WHEN count(net_income) OVER w>=2 THEN net_income WHEN count(n_income) OVER w>=2 THEN n_income END AS ni,
    CASE WHEN count(roe) OVER w>=2 THEN 1 ELSE 0 END AS roe0, CASE WHEN count(debt_to_assets) OVER w>=2 THEN 1 ELSE 0 END AS dr0
    FROM finq WINDOW w AS (PARTITION BY ts_code))""")
_METRICS = {"revenue": "rev", "net_income": "ni", "gross_margin": "gross_margin", "op_cashflow": "n_cashflow_act", "roe": "roe_", "debt_ratio": "dr_",
            "current_ratio": "current_ratio", "total_assets": "total_assets", "operate_profit": "operate_profit", "eps": "eps", "or_yoy": "or_yoy",
            "op_yoy": "op_yoy", "profit_dedt": "profit_dedt", "money_cap": "money_cap", "accounts_receiv": "accounts_receiv", "opex": "oper_cost",
            "profit_to_debt": "profit_dedt/nullif(total_liab,0)*100", "cash_ratio": "n_cashflow_act/nullif(ni,0)",
            "accruals": "(ni-n_cashflow_act)/nullif(total_assets,0)", "op_ratio": "operate_profit/nullif(ni,0)", "dedt_ratio": "profit_dedt/nullif(ni,0)"}
cte("finl", ("finm",), " UNION ALL ".join(f"SELECT ts_code, end_date, '{m}' AS metric, {e} AS v FROM finm" for m, e in _METRICS.items()))
cte("fini", ("finl",), """
  SELECT *, row_number() OVER (PARTITION BY ts_code, metric ORDER BY end_date) AS i, count(*) OVER (PARTITION BY ts_code, metric) AS n FROM finl WHERE v IS NOT NULL""")
cte("finst", ("fini",), """
  SELECT ts_code, metric, n, CASE WHEN n>=2 THEN (re-pr)/greatest(abs(pr),abs(re),1e-9) END AS d, CASE WHEN n>=2 THEN a4 END AS a,
    CASE WHEN n>=4 THEN greatest(-0.5,least(2.0,exp(4*sl)-1)) END AS g, CASE WHEN n>=3 AND m<>0 THEN sd/abs(m) END AS cv,
    CASE WHEN n>=6 THEN (ll-lf)/greatest(abs(lf),1e-9)-(el-ef)/greatest(abs(ef),1e-9) END AS acc, n-coalesce(lastneg,0) AS run, s4, pos4, mx, posr, ll AS lastv
  FROM (SELECT ts_code, metric, any_value(n) AS n, avg(v) FILTER (i>n-greatest(2,n//2)) AS re, avg(v) FILTER (i<=greatest(2,n//2)) AS pr,
      avg(v) FILTER (i>n-4) AS a4, regr_slope(ln(greatest(v,1)),i) AS sl, stddev_samp(v) AS sd, avg(v) AS m, max(v) FILTER (i=1) AS ef, max(v) FILTER (i=n//2) AS el,
      max(v) FILTER (i=n//2+1) AS lf, max(v) FILTER (i=n) AS ll, max(i) FILTER (v<=0) AS lastneg, sum(v) FILTER (i>n-4) AS s4,
      bool_or(v>0) FILTER (i>n-4) AS pos4, max(v) AS mx, avg(CASE WHEN v>0 THEN 1.0 ELSE 0.0 END) AS posr FROM fini GROUP BY ts_code, metric)""")


def _p(metric, col, name):
    return f"max(CASE WHEN metric='{metric}' THEN {col} END) AS {name}"


_D = ("net_income", "op_cashflow", "gross_margin", "eps", "operate_profit", "roe", "money_cap", "accounts_receiv", "accruals", "opex")
_A = ("roe", "gross_margin", "op_yoy", "or_yoy", "debt_ratio", "current_ratio", "profit_to_debt", "op_cashflow", "cash_ratio", "accruals", "op_ratio", "dedt_ratio", "net_income")
_N = ("revenue", "net_income", "gross_margin", "op_cashflow", "roe", "debt_ratio", "current_ratio", "accounts_receiv", "operate_profit", "profit_dedt")
cte("fins", ("finst", "finq", "stock_basic"), f"""
  SELECT q.ts_code, qn AS quarter_count, industry, s.* EXCLUDE (ts_code) FROM (SELECT DISTINCT ts_code, qn FROM finq) q JOIN stock_basic b ON b.ts_code=q.ts_code
  JOIN (SELECT ts_code, {_p('revenue','g','cagr')}, {_p('revenue','acc','accel')}, {_p('revenue','cv','rev_vol')}, {_p('revenue','mx','rev_max')},
    coalesce(max(CASE WHEN metric='net_income' THEN run END),0) AS profit_age, {_p('net_income','s4','income4')}, bool_or(pos4) FILTER (metric='net_income') AS profitable,
    {', '.join(_p(m,'d','d_'+m) for m in _D)}, {', '.join(_p(m,'a','a_'+m) for m in _A)}, {', '.join(f"coalesce(max(CASE WHEN metric='{m}' THEN n END),0) AS n_{m}" for m in _N)},
    {_p('op_cashflow','posr','cash_positive')}, {_p('money_cap','lastv','last_cash')}, {_p('total_assets','lastv','last_assets')}, {_p('accruals','n','n_gap')}
    FROM finst GROUP BY ts_code) s ON s.ts_code=q.ts_code""")
cte("life0", ("fins",), """
  SELECT *, strong, ((coalesce(cagr>0.10 AND cagr<=0.25,false) OR wide) AND NOT shrink) AS is_exp, (early AND NOT shrink) AS is_early,
    (coalesce(cagr<-0.03,false) OR shrink) AS is_decl, (coalesce(cagr>0.25,false) OR strong) AS is_hyper,
    least(1.0, least(1.0,quarter_count/12.0)+CASE WHEN strong THEN 0.05 ELSE 0 END) AS conf0
  FROM (SELECT *, coalesce(a_or_yoy < -5,false) AND (coalesce(cagr>0.10 AND cagr<=0.25,false) OR wide OR early) AS shrink
   FROM (SELECT *, coalesce(a_or_yoy>20,false) AND NOT strong AND NOT cow AND NOT steady AS wide
    FROM (SELECT *, coalesce(a_or_yoy>30,false) AND pre AS strong
     FROM (SELECT *, coalesce(cagr>0.05 AND profit_age<8,false) AS early, (NOT coalesce(profitable,false) OR coalesce(profit_age<4 AND income4<=0,false)) AS pre,
       coalesce(n_revenue>=3 AND rev_max<1e8,false) AS small, coalesce(cagr>0.03 AND cagr<=0.15 AND profit_age>=8,false) AS steady,
       coalesce(cagr<=0.05 AND profit_age>=4 AND profitable,false) AS cow, coalesce(rev_vol>0.30,false) AS volat FROM fins))))""")
cte("life", ("life0",), """
  SELECT *, split_part(br,'/',1) AS stage, split_part(br,'/',2) AS subflavor,
    CASE WHEN quarter_count<2 THEN 0 WHEN cagr IS NULL AND d_net_income IS NULL AND d_op_cashflow IS NULL THEN greatest(0.1,quarter_count/24.0)
      ELSE round(least(1.0,conf0+CASE br WHEN 'growth/hypergrowth' THEN 0.1 WHEN 'growth/pre_revenue' THEN 0.05 WHEN 'growth/expansion' THEN 0.05 WHEN 'mature/cash_cow' THEN 0.05 ELSE 0 END),2) END AS confidence
  FROM (SELECT *, CASE WHEN quarter_count<2 OR (cagr IS NULL AND d_net_income IS NULL AND d_op_cashflow IS NULL) THEN 'unknown/' WHEN is_hyper AND pre THEN 'growth/hypergrowth'
     WHEN small AND pre THEN 'growth/pre_revenue' WHEN (is_exp OR is_early) AND profit_age<8 THEN 'growth/expansion' WHEN cow THEN 'mature/cash_cow' WHEN steady THEN 'mature/steady'
     WHEN is_decl AND volat THEN 'cyclical/' WHEN is_decl THEN 'declining/' WHEN volat THEN 'cyclical/' ELSE 'transitional/' END AS br FROM life0)""")


def _chain(*steps):
    """Nested sub-selects, each naming the next score."""
    src = "life"
    for i, e in enumerate(steps):
        src = f"(SELECT *, {e} AS {{t}}{i + 1} FROM {src})"
    return src


def _cl(x, lo=0, hi=100):
    return f"greatest({lo},least({hi},{x}))"


def _bonus(t, expr, cond):
    return f"CASE WHEN {cond} IS NOT NULL THEN {_cl(f'{t}+({expr})')} ELSE {t} END"


_SCORES = {
    "pm": ["CASE WHEN a_roe IS NOT NULL THEN least(60,greatest(5,least(60,30+1.2*a_roe))+CASE WHEN d_roe>0 THEN 10 ELSE 0 END) END",
           "40/(1+exp(-(a_gross_margin-20)/5))", "CASE WHEN pm1 IS NOT NULL AND pm2 IS NOT NULL THEN 0.7*pm1+0.3*pm2 ELSE coalesce(pm1,pm2) END",
           _bonus("pm3", _cl("20*d_net_income", -10, 10), "d_net_income"), _bonus("pm4", _cl("50*a_op_yoy", -10, 10), "a_op_yoy"),
           _bonus("pm5", _cl("15*d_eps", -5, 8), "d_eps"), "CASE WHEN pm1 IS NULL AND pm2 IS NULL THEN 50 ELSE " + _cl("pm6") + " END"],
    "gm": ["CASE WHEN cagr>0.03 AND cagr<=0.15 THEN 50+200*cagr WHEN cagr>0.15 THEN 60 WHEN cagr>=0 THEN 50+100*cagr ELSE 50+150*cagr END", _cl("gm1", 10, 90),
           _bonus("gm2", "CASE WHEN a_or_yoy>15 THEN least(12,0.4*(a_or_yoy-15)) WHEN a_or_yoy>5 THEN 0 WHEN a_or_yoy>-5 THEN greatest(-8,a_or_yoy) ELSE greatest(-15,0.8*a_or_yoy) END", "a_or_yoy"),
           _bonus("gm3", _cl("15*accel", -8, 8), "accel"), _bonus("gm4", _cl("12*d_operate_profit", -6, 8), "d_operate_profit"),
           "CASE WHEN cagr IS NULL THEN 50 ELSE " + _cl("gm5") + " END"],
    "hm": ["CASE WHEN a_debt_ratio IS NULL THEN 50 ELSE 25+0.5*(CASE WHEN a_debt_ratio<20 THEN 40 WHEN a_debt_ratio<50 THEN 40-0.4*(a_debt_ratio-20) WHEN a_debt_ratio<70 THEN 28-(a_debt_ratio-50) ELSE greatest(0,8-0.3*(a_debt_ratio-70)) END) END",
           "CASE WHEN a_current_ratio IS NULL THEN hm1 ELSE 0.6*hm1+0.4*30*exp(-0.5*pow((a_current_ratio-2)/0.8,2)) END",
           "CASE WHEN n_op_cashflow>=3 THEN least(100,hm2+20*cash_positive) ELSE hm2 END",
           "CASE WHEN a_profit_to_debt IS NULL THEN hm3 ELSE least(100,hm3+CASE WHEN a_profit_to_debt>20 THEN 20 WHEN a_profit_to_debt>10 THEN 15+0.5*(a_profit_to_debt-10) WHEN a_profit_to_debt>2 THEN a_profit_to_debt ELSE greatest(0,0.5*a_profit_to_debt) END) END",
           "CASE WHEN d_money_cap>0.1 THEN least(100,hm4+5) WHEN d_money_cap<-0.15 THEN greatest(0,hm4-5) ELSE hm4 END",
           "CASE WHEN a_debt_ratio IS NULL AND a_current_ratio IS NULL AND n_op_cashflow<3 THEN 50 ELSE " + _cl("hm5") + " END"],
    "pg": ["50+CASE WHEN d_net_income>0 THEN least(15,30*d_net_income) ELSE 0 END+CASE WHEN d_gross_margin>0 THEN least(10,20*d_gross_margin) ELSE 0 END+CASE WHEN a_or_yoy>20 THEN least(12,0.3*(a_or_yoy-20)) WHEN a_or_yoy<0 THEN -least(10,0.2*abs(a_or_yoy)) ELSE 0 END",
           _cl("CASE WHEN subflavor='pre_revenue' THEN greatest(35,least(70,pg1)) ELSE pg1 END")],
    "gg": ["CASE WHEN subflavor='pre_revenue' THEN CASE WHEN cagr>0 THEN 50+least(40,100*cagr) ELSE 50 END WHEN subflavor='hypergrowth' THEN 50+least(45,120*cagr) ELSE 50+least(40,160*cagr) END", _cl("gg1", 20, 95),
           "CASE WHEN subflavor='hypergrowth' AND a_or_yoy>30 THEN least(100,gg2+10) WHEN a_or_yoy>15 THEN least(100,gg2+5) WHEN a_or_yoy<-10 THEN greatest(0,gg2-10) ELSE gg2 END",
           _bonus("gg3", "CASE WHEN accel>0 THEN greatest(-5,least(15,25*accel)) ELSE greatest(-10,20*accel) END", "accel"),
           "CASE WHEN subflavor='pre_revenue' AND d_opex>0.05 THEN least(100,gg4+8) WHEN subflavor='pre_revenue' AND d_opex<-0.05 THEN greatest(0,gg4-8) ELSE gg4 END",
           "CASE WHEN cagr IS NULL THEN 50 ELSE " + _cl("gg5") + " END"],
    "hg": ["coalesce(n_op_cashflow>=3 AND subflavor IN ('pre_revenue','hypergrowth') AND a_op_cashflow<0,false)",
           "hg1 AND coalesce(last_cash,last_assets*0.15,0)>0", "CASE WHEN hg2 THEN 25+0.5*least(40,coalesce(last_cash,last_assets*0.15,0)/greatest(abs(a_op_cashflow),1)/4*10) ELSE 50 END",
           "CASE WHEN hg1 AND d_op_cashflow>0 THEN least(100,hg3+12) WHEN hg1 AND d_op_cashflow<-0.1 THEN greatest(0,hg3-10) ELSE hg3 END",
           "CASE WHEN a_debt_ratio IS NULL THEN hg4 ELSE 0.6*hg4+0.4*(CASE WHEN a_debt_ratio<40 THEN 30 WHEN a_debt_ratio<60 THEN 20 ELSE greatest(0,20-0.5*(a_debt_ratio-60)) END) END",
           "CASE WHEN a_profit_to_debt>15 THEN least(100,hg5+8) WHEN a_profit_to_debt>5 THEN least(100,hg5+3) WHEN a_profit_to_debt<0 THEN greatest(0,hg5-8) ELSE hg5 END",
           "CASE WHEN NOT hg2 AND a_debt_ratio IS NULL THEN 50 ELSE " + _cl("hg6") + " END"],
    "eq": ["n_gap>=3 AND a_cash_ratio IS NOT NULL", "n_gap>=3 AND a_accruals IS NOT NULL",
           "CASE WHEN eq1 THEN 25+0.5*(CASE WHEN a_cash_ratio>1 THEN least(30,15+5*(a_cash_ratio-1)) WHEN a_cash_ratio>0.5 THEN 30*(a_cash_ratio-0.5) ELSE 0 END) ELSE 50 END",
           "CASE WHEN eq2 THEN least(100,eq3+CASE WHEN abs(a_accruals)<0.03 THEN 20 WHEN abs(a_accruals)<0.06 THEN 12 ELSE 5 END+CASE WHEN d_accruals<0 THEN 5 ELSE 0 END) ELSE eq3 END",
           "CASE WHEN n_accounts_receiv<3 THEN eq4 WHEN d_accounts_receiv>0.2 THEN greatest(0,eq4-10) WHEN d_accounts_receiv>0.1 THEN greatest(0,eq4-5) WHEN d_accounts_receiv<-0.05 THEN least(100,eq4+5) ELSE eq4 END",
           "CASE WHEN n_operate_profit<3 OR n_net_income<3 THEN eq5 WHEN a_op_ratio<0.5 THEN greatest(0,eq5-10) WHEN a_op_ratio>0.8 THEN least(100,eq5+5) ELSE eq5 END",
           "CASE WHEN n_profit_dedt<3 OR n_net_income<3 THEN eq6 WHEN a_dedt_ratio<0.5 THEN greatest(0,eq6-12) WHEN a_dedt_ratio<0.7 THEN greatest(0,eq6-6) WHEN a_dedt_ratio>0.9 THEN least(100,eq6+3) ELSE eq6 END",
           "CASE WHEN NOT eq1 AND NOT eq2 THEN 50 ELSE " + _cl("eq7") + " END"],
}
_src = "life"
for _tag, _steps in _SCORES.items():
    for _i, _e in enumerate(_steps):
        _src = f"(SELECT *, {_e} AS {_tag}{_i + 1} FROM {_src})"
cte("quality", ("life",), f"""
  SELECT *, round(raw,1) AS fundamental_quality_score, least(1.0,({'+'.join(f'(n_{m}>=2)::INT' for m in ('revenue','net_income','gross_margin','op_cashflow','roe','debt_ratio','current_ratio'))})/5.0) AS completeness,
    CASE WHEN stage='growth' AND subflavor='pre_revenue' THEN CASE WHEN raw>=55 THEN '早期成长' ELSE '早期关注' END
      WHEN stage='growth' THEN CASE WHEN raw>=65 THEN '高成长' WHEN raw>=40 THEN '成长关注' ELSE '成长风险' END
      WHEN stage='mature' THEN CASE WHEN raw>=70 THEN '优质' WHEN raw>=50 THEN '稳健' WHEN raw>=35 THEN '关注' ELSE '偏弱' END
      WHEN stage IN ('cyclical','declining') THEN CASE WHEN raw>=50 THEN '周期关注' ELSE '周期风险' END ELSE CASE WHEN raw>=40 THEN '中性' ELSE '待观察' END END AS label
  FROM (SELECT *, greatest(0,least(100,CASE WHEN stage='growth' THEN 0.05*profitability+0.5*growth_quality+0.3*financial_health+0.15*earnings_quality
      WHEN stage='mature' THEN 0.3*profitability+0.2*growth_quality+0.3*financial_health+0.2*earnings_quality
      WHEN stage IN ('cyclical','declining') THEN 0.15*profitability+0.15*growth_quality+0.4*financial_health+0.3*earnings_quality
      ELSE 0.25*profitability+0.25*growth_quality+0.25*financial_health+0.25*earnings_quality END)) AS raw
   FROM (SELECT *, round(CASE WHEN stage='growth' THEN pg2 ELSE pm7 END,1) AS profitability, round(CASE WHEN stage='growth' THEN gg6 ELSE gm6 END,1) AS growth_quality,
     round(CASE WHEN stage='growth' THEN hg7 ELSE hm6 END,1) AS financial_health, round(eq8,1) AS earnings_quality FROM {_src}))""")


def _stats(spark, sf_dir):
    m = B.quarter_arrays(B.recent_quarters(A.financial(spark, sf_dir)))
    return B.add_statistics(m.join(A.stock_basic(spark, sf_dir).select("ts_code", "industry"), "ts_code", "left"))


_TREND = ["cagr", "accel", "rev_vol", "d_net_income", "d_gross_margin", "d_op_cashflow", "a_or_yoy", "a_roe", "a_debt_ratio"]


@query("fundamental_statistics", "S-9 B-1 B-2 B-3 B-4 B-5 B-6", ("fins",), f"SELECT ts_code, profit_age, {sql_round(_TREND, 5)} FROM fins")
def fundamental_statistics(spark, sf_dir):
    return _stats(spark, sf_dir).select("ts_code", F.col("profit_age").cast("long").alias("profit_age"), *rounded(_TREND, 5))


@query("lifecycle_stage", "B-7 F-22", ("life",), "SELECT ts_code, stage, subflavor, round(confidence,2) AS confidence FROM life")
def lifecycle_stage(spark, sf_dir):
    return B.classify_lifecycle(_stats(spark, sf_dir)).select("ts_code", "stage", "subflavor", *rounded(["confidence"], 2))


_DIM = ["profitability", "growth_quality", "financial_health", "earnings_quality", "fundamental_quality_score"]


@query("fundamental_quality", "B-8 B-9 B-10 B-11 B-12 B-13", ("quality",), f"SELECT ts_code, stage, label, {', '.join(_DIM)}, round(completeness,2) AS data_completeness FROM quality")
def fundamental_quality(spark, sf_dir):
    return quality(spark, sf_dir).select("ts_code", "stage", "label", *_DIM, "data_completeness")


_SUM = {"growth": "成长期", "mature": "成熟期", "cyclical": "周期型", "declining": "下滑期", "transitional": "转型期", "unknown": "数据有限"}


@query("fundamental_summary_text", "B-14", ("quality",), f"""
  SELECT ts_code, '【'||CASE stage {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _SUM.items())} END||'】'||
    CASE WHEN a_or_yoy IS NOT NULL THEN printf('营收同比%+.1f%%',a_or_yoy) WHEN cagr IS NOT NULL THEN printf('营收CAGR %.1f%%',cagr*100) ELSE '营收趋势未知' END||'，'||
    CASE WHEN d_net_income>0 THEN '盈利改善' WHEN d_net_income<=0 THEN '盈利承压' ELSE '盈利趋势未知' END||'，'||
    CASE WHEN d_op_cashflow>0 THEN '现金流改善' WHEN d_op_cashflow<=0 THEN '现金流承压' ELSE '现金流趋势未知' END||printf('。综合质量得分%.0f/100。',raw) AS summary FROM quality""")
def fundamental_summary_text(spark, sf_dir):
    return quality(spark, sf_dir).select("ts_code", "summary")


_LOSING = "(stage='growth' AND NOT coalesce(a_net_income>0,false))"
_SWAY = "CASE WHEN {0}>{1} THEN '{2}' WHEN {0}<-{1} THEN '{3}' ELSE '{4}' END"
_BULLETS = ", ".join([
    "CASE WHEN cagr IS NOT NULL THEN '营收'||CASE WHEN cagr>0.15 THEN '快速增长' WHEN cagr>0.05 THEN '稳健增长' WHEN cagr>0 THEN '缓慢增长' ELSE '下滑' END||printf('（年化%.1f%%），基于%d个季度数据。',cagr*100,n_revenue) END",
    f"CASE WHEN d_net_income IS NULL THEN NULL WHEN {_LOSING} THEN CASE WHEN d_net_income>0 THEN '公司尚处投入期，但亏损幅度收窄，经营杠杆逐步显现。' ELSE '公司尚处投入期，盈利路径有待兑现，关注现金消耗节奏。' END "
    f"ELSE '净利润趋势'||{_SWAY.format('d_net_income', 0.05, '改善', '承压', '平稳')}||'。' END",
    f"CASE WHEN d_gross_margin IS NOT NULL THEN '毛利率'||{_SWAY.format('d_gross_margin', 0.03, '改善', '承压', '稳定')}||'，反映产品竞争力和成本控制能力。' END",
    f"CASE WHEN d_op_cashflow IS NOT NULL THEN '经营现金流'||{_SWAY.format('d_op_cashflow', 0.05, '改善', '走弱', '稳定')}||'。' END",
    "CASE WHEN a_debt_ratio>60 THEN printf('资产负债率偏高（%.0f%%），关注偿债压力。',a_debt_ratio) WHEN a_debt_ratio<30 THEN printf('资产负债率低（%.0f%%），财务结构稳健。',a_debt_ratio) END",
    "CASE WHEN a_or_yoy IS NOT NULL THEN '营收同比'||CASE WHEN a_or_yoy>20 THEN '高增长' WHEN a_or_yoy>10 THEN '稳健增长' WHEN a_or_yoy>0 THEN '低速增长' ELSE '下滑' END||printf('（近四季均值%.1f%%）。',a_or_yoy) END",
    "CASE WHEN a_op_yoy>0 THEN printf('营业利润同比增长%.1f%%，主业盈利改善。',a_op_yoy) WHEN a_op_yoy<-10 THEN printf('营业利润同比下滑%.1f%%，关注主业承压。',a_op_yoy) END",
    "CASE WHEN a_debt_ratio>40 AND a_profit_to_debt<3 THEN printf('利润对债务覆盖不足（利润/负债=%.1f%%），关注偿债能力。',a_profit_to_debt) END",
    "CASE WHEN stage='growth' AND subflavor='pre_revenue' THEN '企业处于早期成长阶段，评分侧重成长潜力和现金可持续性，不因当前未盈利而直接否定。' END",
    "CASE WHEN completeness<0.5 THEN printf('财务数据覆盖度有限（%.0f%%），部分指标基于有限样本估计。',completeness*100) END"])


@query("fundamental_bullets", "B-14", ("quality",), f"""
  SELECT ts_code, array_to_string(list_filter([{_BULLETS}], lambda x: x IS NOT NULL)[1:5], '|') AS bullets FROM quality""")
def fundamental_bullets(spark, sf_dir):
    return quality(spark, sf_dir).select("ts_code", F.array_join("bullets", "|").alias("bullets"))


@query("fundamental_quick_screen", "B-15", ("quality", "stock_basic"), """
  SELECT b.ts_code, coalesce(fundamental_quality_score,50) AS fundamental_quality_score, coalesce(stage,'unknown') AS lifecycle_stage
  FROM stock_basic b LEFT JOIN (SELECT * FROM quality WHERE quarter_count>=2) q ON q.ts_code=b.ts_code""")
def fundamental_quick_screen(spark, sf_dir):
    return B.quick_screen(A.stock_basic(spark, sf_dir).select("ts_code"), quality(spark, sf_dir))


@query("fundamental_source_preference", "B-16", ("financial",), """
  SELECT ts_code, source, round(v,4) AS eps FROM (
    SELECT ts_code, 'local' AS source, 0 AS p, arg_max(eps,end_date) AS v FROM financial WHERE revenue IS NOT NULL GROUP BY 1
    UNION ALL SELECT ts_code, 'vendor', 1, arg_max(eps,end_date) FROM financial WHERE net_income IS NOT NULL GROUP BY 1
    UNION ALL SELECT ts_code, 'web', 2, arg_max(eps,end_date) FROM financial GROUP BY 1) QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY p)=1""")
def fundamental_source_preference(spark, sf_dir):
    fin = A.financial(spark, sf_dir)
    last = lambda d: d.groupBy("ts_code").agg(F.max_by("eps", "end_date").alias("eps"))
    return B.prefer_source(last(fin.where("revenue is not null")), last(fin.where("net_income is not null")), last(fin), ["eps"]).select(
        "ts_code", "source", *rounded(["eps"], 4))
