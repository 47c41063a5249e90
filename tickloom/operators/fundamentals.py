"""Lifecycle stage and fundamental quality per instrument from its last quarters.

At most twelve quarters per instrument survive the reader, so they travel as one row
of short arrays; everything after that is column arithmetic without another shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tickloom.functions.scores import clamp, half_up, printed

QUARTERS = 12

# Metric names with the columns that may carry them, in order of preference.
ALIASES = {
    "revenue": ["revenue", "total_revenue", "total_operat_income", "operating_revenue", "operate_income"],
    "net_income": ["net_income", "n_income", "n_income_attr_p", "profit_to_gr", "netprofit"],
    "gross_margin": ["gross_margin", "grossprofit_margin", "gross_margin_rate", "gp_margin"],
    "op_cashflow": ["operate_cashflow", "n_cashflow_act", "net_cash_flows_oper_act", "oper_cash_flow"],
    "roe": ["roe", "roe_dt"],
    "debt_ratio": ["debt_to_assets"],
    "current_ratio": ["current_ratio"],
    "total_assets": ["total_assets"],
    "total_liab": ["total_liab", "total_liability"],
    "equity": ["total_hldr_eqy", "total_hldr_eqy_exc_min_int", "total_equity"],
    "operate_profit": ["operate_profit"],
    "ebit": ["ebit"], "eps": ["eps"], "bps": ["bps"], "or_yoy": ["or_yoy"], "op_yoy": ["op_yoy"],
    "profit_dedt": ["profit_dedt"], "money_cap": ["money_cap"], "accounts_receiv": ["accounts_receiv"],
    "opex": ["oper_cost", "total_cogs", "sell_exp"],
}
STAGE_WEIGHTS = {  # profitability, growth quality, financial health, earnings quality
    "growth": (0.05, 0.50, 0.30, 0.15), "mature": (0.30, 0.20, 0.30, 0.20),
    "cyclical": (0.15, 0.15, 0.40, 0.30), "declining": (0.15, 0.15, 0.40, 0.30), "other": (0.25, 0.25, 0.25, 0.25),
}
SECTOR_WORDS = [
    ("tech", ["电子", "计算机", "软件", "通信", "半导体", "芯片", "互联网", "人工智能"]),
    ("biotech", ["医药", "生物", "制药", "医疗", "疫苗", "基因"]),
    ("financial", ["银行", "保险", "证券", "金融", "信托"]),
    ("consumer", ["食品", "饮料", "白酒", "家电", "服装", "零售", "消费品"]),
    ("cyclical", ["钢铁", "煤炭", "有色", "化工", "石油", "水泥"]),
    ("defensive", ["电力", "水务", "燃气", "环保", "新能源"]),
    ("industrial", ["汽车", "机械", "军工", "航空", "船舶", "电气", "设备"]),
]
STAGE_NAMES = {"growth": "成长期", "mature": "成熟期", "cyclical": "周期型", "declining": "下滑期", "transitional": "转型期", "unknown": "数据有限"}


def sector_of(industry: Column) -> Column:
    """Sector bucket of an industry name; first matching word list wins."""
    out = None
    for sector, words in SECTOR_WORDS:
        hit = F.lower(industry).rlike("|".join(words))
        out = F.when(hit, sector) if out is None else out.when(hit, sector)
    return out.otherwise("other")


def recent_quarters(fin: DataFrame, n: int = QUARTERS, seq: str | None = None) -> DataFrame:
    """Last n quarters per instrument, one row per end_date (the last loaded one by `seq`)."""
    if seq:
        w = Window.partitionBy("ts_code", "end_date").orderBy(F.desc(seq))
        fin = fin.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    w = Window.partitionBy("ts_code").orderBy(F.desc("end_date"))
    return fin.where("end_date is not null").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def quarter_arrays(quarters: DataFrame) -> DataFrame:
    """One row per instrument: an array per metric in date order, each from its first usable alias."""
    have = [a for names in ALIASES.values() for a in names if a in quarters.columns]
    g = quarters.groupBy("ts_code").agg(F.array_sort(F.collect_list(F.struct("end_date", *have))).alias("_q"))
    cols = []
    for metric, names in ALIASES.items():
        pick = F.transform("_q", lambda q: F.lit(None).cast("double"))
        for a in reversed([x for x in names if x in have]):
            arr = F.col("_q").getField(a)
            pick = F.when(F.size(F.filter(arr, lambda x: x.isNotNull())) >= 2, arr).otherwise(pick)
        cols.append(pick.alias(metric))
    out = g.select("ts_code", F.size("_q").alias("quarter_count"), *cols)
    empty = lambda m: F.forall(m, lambda x: x.isNull())
    ratio = lambda a, b: F.zip_with(a, b, lambda x, y: F.try_divide(x, y) * 100)
    out = out.withColumn("debt_ratio", F.when(empty("debt_ratio"), ratio("total_liab", "total_assets")).otherwise(F.col("debt_ratio")))
    out = out.withColumn("roe", F.when(empty("roe"), ratio("net_income", "equity")).otherwise(F.col("roe")))
    return out.withColumn("profit_to_debt", ratio("profit_dedt", "total_liab"))


def _valid(a) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _mean(a: Column) -> Column:
    return F.try_divide(_sum(a), F.size(a))


def _tail(a: Column, n) -> Column:
    k = F.least(F.lit(n) if isinstance(n, int) else n, F.size(a))
    return F.slice(a, F.greatest(F.size(a) - k + 1, F.lit(1)), k)


def trend_delta(v: Column) -> Column:
    n = F.greatest(F.lit(2), F.floor(F.size(v) / 2).cast("int"))
    late, early = _mean(_tail(v, n)), _mean(F.slice(v, F.lit(1), n))
    return F.when(F.size(v) >= 2, (late - early) / F.greatest(F.abs(early), F.abs(late), F.lit(1e-9)))


def quarterly_cagr(v: Column) -> Column:
    """Annualised growth from the least-squares slope of the log values."""
    n = F.size(v).cast("double")
    y = F.transform(v, lambda x: F.log(F.greatest(x, F.lit(1.0))))
    xy = _sum(F.transform(y, lambda x, i: x * i))
    sx, sxx = n * (n - 1) / 2, n * (n - 1) * (2 * n - 1) / 6
    slope = F.try_divide(n * xy - sx * _sum(y), n * sxx - sx * sx)
    return F.when(F.size(v) >= 4, clamp(F.exp(slope * 4) - 1, -0.5, 2.0))


def acceleration(v: Column) -> Column:
    half = F.floor(F.size(v) / 2).cast("int")
    at = lambda i: F.try_element_at(v, i)
    growth = lambda a, b: (b - a) / F.greatest(F.abs(a), F.lit(1e-9))
    return F.when(F.size(v) >= 6, growth(at(half + 1), at(F.lit(-1))) - growth(at(F.lit(1)), at(half)))


def volatility(v: Column) -> Column:
    m = _mean(v)
    var = F.try_divide(_sum(F.transform(v, lambda x: (x - m) * (x - m))), F.size(v) - 1)
    return F.when((F.size(v) >= 3) & (m != 0), F.try_divide(F.sqrt(var), F.abs(m)))


def positive_run(v: Column) -> Column:
    """Positive values counted back from the end."""
    back = F.transform(F.reverse(v), lambda x: x > 0)
    first_miss = F.array_position(back, F.lit(False))
    return F.when(first_miss == 0, F.size(v).cast("long")).otherwise(first_miss - 1)


def avg4(v: Column) -> Column:
    return F.when(F.size(v) >= 2, _mean(_tail(v, 4)))


def pair_ratio(a: str, b: str, numerator=lambda x, y: x) -> Column:
    """Per-quarter ratio where both sides exist."""
    return _valid(F.zip_with(a, b, lambda x, y: F.try_divide(x, y)))


def add_statistics(m: DataFrame) -> DataFrame:
    """The trend statistics every later rule reads."""
    names = [*ALIASES, "profit_to_debt"]
    m = m.select("*", *[_valid(n).alias(f"v_{n}") for n in names])
    v = lambda n: F.col(f"v_{n}")
    both = F.zip_with("net_income", "op_cashflow", lambda x, y: F.when(x.isNotNull() & y.isNotNull(), x - y))
    m = m.select(
        "*", pair_ratio("op_cashflow", "net_income").alias("v_cash_ratio"), _valid(both).alias("_gaps"),
        _valid(F.zip_with(both, "total_assets", lambda d, a: F.try_divide(d, a))).alias("v_accruals"),
        pair_ratio("operate_profit", "net_income").alias("v_op_ratio"), pair_ratio("profit_dedt", "net_income").alias("v_dedt_ratio"))
    return m.select(
        "*", quarterly_cagr(v("revenue")).alias("cagr"), acceleration(v("revenue")).alias("accel"), volatility(v("revenue")).alias("rev_vol"),
        positive_run(v("net_income")).alias("profit_age"), _sum(_tail(v("net_income"), 4)).alias("income4"),
        F.when(F.size("v_net_income") > 0, F.exists(_tail(v("net_income"), 4), lambda x: x > 0)).alias("profitable"),
        F.array_max("v_revenue").alias("rev_max"),
        *[trend_delta(v(n)).alias(f"d_{n}") for n in ("net_income", "op_cashflow", "gross_margin", "eps", "operate_profit", "roe",
                                                      "money_cap", "accounts_receiv", "accruals", "opex")],
        *[avg4(v(n)).alias(f"a_{n}") for n in ("roe", "gross_margin", "op_yoy", "or_yoy", "debt_ratio", "current_ratio", "profit_to_debt",
                                               "op_cashflow", "cash_ratio", "accruals", "op_ratio", "dedt_ratio", "net_income")],
        F.try_divide(F.size(F.filter("v_op_cashflow", lambda x: x > 0)), F.size("v_op_cashflow")).alias("cash_positive"),
        F.try_element_at("v_money_cap", F.lit(-1)).alias("last_cash"), F.try_element_at("v_total_assets", F.lit(-1)).alias("last_assets"),
        F.least(F.lit(1.0), sum((F.when(F.size(f"v_{n}") >= 2, 1).otherwise(0) for n in (
            "revenue", "net_income", "gross_margin", "op_cashflow", "roe", "debt_ratio", "current_ratio")), F.lit(0)) / 5).alias("completeness"),
    )


def classify_lifecycle(s: DataFrame) -> DataFrame:
    """Stage, subflavor and confidence; `industry` refines instruments with under four quarters."""
    c, no = F.col, F.lit(False)
    t = lambda x: F.coalesce(x, no)
    cagr, age, q = c("cagr"), c("profit_age"), c("quarter_count")
    s = s.select(
        "*", t(cagr > 0.25).alias("f_hyper"), t((cagr > 0.10) & (cagr <= 0.25)).alias("f_exp"), t((cagr > 0.05) & (age < 8)).alias("f_early"),
        (~t(c("profitable")) | ((age < 4) & (c("income4") <= 0) & (F.size("v_net_income") > 0))).alias("f_pre"),
        t((F.size("v_revenue") >= 3) & (c("rev_max") < 1e8)).alias("f_small"),
        t((cagr > 0.03) & (cagr <= 0.15) & (age >= 8)).alias("f_steady"),
        t((cagr <= 0.05) & (age >= 4) & t(c("profitable"))).alias("f_cow"),
        t(cagr < -0.03).alias("f_decl"), t(c("rev_vol") > 0.30).alias("f_vol"), sector_of(F.coalesce("industry", F.lit(""))).alias("sector"))
    yoy = c("a_or_yoy")
    strong = t(yoy > 30) & c("f_pre")
    wide = ~strong & t(yoy > 20) & ~c("f_cow") & ~c("f_steady")
    shrink = t(yoy < -5) & (c("f_exp") | wide | c("f_early"))
    base = F.least(F.lit(1.0), q / 12)
    s = s.select(
        "*", (c("f_hyper") | strong).alias("g_hyper"), ((c("f_exp") | wide) & ~shrink).alias("g_exp"), (c("f_early") & ~shrink).alias("g_early"),
        (c("f_decl") | shrink).alias("g_decl"), F.when(strong, F.least(F.lit(1.0), base + 0.05)).otherwise(base).alias("g_conf"))
    rules = [  # first match: condition, stage, subflavor, confidence gain
        (c("g_hyper") & c("f_pre"), "growth", "hypergrowth", 0.1), (c("f_small") & c("f_pre"), "growth", "pre_revenue", 0.05),
        ((c("g_exp") | c("g_early")) & (age < 8), "growth", "expansion", 0.05), (c("f_cow"), "mature", "cash_cow", 0.05),
        (c("f_steady"), "mature", "steady", 0.0), (c("g_decl") & c("f_vol"), "cyclical", "", 0.0), (c("g_decl"), "declining", "", 0.0),
        (c("f_vol"), "cyclical", "", 0.0),
    ]
    stage, sub, gain = F.lit("transitional"), F.lit(""), F.lit(0.0)
    for cond, st, sf, g in reversed(rules):
        stage, sub, gain = F.when(cond, st).otherwise(stage), F.when(cond, sf).otherwise(sub), F.when(cond, g).otherwise(gain)
    conf = F.least(F.lit(1.0), c("g_conf") + gain)
    young = (q < 4) & c("sector").isin("biotech", "tech") & ~t(c("profitable"))
    bank = (q < 4) & (c("sector") == "financial")
    blind = cagr.isNull() & c("d_net_income").isNull() & c("d_op_cashflow").isNull()
    few = F.greatest(F.lit(0.2), conf * 0.7)
    out = s.select(
        "*", F.when(q < 2, "unknown").when(blind, "unknown").when(young, "growth").when(bank, "mature").otherwise(stage).alias("stage"),
        F.when((q < 2) | blind, "").when(young, F.when(c("f_small"), "pre_revenue").otherwise("expansion")).when(bank, "steady").otherwise(sub).alias("subflavor"),
        F.when(q < 2, 0.0).when(blind, F.greatest(F.lit(0.1), q / 24)).when(young | bank, half_up(few, 2)).otherwise(half_up(conf, 2)).alias("confidence"))
    return out.drop(*[x for x in out.columns if x.startswith(("f_", "g_"))])


def _add(score: Column, bonus: Column, lo: float = 0.0, hi: float = 100.0) -> Column:
    """Score plus a bonus where there is one, kept in bounds."""
    return F.when(bonus.isNotNull(), clamp(score + bonus, lo, hi)).otherwise(score)


# Each scorer is a list of steps. A step sees the column of the step before it, so
# expressions stay small instead of nesting into one another.
Step = Callable[[Column], Column]


def _cap(x: Column) -> Column:
    return F.least(F.lit(100.0), x)


def _floor0(x: Column) -> Column:
    return F.greatest(F.lit(0.0), x)


def profitability_mature() -> list[Step]:
    c = F.col
    roe = F.when(c("d_roe") > 0, F.least(F.lit(60.0), clamp(30 + c("a_roe") * 1.2, 5, 60) + 10)).otherwise(clamp(30 + c("a_roe") * 1.2, 5, 60))
    gm = 40 / (1 + F.exp(-(c("a_gross_margin") - 20) / 5))  # never above 40
    return [
        lambda s: roe,
        lambda s: F.when(s.isNotNull() & gm.isNotNull(), s * 0.7 + gm * 0.3).otherwise(F.coalesce(s, gm)),
        lambda s: _add(s, clamp(c("d_net_income") * 20, -10, 10)),
        lambda s: _add(s, clamp(c("a_op_yoy") * 50, -10, 10)),
        lambda s: _add(s, clamp(c("d_eps") * 15, -5, 8)),
        lambda s: F.when(c("a_roe").isNull() & c("a_gross_margin").isNull(), 50.0).otherwise(clamp(s, 0, 100)),
    ]


def growth_mature() -> list[Step]:
    c, g, y = F.col, F.col("cagr"), F.col("a_or_yoy")
    base = F.when((g > 0.03) & (g <= 0.15), 50 + g * 200).when(g > 0.15, 60.0).when(g >= 0, 50 + g * 100).otherwise(50 + g * 150)
    bonus = F.when(y > 15, F.least(F.lit(12.0), (y - 15) * 0.4)).when(y > 5, 0.0).when(y > -5, F.greatest(F.lit(-8.0), y)).otherwise(
        F.greatest(F.lit(-15.0), y * 0.8))
    return [
        lambda s: clamp(base, 10, 90),
        lambda s: _add(s, F.when(y.isNotNull(), bonus)),
        lambda s: _add(s, clamp(c("accel") * 15, -8, 8)),
        lambda s: _add(s, clamp(c("d_operate_profit") * 12, -6, 8)),
        lambda s: F.when(g.isNull(), 50.0).otherwise(clamp(s, 0, 100)),
    ]


def health_mature() -> list[Step]:
    c, d, p, m = F.col, F.col("a_debt_ratio"), F.col("a_profit_to_debt"), F.col("d_money_cap")
    debt = F.when(d < 20, 40.0).when(d < 50, 40 - (d - 20) * 0.4).when(d < 70, 28 - (d - 50)).otherwise(_floor0(8 - (d - 70) * 0.3))
    z = (c("a_current_ratio") - 2.0) / 0.8
    has_cash = F.size("v_op_cashflow") >= 3
    cover = F.when(p > 20, 20.0).when(p > 10, 15 + (p - 10) * 0.5).when(p > 2, p).otherwise(_floor0(p * 0.5))
    return [
        lambda s: F.when(d.isNotNull(), debt * 0.5 + 25.0).otherwise(50.0),
        lambda s: F.when(z.isNotNull(), s * 0.6 + F.exp(z * z * -0.5) * 12.0).otherwise(s),
        lambda s: F.when(has_cash, _cap(s + c("cash_positive") * 20)).otherwise(s),
        lambda s: F.when(p.isNotNull(), _cap(s + cover)).otherwise(s),
        lambda s: F.when(m > 0.1, _cap(s + 5)).when(m < -0.15, _floor0(s - 5)).otherwise(s),
        lambda s: F.when(d.isNull() & z.isNull() & ~has_cash, 50.0).otherwise(clamp(s, 0, 100)),
    ]


def profitability_growth() -> list[Step]:
    c, y = F.col, F.col("a_or_yoy")
    base = (50 + F.when(c("d_net_income") > 0, F.least(F.lit(15.0), c("d_net_income") * 30)).otherwise(0.0)
            + F.when(c("d_gross_margin") > 0, F.least(F.lit(10.0), c("d_gross_margin") * 20)).otherwise(0.0)
            + F.when(y > 20, F.least(F.lit(12.0), (y - 20) * 0.3)).when(y < 0, -F.least(F.lit(10.0), F.abs(y) * 0.2)).otherwise(0.0))
    return [lambda s: base, lambda s: clamp(F.when(c("subflavor") == "pre_revenue", clamp(s, 35, 70)).otherwise(s), 0, 100)]


def growth_growth() -> list[Step]:
    c, g, y, sub, a, o = F.col, F.col("cagr"), F.col("a_or_yoy"), F.col("subflavor"), F.col("accel"), F.col("d_opex")
    up = lambda k, most: 50 + F.least(F.lit(most), g * k)
    base = F.when(sub == "pre_revenue", F.when(g > 0, up(100, 40.0)).otherwise(50.0)).when(sub == "hypergrowth", up(120, 45.0)).otherwise(up(160, 40.0))
    early = sub == "pre_revenue"
    return [
        lambda s: clamp(base, 20, 95),
        lambda s: F.when((sub == "hypergrowth") & (y > 30), _cap(s + 10)).when(y > 15, _cap(s + 5)).when(y < -10, _floor0(s - 10)).otherwise(s),
        lambda s: _add(s, F.when(a > 0, clamp(a * 25, -5, 15)).when(a <= 0, F.greatest(F.lit(-10.0), a * 20))),
        lambda s: F.when(early & (o > 0.05), _cap(s + 8)).when(early & (o < -0.05), _floor0(s - 8)).otherwise(s),
        lambda s: F.when(g.isNull(), 50.0).otherwise(clamp(s, 0, 100)),
    ]


def health_growth() -> list[Step]:
    c, d, p, burn, t = F.col, F.col("a_debt_ratio"), F.col("a_profit_to_debt"), F.col("a_op_cashflow"), F.col("d_op_cashflow")
    burning = F.coalesce((F.size("v_op_cashflow") >= 3) & c("subflavor").isin("pre_revenue", "hypergrowth") & (burn < 0), F.lit(False))
    cash = F.coalesce(c("last_cash"), c("last_assets") * 0.15, F.lit(0.0))
    runway = F.least(F.lit(40.0), cash / F.greatest(F.abs(burn), F.lit(1.0)) / 4 * 10)
    has_runway = burning & (cash > 0)
    debt = F.when(d < 40, 30.0).when(d < 60, 20.0).otherwise(_floor0(20 - (d - 60) * 0.5))
    return [
        lambda s: F.when(has_runway, runway * 0.5 + 25.0).otherwise(50.0),
        lambda s: F.when(burning & (t > 0), _cap(s + 12)).when(burning & (t < -0.1), _floor0(s - 10)).otherwise(s),
        lambda s: F.when(d.isNotNull(), s * 0.6 + debt * 0.4).otherwise(s),
        lambda s: F.when(p > 15, _cap(s + 8)).when(p > 5, _cap(s + 3)).when(p < 0, _floor0(s - 8)).otherwise(s),
        lambda s: F.when(~has_runway & d.isNull(), 50.0).otherwise(clamp(s, 0, 100)),
    ]


def earnings_quality() -> list[Step]:
    c, r, a = F.col, F.col("a_cash_ratio"), F.abs("a_accruals")
    enough = F.size("_gaps") >= 3
    has_r, has_a = enough & r.isNotNull(), enough & a.isNotNull()
    cash = F.when(r > 1, F.least(F.lit(30.0), 15 + (r - 1) * 5)).when(r > 0.5, (r - 0.5) * 30).otherwise(0.0)
    acc = F.when(a < 0.03, 20.0).when(a < 0.06, 12.0).otherwise(5.0) + F.when(c("d_accruals") < 0, 5.0).otherwise(0.0)
    n3 = lambda x: F.size(x) >= 3
    ar = F.when(n3("v_accounts_receiv"), c("d_accounts_receiv"))
    o = F.when(n3("v_operate_profit") & n3("v_net_income"), c("a_op_ratio"))
    e = F.when(n3("v_profit_dedt") & n3("v_net_income"), c("a_dedt_ratio"))
    return [
        lambda s: F.when(has_r, cash * 0.5 + 25.0).otherwise(50.0),
        lambda s: F.when(has_a, _cap(s + acc)).otherwise(s),
        lambda s: F.when(ar > 0.2, _floor0(s - 10)).when(ar > 0.1, _floor0(s - 5)).when(ar < -0.05, _cap(s + 5)).otherwise(s),
        lambda s: F.when(o < 0.5, _floor0(s - 10)).when(o > 0.8, _cap(s + 5)).otherwise(s),
        lambda s: F.when(e < 0.5, _floor0(s - 12)).when(e < 0.7, _floor0(s - 6)).when(e > 0.9, _cap(s + 3)).otherwise(s),
        lambda s: F.when(~has_r & ~has_a, 50.0).otherwise(clamp(s, 0, 100)),
    ]


def run_scorers(df: DataFrame, scorers: dict[str, list[Step]]) -> DataFrame:
    """Runs all scorers side by side, one projection per step."""
    for i in range(max(map(len, scorers.values()))):
        df = df.withColumns({n: st[i](F.col(n) if i else F.lit(None).cast("double")) for n, st in scorers.items() if i < len(st)})
    return df


def quality_scores(s: DataFrame) -> DataFrame:
    """Four rounded dimensions, weighted by stage, and the label."""
    c = F.col
    grow = c("stage") == "growth"
    d = run_scorers(s, {"_pm": profitability_mature(), "_gm": growth_mature(), "_hm": health_mature(), "_pg": profitability_growth(),
                        "_gg": growth_growth(), "_hg": health_growth(), "_eq": earnings_quality()})
    d = d.select(
        "*", *[half_up(F.when(grow, c(g)).otherwise(c(m)), 1).alias(n) for n, g, m in (
            ("profitability", "_pg", "_pm"), ("growth_quality", "_gg", "_gm"), ("financial_health", "_hg", "_hm"))],
        half_up(c("_eq"), 1).alias("earnings_quality")).drop("_pm", "_gm", "_hm", "_pg", "_gg", "_hg", "_eq")
    dims = ["profitability", "growth_quality", "financial_health", "earnings_quality"]
    total = sum((c(n) * w for n, w in zip(dims, STAGE_WEIGHTS["other"])), F.lit(0.0))
    for st in ("growth", "mature", "cyclical", "declining"):
        total = F.when(c("stage") == st, sum((c(n) * w for n, w in zip(dims, STAGE_WEIGHTS[st])), F.lit(0.0))).otherwise(total)
    d = d.withColumn("_raw", clamp(total, 0, 100))
    x = c("_raw")
    label = (
        F.when(grow & (c("subflavor") == "pre_revenue"), F.when(x >= 55, "早期成长").otherwise("早期关注"))
        .when(grow, F.when(x >= 65, "高成长").when(x >= 40, "成长关注").otherwise("成长风险"))
        .when(c("stage") == "mature", F.when(x >= 70, "优质").when(x >= 50, "稳健").when(x >= 35, "关注").otherwise("偏弱"))
        .when(c("stage").isin("cyclical", "declining"), F.when(x >= 50, "周期关注").otherwise("周期风险"))
        .otherwise(F.when(x >= 40, "中性").otherwise("待观察")))
    return d.select("*", half_up(x, 1).alias("fundamental_quality_score"), label.alias("label"), half_up(c("completeness"), 2).alias("data_completeness"))


def add_bullets(s: DataFrame) -> DataFrame:
    """Up to five bullet texts and the one-line summary."""
    c = F.col
    fmt = lambda p, *a: F.format_string(p, *a)
    g, ni, gm, cf, d, y, oy, pd_ = (c("cagr"), c("d_net_income"), c("d_gross_margin"), c("d_op_cashflow"), c("a_debt_ratio"), c("a_or_yoy"),
                                    c("a_op_yoy"), c("a_profit_to_debt"))
    losing = (c("stage") == "growth") & ~F.coalesce(_mean(_tail(c("v_net_income"), 4)) > 0, F.lit(False))
    word = lambda x, hi, mid, *w: F.when(x > hi, w[0]).when(x > mid, w[1]).when(x > 0, w[2]).otherwise(w[3])
    sway = lambda x, k, *w: F.when(x > k, w[0]).when(x < -k, w[1]).otherwise(w[2])
    items = [
        F.when(g.isNotNull(), F.concat(F.lit("营收"), word(g, 0.15, 0.05, "快速增长", "稳健增长", "缓慢增长", "下滑"), fmt("（年化%.1f%%），基于%d个季度数据。", printed(g * 100, 1), F.size("v_revenue")))),
        F.when(ni.isNotNull(), F.when(losing, F.when(ni > 0, "公司尚处投入期，但亏损幅度收窄，经营杠杆逐步显现。").otherwise("公司尚处投入期，盈利路径有待兑现，关注现金消耗节奏。"))
               .otherwise(F.concat(F.lit("净利润趋势"), sway(ni, 0.05, "改善", "承压", "平稳"), F.lit("。")))),
        F.when(gm.isNotNull(), F.concat(F.lit("毛利率"), sway(gm, 0.03, "改善", "承压", "稳定"), F.lit("，反映产品竞争力和成本控制能力。"))),
        F.when(cf.isNotNull(), F.concat(F.lit("经营现金流"), sway(cf, 0.05, "改善", "走弱", "稳定"), F.lit("。"))),
        F.when(d > 60, fmt("资产负债率偏高（%.0f%%），关注偿债压力。", printed(d, 0))).when(d < 30, fmt("资产负债率低（%.0f%%），财务结构稳健。", printed(d, 0))),
        F.when(y.isNotNull(), F.concat(F.lit("营收同比"), word(y, 20, 10, "高增长", "稳健增长", "低速增长", "下滑"), fmt("（近四季均值%.1f%%）。", printed(y, 1)))),
        F.when(oy > 0, fmt("营业利润同比增长%.1f%%，主业盈利改善。", printed(oy, 1))).when(oy < -10, fmt("营业利润同比下滑%.1f%%，关注主业承压。", printed(oy, 1))),
        F.when((d > 40) & (pd_ < 3), fmt("利润对债务覆盖不足（利润/负债=%.1f%%），关注偿债能力。", printed(pd_, 1))),
        F.when((c("stage") == "growth") & (c("subflavor") == "pre_revenue"), "企业处于早期成长阶段，评分侧重成长潜力和现金可持续性，不因当前未盈利而直接否定。"),
        F.when(c("completeness") < 0.5, fmt("财务数据覆盖度有限（%.0f%%），部分指标基于有限样本估计。", printed(c("completeness") * 100, 0))),
    ]
    stage_cn = reduce(lambda acc, kv: F.when(c("stage") == kv[0], kv[1]).otherwise(acc), STAGE_NAMES.items(), c("stage"))
    revenue = F.when(y.isNotNull(), fmt("营收同比%+.1f%%", printed(y, 1))).when(g.isNotNull(), fmt("营收CAGR %.1f%%", printed(g * 100, 1))).otherwise("营收趋势未知")
    way = lambda x, what, good="改善", bad="承压": F.when(x > 0, what + good).when(x <= 0, what + bad).otherwise(what + "趋势未知")
    summary = F.concat(F.lit("【"), stage_cn, F.lit("】"), revenue, F.lit("，"), way(ni, "盈利"), F.lit("，"), way(cf, "现金流"),
                       fmt("。综合质量得分%.0f/100。", printed(c("_raw"), 0)))
    return s.select("*", F.slice(_valid(F.array(*items)), 1, 5).alias("bullets"), summary.alias("summary"))


def fundamental_quality(fin: DataFrame, basic: DataFrame, seq: str | None = None) -> DataFrame:
    """Statements and instruments to stage, dimensions, score, label and texts, one row per instrument."""
    m = quarter_arrays(recent_quarters(fin, QUARTERS, seq)).join(basic.select("ts_code", "industry"), "ts_code", "left")
    return add_bullets(quality_scores(classify_lifecycle(add_statistics(m))))


def quick_screen(candidates: DataFrame, quality: DataFrame, enabled: bool = True) -> DataFrame:
    """Candidates with score and stage; neutral 50 and unknown below two quarters or when switched off."""
    if not enabled:
        return candidates.select("*", F.lit(50.0).alias("fundamental_quality_score"), F.lit("unknown").alias("lifecycle_stage"))
    known = quality.where("quarter_count >= 2").select("ts_code", "fundamental_quality_score", F.col("stage").alias("lifecycle_stage"))
    j = candidates.join(known, "ts_code", "left")
    return j.withColumn("fundamental_quality_score", F.coalesce("fundamental_quality_score", F.lit(50.0))).withColumn(
        "lifecycle_stage", F.coalesce("lifecycle_stage", F.lit("unknown")))


def prefer_source(local: DataFrame, vendor: DataFrame, extracted: DataFrame, cols: list[str]) -> DataFrame:
    """One snapshot per instrument from the first source that has it, with the source named."""
    rank = [(local, "local", 0), (vendor, "vendor", 1), (extracted, "web", 2)]
    parts = [d.select("ts_code", *cols, F.lit(n).alias("source"), F.lit(p).alias("_p")) for d, n, p in rank]
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    w = Window.partitionBy("ts_code").orderBy("_p")
    return u.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_p")
