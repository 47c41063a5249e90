"""Regime, alpha score, pools, trimming and diversification."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql import types as T

from tickloom.functions.scores import clamp01
from tickloom.operators.ranking import top_n
from tickloom.sources.workspace import saved

STATUS_WEIGHT = {"confirmed": 1.0, "web_only": 0.75, "capital_only": 0.7, "weak": 0.4}  # fixed values
VERDICT_RISK = {"pass": 0.1, "warn": 0.45, "fail": 0.95}
# round -> (minimum volume boost, theme limit, minimum consolidation, technical cap)
RELAXATION = {0: (0.5, 100, 50, 10), 1: (0.3, 100, 35, 15), 2: (0.0, 200, 20, 20)}


def _or(c: str, default: float) -> Column:
    """Null and zero both fall back to the default, as the ranking rules expect."""
    return F.when(F.col(c).isNull() | (F.col(c) == 0), F.lit(default)).otherwise(F.col(c))


def add_regime(df: DataFrame) -> DataFrame:
    """Market regime and its confidence; the first matching rule wins."""
    adx, pos, top = _or("adx", 20.0), _or("close_position", 0.5), _or("dist_to_box_top", 0.10)
    bear, bull = F.col("ma_trend") == "bearish", F.col("ma_trend") == "bullish"
    t = lambda c: F.coalesce(F.col(c), F.lit(False))
    rules = [
        (bear & (pos < 0.5) & (adx > 25), "downtrend", F.least(F.lit(0.9), adx / 50)),
        ((pos < 0.2) & (bear | t("obv_divergence")), "bottom_fishing", F.when(bear, 0.7).otherwise(0.55)),
        ((pos > 0.85) & t("ignition") & (top < 0.05), "breakout_zone", F.lit(0.85)),
        ((pos > 0.80) & (adx > 30) & (F.col("adx_slope") > 0), "breakout_zone", F.lit(0.6)),
        (bull & (adx > 30) & t("bos_20d"), "uptrend", F.least(F.lit(0.9), 0.5 + 0.1 * F.least(F.lit(5.0), F.coalesce("timing_score", F.lit(0.0))))),
        (bull & (adx > 22), "uptrend", F.lit(0.5)),
    ]
    label, conf = F.lit("range"), F.when(adx < 18, 0.75).otherwise(0.5)
    for cond, name, c in reversed(rules):
        label, conf = F.when(cond, name).otherwise(label), F.when(cond, c).otherwise(conf)
    return df.select("*", label.alias("market_regime"), conf.alias("regime_confidence"))


def audit_features(audits: DataFrame, tier) -> DataFrame:
    """Per instrument: worst verdict risk, findings, distinct catalysts, mean source tier, mean business quality."""
    risk = F.lit(VERDICT_RISK["warn"])
    for v, r in VERDICT_RISK.items():
        risk = F.when(F.col("verdict") == v, r).otherwise(risk)
    per = audits.groupBy("ts_code").agg(F.max(risk).alias("audit_risk_score"), F.sum(F.size("findings")).alias("positive_finding_count"),
                                        F.avg(_or("business_quality_score", 50.0)).alias("business_quality_score"))
    cats = audits.select("ts_code", F.explode("catalysts").alias("k")).distinct().groupBy("ts_code").agg(F.count(F.lit(1)).alias("catalyst_diversity"))
    src = audits.select("ts_code", F.explode("sources").alias("u")).groupBy("ts_code").agg(F.avg(tier(F.col("u"))).alias("source_quality_score"))
    return per.join(cats, "ts_code", "left").join(src, "ts_code", "left").na.fill(0.0, ["source_quality_score"]).na.fill(0, ["catalyst_diversity"])


def passed_audit(candidates: DataFrame, audits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates whose worst verdict is pass, and the audits of those candidates."""
    kept = worst_verdict(candidates, audits).where("worst_verdict = 'pass'")
    return kept, audits.join(kept.select("ts_code").distinct(), "ts_code", "left_semi")


def add_alpha(df: DataFrame) -> DataFrame:
    """Quality, setup and audit pillars, penalties and regime terms to a 0-100 score."""
    c = F.col
    d = lambda n, v: F.coalesce(F.col(n), F.lit(v)).cast("double")
    lps, pos, conf = d("lps_pullback", 0.0), _or("close_position", 0.5), _or("regime_confidence", 0.5)
    regime = F.coalesce("market_regime", F.lit("range"))
    quality = clamp01(d("business_quality_score", 50.0) / 100) * 0.7 + clamp01(d("valuation_quality_score", 50.0) / 100) * 0.3
    setup = clamp01(d("consolidation_score", 50.0) / 100) * 0.5 + clamp01(d("squeeze_readiness", 50.0) / 100) * 0.25 + clamp01(lps / 5) * 0.25
    audit = (clamp01(d("positive_finding_count", 0.0) / 4) * 0.30 + clamp01(d("catalyst_diversity", 0.0) / 3) * 0.25
             + clamp01(d("source_quality_score", 0.0)) * 0.20 + (1 - clamp01(d("audit_risk_score", 0.5))) * 0.25)
    crowd = clamp01(clamp01(d("toplist_recency_score", 0.0)) * 0.65 + clamp01((d("turnover_mult", 1.0) - 3) / 2) * 0.35)
    rough = clamp01(d("atr_pct", 0.05) / 0.06 + d("range_pct_60d", 0.30) / 0.50) / 2
    broke = F.coalesce(c("timing_bos"), F.lit(False)) | F.coalesce(c("bos_20d"), F.lit(False))
    pull = F.when(broke & lps.between(0.5, 4.0), clamp01(lps / 3)).otherwise(0.0)
    df = df.withColumns({"_pillars": quality * 0.40 + setup * 0.35 + audit * 0.25 - crowd * 0.12 - rough * 0.08, "_pull": pull})
    terms = (
        F.when(regime == "uptrend", c("_pull") * 0.12).when((regime == "range") & (pos < 0.4), c("_pull") * 0.05).otherwise(0.0)
        + F.when(regime == "range", clamp01(1 - F.abs(pos - 0.3) / 0.4) * conf * 0.08).otherwise(0.0)
        + F.when(regime == "breakout_zone", conf * -0.08).when(pos > 0.90, -0.05).otherwise(0.0)
        + F.when(regime == "downtrend", conf * -0.06).when(regime == "bottom_fishing", conf * -0.03).otherwise(0.0))
    return df.withColumn("alpha_rank_score", clamp01(c("_pillars") + terms) * 100).drop("_pillars", "_pull")


def recommendation() -> Column:
    """avoid / watch / buy / strong_buy from verdict, regime, position, quality and consolidation."""
    c = F.col
    pos, q, k = _or("close_position", 0.5), _or("fundamental_quality_score", 50.0), _or("consolidation_score", 50.0)
    crash = F.coalesce(F.exists("bullets", lambda b: (F.regexp_extract(b, r"(?:Q1|一季度|归母|净利(?:润)?).*?同比\s*([+-]?\d+\.?\d*)\s*%", 1).try_cast("double") < -30)
                                | (b.contains("恶化") & (q < 40))), F.lit(False))
    avoid = crash | (c("pe").isNull() & (q < 45))
    cooling = F.coalesce(c("days_since_spike") <= 20, F.lit(False)) & (pos > 0.55)
    return (
        F.when(c("worst_verdict") == "fail", "avoid").when(avoid, "avoid").when(cooling, "watch")
        .when(c("market_regime").isin("breakout_zone", "downtrend", "bottom_fishing"), "watch")
        .when((pos <= 0.30) & (q >= 50) & (k >= 50), "strong_buy").when((pos <= 0.50) & (q >= 45) & (k >= 40), "buy").otherwise("watch"))


def worst_verdict(candidates: DataFrame, audits: DataFrame) -> DataFrame:
    """Candidates with their worst audit verdict; no audit counts as warn."""
    rank = F.when(F.col("verdict") == "fail", 2).when(F.col("verdict") == "pass", 0).otherwise(1)
    w = audits.groupBy("ts_code").agg(F.max(rank).alias("_v"))
    j = candidates.join(w, "ts_code", "left")
    return j.withColumn("worst_verdict", F.when(F.col("_v") == 2, "fail").when(F.col("_v") == 0, "pass").otherwise("warn")).drop("_v")


def technical_pool(universe: DataFrame, theme_codes: DataFrame, round_: int, order: str = "composite_score") -> DataFrame:
    """Names outside the theme list above the round's consolidation floor, the first of them by `order`."""
    _, _, floor, cap = RELAXATION[round_]
    kept = universe.where(F.col("consolidation_score") >= floor).join(theme_codes.select("ts_code"), "ts_code", "left_anti")
    return kept.orderBy(F.desc(order), "ts_code").limit(cap).withColumn("list_type", F.lit("technical"))


def theme_pool(universe: DataFrame, round_: int) -> DataFrame:
    boost, limit, _, _ = RELAXATION[round_]
    return universe.where(F.col("volume_boost") >= boost).orderBy(F.desc("consolidation_score"), "ts_code").limit(limit)


def trim_after_audit(ranked: DataFrame, run: list[str], theme_cap: int = 8, total_cap: int = 15) -> DataFrame:
    """First theme names up to the cap, then technical names, then the other theme names, up to the total.

    Only the first `total_cap` of each list can survive, so both lists are cut per task before the merge.
    """
    c = F.col
    d = ranked.where(c("list_type").isin("theme_driven", "both", "technical")).withColumn("_theme", c("list_type") != "technical")
    order = [F.desc("alpha_rank_score"), F.col("ts_code")]
    d = top_n(d, [*run, "_theme"], total_cap + theme_cap, *order)
    d = d.withColumn("_pos", F.row_number().over(Window.partitionBy(*run, "_theme").orderBy(*order)))
    d = d.withColumn("_tier", F.when(c("_theme") & (c("_pos") <= theme_cap), 0).when(~c("_theme"), 1).otherwise(2))
    w = Window.partitionBy(*run).orderBy("_tier", "_pos")
    return d.withColumn("final_rank", F.row_number().over(w)).where(c("final_rank") <= total_cap).drop("_theme", "_pos", "_tier")


def diversify(ranked: DataFrame, run: str, rank: str, max_theme: int = 4, max_industry: int = 4, target: int = 10) -> DataFrame:
    """Greedy walk down the ranking under theme and industry limits, then backfill in order.

    A row can be taken only among the first `limit` rows of its (theme, industry) pair, and
    the backfill only reaches the first `target` rows; everything else is dropped exactly
    before the fold. What is left per run is bounded by the fixed lists of themes and industries.
    """
    pair_cap = min(max_theme, max_industry)
    w_pair = Window.partitionBy(run, "primary_theme", "industry").orderBy(rank)
    w_run = Window.partitionBy(run).orderBy(rank)
    heads = ranked.withColumn("_k", F.row_number().over(w_pair)).where(F.col("_k") <= pair_cap).drop("_k")
    first = ranked.withColumn("_k", F.row_number().over(w_run)).where(F.col("_k") <= target).drop("_k")
    small = heads.unionByName(first).dropDuplicates([run, "ts_code"])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(rank)
        themes: dict[str, int] = {}
        industries: dict[str, int] = {}
        taken = []
        for row in pdf.itertuples():
            if len(taken) >= target:
                break
            if themes.get(row.primary_theme, 0) < max_theme and industries.get(row.industry, 0) < max_industry:
                taken.append(row.Index)
                themes[row.primary_theme] = themes.get(row.primary_theme, 0) + 1
                industries[row.industry] = industries.get(row.industry, 0) + 1
        rest = [i for i in pdf.index if i not in set(taken)]
        picked = pdf.loc[(taken + rest)[:target]].copy()
        picked["pick_order"] = range(1, len(picked) + 1)
        return picked

    schema = T.StructType([*small.schema.fields, T.StructField("pick_order", T.IntegerType())])
    return small.groupBy(run).applyInPandas(fold, schema)


def theme_strength(themes: DataFrame) -> DataFrame:
    """Themes (theme, status, capital_signal) with `strength`: the status' weight, a little more with capital behind it."""
    base = F.lit(0.35)
    for status, weight in STATUS_WEIGHT.items():
        base = F.when(F.col("status") == status, weight).otherwise(base)
    return themes.withColumn("strength", F.when(F.col("capital_signal"), F.least(F.lit(1.1), base + 0.05)).otherwise(base))


def list_strength(matched: DataFrame, themes: DataFrame) -> DataFrame:
    """(ts_code, theme_strength_score): the strongest of a name's matched themes; an unknown theme counts 0.5, none 0."""
    each = matched.select("ts_code", F.explode_outer("matched_themes").alias("theme"))
    known = each.join(theme_strength(themes).select("theme", "strength"), "theme", "left")
    own = F.when(F.col("theme").isNull(), 0.0).otherwise(F.coalesce("strength", F.lit(0.5)))
    return known.groupBy("ts_code").agg(F.max(own).alias("theme_strength_score"))


def dual_list(universe: DataFrame, matched: DataFrame, themes: DataFrame, round_: int = 0, theme_cap: int = 30) -> DataFrame:
    """Theme names by pre-audit score up to their cap, technical names of the round beside them, and `both` where a name is in both pools.

    universe: ts_code, pre_audit, composite_score, consolidation_score. Adds list_type, theme_strength_score and position:
    theme names first, then technical ones, each by pre-audit score."""
    strong = list_strength(matched.where(F.size("matched_themes") > 0), themes)
    theme = universe.join(strong, "ts_code").orderBy(F.desc("pre_audit"), "ts_code").limit(theme_cap)
    alone = technical_pool(universe, theme, round_, "pre_audit").withColumn("theme_strength_score", F.lit(0.0))
    whole = technical_pool(universe, theme.where("false"), round_, "pre_audit").select("ts_code", F.lit(True).alias("_tech"))
    theme = theme.join(whole, "ts_code", "left").withColumn("list_type", F.when(F.col("_tech"), "both").otherwise("theme_driven")).drop("_tech")
    w = Window.orderBy(F.col("list_type") == "technical", F.desc("pre_audit"), "ts_code")  # two capped lists
    return theme.unionByName(alone).withColumn("position", F.row_number().over(w))


def round_candidates(universe: DataFrame, matched: DataFrame, named: DataFrame, themes: DataFrame, round_: int, audited: DataFrame | None = None, theme_cap: int = 30) -> DataFrame:
    """The dual list of one relaxation round: theme and technical pools by the round's thresholds, without what was audited before.

    universe: ts_code, pre_audit, composite_score, consolidation_score, volume_boost. named: ts_code of names that theme texts name; those that
    miss the theme pool are added to it, audited or not. filter_tier tells technical names that stand in for an absent theme list."""
    left = universe if audited is None else universe.join(audited.select("ts_code").distinct(), "ts_code", "left_anti")
    pool = theme_pool(left, round_).select("ts_code")
    pool = pool.union(universe.join(named.select("ts_code").distinct(), "ts_code", "left_semi").select("ts_code")).distinct()
    strong = list_strength(matched.where(F.size("matched_themes") > 0), themes)
    theme = universe.join(pool, "ts_code", "left_semi").join(strong, "ts_code").orderBy(F.desc("pre_audit"), "ts_code").limit(theme_cap)
    theme = theme.withColumn("list_type", F.lit("theme_driven"))
    tech = technical_pool(left, theme, round_, "pre_audit").withColumn("theme_strength_score", F.lit(0.0))
    some = theme.agg((F.count(F.lit(1)) > 0).alias("_some"))
    tier = F.when(F.col("list_type") == "theme_driven", "theme_driven").when(F.col("_some"), "technical").otherwise("OFF_THEME_FALLBACK")
    both = theme.unionByName(tech).crossJoin(F.broadcast(some))  # one row
    return both.select(*universe.columns, "theme_strength_score", "list_type", tier.alias("filter_tier"), F.lit(round_).alias("round"))


def refilled(universe: DataFrame, matched: DataFrame, named: DataFrame, themes: DataFrame, passing: DataFrame, least: int = 5, rounds: int = 2) -> DataFrame:
    """Candidates of the first round and of refill rounds, appended while fewer than `least` distinct names pass their audit.

    passing: ts_code of names whose audit passes. A round leaves out what earlier ones audited; one that isn't needed, or comes after one without new names, gives no rows."""
    out = saved(round_candidates(universe, matched, named, themes, 0), "round")
    for r in range(1, rounds + 1):
        have = out.join(passing.select("ts_code").distinct(), "ts_code", "left_semi").agg(F.count(F.lit(1)).alias("_n"))
        last = out.agg(F.max("round").alias("_last"))
        new = round_candidates(universe, matched, named, themes, r, out)
        go = have.crossJoin(last).where((F.col("_n") < least) & (F.col("_last") == r - 1)).select(F.lit(True).alias("_go"))  # a row or none
        out = saved(out.union(new.crossJoin(F.broadcast(go)).select(*out.columns)), "round")
    return out


def audit_confidence(audits: DataFrame, findings: DataFrame) -> DataFrame:
    """audits with `confidence`: from the mean confidence of their findings, the verdict and the business quality."""
    mean = findings.groupBy("doc_id", "ts_code").agg(F.avg("confidence").alias("_mean"))
    c = F.coalesce(0.3 + F.col("_mean") * 0.5, F.lit(0.5))
    c = F.when(F.col("verdict") == "pass", F.least(F.lit(1.0), c + 0.2)).when(F.col("verdict") == "fail", F.greatest(F.lit(0.0), c - 0.3)).otherwise(c)
    return audits.join(mean, ["doc_id", "ts_code"], "left").withColumn("confidence", clamp01(c + (F.col("business_quality_score") - 50) / 250)).drop("_mean")


def catalysts(findings: DataFrame) -> DataFrame:
    """Per name and category: mean confidence, first description, and the timeframe that the descriptions tell.

    findings: ts_code, doc_id, category, confidence, description."""
    said = lambda words: F.max(F.col("description").rlike(words))
    return findings.groupBy("ts_code", "category").agg(
        F.avg("confidence").alias("confidence"), F.min_by("description", "doc_id").alias("description"),
        F.when(said("近期|已"), "near_term").when(said("规划|计划"), "long_term").otherwise("medium_term").alias("timeframe"))
