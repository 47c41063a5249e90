"""Information coefficients, quantile and top-n returns, robustness and ablation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tickloom.operators import ranking as R
from tickloom.sources.workspace import saved


def guarded_corr(x, y) -> Column:
    """Pearson correlation, null where a side is constant or has one row."""
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def long_pairs(df: DataFrame, factors: list[str], returns: list[str], keep: list[str]) -> DataFrame:
    """One row per input row, factor and return column with both values present."""
    f = F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("double").alias("x")) for c in factors]))
    r = F.explode(F.array(*[F.struct(F.lit(c).alias("return_col"), F.col(c).cast("double").alias("y")) for c in returns]))
    out = df.select(*keep, *returns, f.alias("_f")).select(*keep, "_f", r.alias("_r"))
    return out.select(*keep, "_f.*", "_r.*")


def ic_by_date(df: DataFrame, factors: list[str], returns: list[str], bound: int, by: tuple[str, ...] = ("signal_date",),
               plain_rows: int = R.PLAIN_ROWS, ranks: bool = True) -> DataFrame:
    """Pearson and rank correlation per date over rows where factor and return are present; without `ranks` no rank_ic.

    Up to `plain_rows` rows a group each row moves once, by group, and is ranked before the unpivot to pairs: one sort a column serves all its pairs."""
    keys = [*by, "factor", "return_col"]
    if ranks and bound <= plain_rows:
        ranked = _ranked_pairs(df, factors, returns, list(by))
    else:
        p = long_pairs(df, factors, returns, list(by))
        # a pair with one side missing loses both, so groups without any valid pair still report n = 0
        both = F.col("x").isNotNull() & F.col("y").isNotNull()
        p = p.select(*keys, F.when(both, F.col("x")).alias("x"), F.when(both, F.col("y")).alias("y"))
        ranked = R.average_ranks(p, keys, {"x": "_rx", "y": "_ry"}, bound, plain_rows=plain_rows) if ranks else p
    rank_ic = [guarded_corr("_rx", "_ry").alias("rank_ic")] if ranks else []
    return ranked.groupBy(*keys).agg(
        F.count("x").alias("n"), guarded_corr("x", "y").alias("ic"), *rank_ic, F.avg("y").alias("mean_return"))


def _ranked_pairs(df: DataFrame, factors: list[str], returns: list[str], by: list[str]) -> DataFrame:
    """long_pairs with both sides null where one is missing, and their average ranks `_rx` and `_ry` among the group's rows that have the pair."""
    xs, ys = {f: f"_x{i}" for i, f in enumerate(factors)}, {r: f"_y{i}" for i, r in enumerate(returns)}
    df = df.select(*by, *[F.col(n).cast("double").alias(c) for n, c in (xs | ys).items()])

    def ranks(own: str, others: list[str]) -> list[Column]:
        w = Window.partitionBy(*by).orderBy(own)
        out = []
        for o in others:  # rows of the pair up to this value, less half of the others that tie
            pair = F.count(F.when(F.col(own).isNotNull() & F.col(o).isNotNull(), 1))
            upto = pair.over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
            out.append((upto - (pair.over(w.rangeBetween(Window.currentRow, Window.currentRow)) - 1) / 2.0).alias(f"_r{own}{o}"))
        return out

    for own in xs.values():
        df = df.select("*", *ranks(own, list(ys.values())))
    for own in ys.values():
        df = df.select("*", *ranks(own, list(xs.values())))

    def pair(f: str, r: str) -> Column:
        x, y = F.col(xs[f]), F.col(ys[r])
        both = x.isNotNull() & y.isNotNull()
        values = {"x": x, "y": y, "_rx": F.col(f"_r{xs[f]}{ys[r]}"), "_ry": F.col(f"_r{ys[r]}{xs[f]}")}
        return F.struct(F.lit(f).alias("factor"), F.lit(r).alias("return_col"), *[F.when(both, c).alias(n) for n, c in values.items()])

    return df.select(*by, F.explode(F.array(*[pair(f, r) for f in factors for r in returns])).alias("_p")).select(*by, "_p.*")


def summarize_ic(ic: DataFrame) -> DataFrame:
    """Periods, means and information ratios per factor and return column; of the rank correlations where there are any."""
    def ratio(c: str) -> Column:
        return F.when(F.count(c) >= 2, F.try_divide(F.avg(c), F.stddev_samp(c)))

    of_ranks = [F.avg("rank_ic").alias("mean_rank_ic"), ratio("rank_ic").alias("rank_ic_ir")] if "rank_ic" in ic.columns else []
    return ic.groupBy("factor", "return_col").agg(
        F.count("ic").alias("periods"), F.avg("ic").alias("mean_ic"), ratio("ic").alias("ic_ir"), *of_ranks)


def quantile_returns(df: DataFrame, factors: list[str], returns: list[str], quantiles: int, bound: int,
                     plain_rows: int = R.PLAIN_ROWS) -> DataFrame:
    """Return statistics per date and factor quantile; equal factor values are ordered by ts_code."""
    keys = ["signal_date", "factor", "return_col"]
    group = [*keys, "quantile"]
    basics = [F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_return"), F.avg(F.when(F.col("y") > 0, 1.0).otherwise(0.0)).alias("hit_rate")]
    if bound <= plain_rows:
        r = _numbered_pairs(df, factors, returns).withColumn("_q", F.least(F.lit(quantiles), "_u", "_n")).where("_q >= 2")
        return r.withColumn("quantile", _bucket()).groupBy(*group).agg(*basics, F.median("y").alias("median_return"))
    v = saved(long_pairs(df, factors, returns, ["signal_date", "ts_code"]).where("x is not null and y is not null"), "pairs")
    size = v.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_distinct("x").alias("_u"))
    size = size.withColumn("_q", F.least(F.lit(quantiles).cast("long"), "_u", "_n")).where("_q >= 2")
    r = R.row_rank(v, keys, "x", "ts_code", "_r", bound, plain_rows=plain_rows).join(size, keys)
    b = r.withColumn("quantile", _bucket())
    return b.groupBy(*group).agg(*basics).join(R.percentiles(b.select(*group, "y"), group, "y", {"median_return": 0.5}, bound, plain_rows), group)


def _numbered_pairs(df: DataFrame, factors: list[str], returns: list[str]) -> DataFrame:
    """Pairs with both sides present: y, row number by (x, ts_code) on the date (`_r`), pairs (`_n`) and distinct x (`_u`) of the date.

    Each row moves once, by date, and is numbered before the unpivot to pairs: one sort a factor serves all its pairs, their sizes and both aggregations."""
    xs, ys = {f: f"_x{i}" for i, f in enumerate(factors)}, {r: f"_y{i}" for i, r in enumerate(returns)}
    df = df.select("signal_date", "ts_code", *[F.col(n).cast("double").alias(c) for n, c in (xs | ys).items()])
    day = Window.partitionBy("signal_date")
    for x in xs.values():
        has = {y: F.col(x).isNotNull() & F.col(y).isNotNull() for y in ys.values()}
        pairs = {y: F.count(F.when(h, 1)) for y, h in has.items()}
        upto = day.orderBy(x, "ts_code").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        df = df.select("*", *[p.over(upto).alias(f"_r{x}{y}") for y, p in pairs.items()])
        lower, same = (day.orderBy(x).rangeBetween(a, Window.currentRow) for a in (Window.unboundedPreceding, Window.currentRow))
        first = {y: has[y] & (F.col(f"_r{x}{y}") == p.over(lower) - p.over(same) + 1) for y, p in pairs.items()}  # of the pairs with this x
        df = df.select("*", *[h.alias(f"_f{x}{y}") for y, h in first.items()])
        df = df.select("*", *[p.over(day).alias(f"_n{x}{y}") for y, p in pairs.items()], *[F.count_if(f"_f{x}{y}").over(day).alias(f"_u{x}{y}") for y in ys.values()])

    def pair(f: str, r: str) -> Column:
        x, y = xs[f], ys[r]
        item = F.struct(F.lit(f).alias("factor"), F.lit(r).alias("return_col"), F.col(y).alias("y"), *[F.col(f"{k}{x}{y}").alias(k) for k in ("_r", "_n", "_u")])
        return F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), item)

    each = F.explode(F.array(*[pair(f, r) for f in factors for r in returns]))
    return df.select("signal_date", each.alias("_p")).where("_p IS NOT NULL").select("signal_date", "_p.*")


def _bucket() -> Column:
    return F.greatest(F.lit(1), F.ceil((F.col("_r") - 1) * F.col("_q") / (F.col("_n") - 1))).cast("int")


def top_n_returns(df: DataFrame, factors: list[str], returns: list[str], n: int) -> DataFrame:
    """Return statistics of the n highest-scored instruments per date."""
    f = F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("double").alias("x")) for c in factors]))
    long = df.select("signal_date", "ts_code", *returns, f.alias("_f")).select("signal_date", "ts_code", *returns, "_f.*")
    every = long.select("signal_date", "factor").distinct()
    top = R.top_n(long.where("x is not null"), ["signal_date", "factor"], n, F.desc("x"), F.col("ts_code"))
    top = every.join(top, ["signal_date", "factor"], "left")
    r = F.explode(F.array(*[F.struct(F.lit(c).alias("return_col"), F.col(c).alias("y")) for c in returns]))
    return (
        top.select("signal_date", "factor", "ts_code", r.alias("_r")).select("signal_date", "factor", "ts_code", "_r.*")
        .groupBy("signal_date", "factor", "return_col")
        .agg(F.count("ts_code").alias("selected"), F.avg("y").alias("mean_return"), F.median("y").alias("median_return"),
             F.avg(F.when(F.col("y").isNotNull(), F.when(F.col("y") > 0, 1.0).otherwise(0.0))).alias("hit_rate"))
        .withColumn("top_n", F.lit(n))
    )


def robustness(df: DataFrame, factors: list[str], returns: list[str], group_cols: list[str], bound: int,
               plain_rows: int = R.PLAIN_ROWS, ranks: bool = True) -> DataFrame:
    """Size, mean return and correlations per value of each grouping column, in one pass over all of them; without `ranks` no rank_ic."""
    g = F.explode(F.array(*[F.struct(F.lit(c).alias("group_col"), F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias("group_value"))
                            for c in group_cols]))
    long = df.select(*factors, *returns, g.alias("_g")).select(*factors, *returns, "_g.*")
    return ic_by_date(long, factors, returns, bound, by=("group_col", "group_value"), plain_rows=plain_rows, ranks=ranks)


@dataclass(frozen=True)
class FactorStudy:
    ic_by_date: DataFrame
    ic_summary: DataFrame
    quantile_returns: DataFrame
    top_n_returns: DataFrame
    robustness: DataFrame


def evaluate_factors(labels: DataFrame, factors: list[str], returns: list[str], bound: int, pooled_bound: int,
                     quantiles: int = 5, top: int = 10,
                     group_cols: tuple[str, ...] = ("industry", "list_type", "market", "exchange"), pooled_ranks: bool = True,
                     date_ranks: bool = True) -> FactorStudy:
    """All five result frames; `bound` limits a date's cross-section, `pooled_bound` the whole label table.

    Ranks over the whole label table are made before the frame is read, so a caller that doesn't read the robustness frame's rank_ic
    can leave it out (`pooled_ranks`); ranks on a date move every row, so a caller that reads no rank_ic at all can leave them out too (`date_ranks`)."""
    factors = [f for f in factors if f in labels.columns]
    returns = [r for r in returns if r in labels.columns]
    ic = ic_by_date(labels, factors, returns, bound, ranks=date_ranks)
    return FactorStudy(
        ic, summarize_ic(ic), quantile_returns(labels, factors, returns, quantiles, bound),
        top_n_returns(labels, factors, returns, top),
        robustness(labels, factors, returns, [g for g in group_cols if g in labels.columns], pooled_bound, ranks=pooled_ranks),
    )


def panel_ic(panel: DataFrame, features: list[str], returns: dict[int, str], bound: int, min_names: int = 30,
             min_dates: int = 20, plain_rows: int = R.PLAIN_ROWS) -> DataFrame:
    """Mean, deviation and t of daily correlations per feature and horizon over complete rows.

    Up to `plain_rows` instruments the complete rows are written, each moves once by date, and all its columns are ranked before the unpivot of the
    features, so sorts hold a row once and not once a feature; the daily aggregation stays in that stage.
    Larger cross-sections are ranked by running totals over distinct values, from one written copy of the complete rows.
    """
    ys = list(returns.values())
    cols = [*features, *ys]
    # plain references: renaming each column would multiply the optimizer's constraint set
    full = panel.select("trade_date", *cols).dropna("any", subset=cols)
    ry = [f"_r_{y}" for y in ys]
    if bound <= plain_rows:
        # written once: without the panel's lineage the windows plan in seconds; all values are there, so rows below and rows not above are enough
        full = saved(full, "complete")
        over = {c: Window.partitionBy("trade_date").orderBy(c) for c in cols}
        ranked = full.select("*", *[((F.rank().over(w) + F.count(F.lit(1)).over(w)) / 2.0).alias(f"_r_{c}") for c, w in over.items()])
        item = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x"), F.col(f"_r_{f}").alias("rx")) for f in features]))
        long = ranked.select("trade_date", *ys, *ry, item.alias("_i")).select("trade_date", *ys, *ry, "_i.*")
    else:
        ranked = R.average_ranks(full, ["trade_date"], dict(zip(ys, ry)), bound, plain_rows=plain_rows)
        item = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in features]))
        long = ranked.select("trade_date", *ys, *ry, item.alias("_i")).select("trade_date", *ys, *ry, "_i.*")
        long = R.average_rank(long, ["trade_date", "feature"], "x", "rx", bound, plain_rows=plain_rows)
    daily = long.groupBy("trade_date", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sx"),
        *[guarded_corr("x", y).alias(f"p_{h}") for h, y in returns.items()],
        *[guarded_corr("rx", f"_r_{y}").alias(f"r_{h}") for h, y in returns.items()],
    ).where((F.col("n") >= min_names) & (F.col("sx") >= 1e-12))
    pairs = F.explode(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"p_{h}").alias("p"), F.col(f"r_{h}").alias("r")) for h in returns]))
    per = daily.select("feature", pairs.alias("_p")).select("feature", "_p.*")

    def t_stat(c: str) -> Column:
        t = F.try_divide(F.avg(c), F.stddev_samp(c) / F.sqrt(F.count(c)))
        return F.round(F.when(F.stddev_samp(c) > 0, t).otherwise(0.0), 2)

    return per.groupBy("feature", "horizon").agg(
        F.round(F.avg("p"), 6).alias("mean_pearson_ic"), F.round(F.stddev_samp("p"), 6).alias("std_pearson_ic"),
        t_stat("p").alias("t_stat_pearson"),
        F.round(F.avg("r"), 6).alias("mean_rank_ic"), F.round(F.stddev_samp("r"), 6).alias("std_rank_ic"),
        t_stat("r").alias("t_stat_rank"), F.count("p").alias("n_dates"),
    ).where(F.col("n_dates") >= min_dates)


def best_horizon(ic: DataFrame) -> DataFrame:
    """The horizon with the largest absolute mean rank IC per feature; the shorter one on ties."""
    w = Window.partitionBy("feature").orderBy(F.abs("mean_rank_ic").desc(), F.asc("horizon"))
    return ic.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def strength(c: str) -> Column:
    a = F.abs(F.col(c))
    return F.when(a > 0.02, "HIGH").when(a > 0.01, "MEDIUM").otherwise("LOW")


# Scored components that ablation removes; the first two count against a name.
ABLATION_PENALTIES = ("toplist_recency_score", "audit_risk_score")
ABLATION_REWARDS = ("theme_strength_score", "positive_finding_count", "source_quality_score", "catalyst_diversity")


def decile_metrics(df: DataFrame, group: list[str], score: str, ret: str, bound: int,
                   plain_rows: int = R.PLAIN_ROWS) -> DataFrame:
    """Hit rate, median, spread against the rest and tenth percentile of the top score decile."""
    v = df.where(F.col(score).isNotNull() & F.col(ret).isNotNull())
    if bound > plain_rows:
        v = saved(v, "scored")
    cut = R.percentiles(v, group, score, {"cutoff": 0.9}, bound, plain_rows)
    j = v.join(cut, group)
    top = j.where(F.col(score) >= F.col("cutoff"))
    y = F.col(ret)
    upper = F.col(score) >= F.col("cutoff")
    base = j.groupBy(*group).agg(
        F.avg(F.when(upper, F.when(y > 0, 1.0).otherwise(0.0))).alias("top_decile_hit_rate"),
        (F.avg(F.when(upper, y)) - F.avg(F.when(~upper, y))).alias("top_decile_spread"),
    )
    q = R.percentiles(top, group, ret, {"top_decile_median_return": 0.5, "max_drawdown_proxy_p10": 0.1}, bound, plain_rows)
    return base.join(q, group)


def ablation(df: DataFrame, score: str, ret: str, bound: int, plain_rows: int = R.PLAIN_ROWS) -> DataFrame:
    """Decile metrics with the score as it is and with five points per unit of each component taken out."""
    parts = [F.struct(F.lit("baseline").alias("scenario"), F.col(score).alias("_score"))]
    for sign, names in ((5.0, ABLATION_PENALTIES), (-5.0, ABLATION_REWARDS)):
        for n in names:
            if n in df.columns:
                parts.append(F.struct(F.lit(f"drop_{n}").alias("scenario"),
                                      (F.col(score) + F.coalesce(F.col(n), F.lit(0.0)) * sign).alias("_score")))
    long = df.select(ret, F.explode(F.array(*parts)).alias("_s")).select(ret, "_s.*")
    return decile_metrics(long, ["scenario"], "_score", ret, bound, plain_rows)


def promotion_gates(metrics: DataFrame) -> DataFrame:
    gates = {
        "improve_top_decile_10d": F.coalesce(F.col("top_decile_median_return"), F.lit(-1.0)) > 0,
        "hit_rate_minimum": F.coalesce(F.col("top_decile_hit_rate"), F.lit(0.0)) >= 0.52,
        "spread_positive": F.coalesce(F.col("top_decile_spread"), F.lit(-1.0)) > 0,
    }
    out = metrics.select("*", *[c.alias(n) for n, c in gates.items()])
    return out.withColumn("pass", F.col("improve_top_decile_10d") & F.col("hit_rate_minimum") & F.col("spread_positive"))
