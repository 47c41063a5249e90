"""Forward-return labels, weekly cohorts and sellable exits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tickloom.operators import asof
from tickloom.operators.ranking import top_n
from tickloom.operators.timeseries import by_date

LABEL_HORIZONS = (1, 3, 5, 10, 20, 40)

# Daily price limits by board.
LIMIT_WIDE, LIMIT_GROWTH, LIMIT_MAIN = 0.30, 0.20, 0.10
LIMIT_TOLERANCE = 1e-6


def limit_pct(code: Column, exchange: Column | None = None) -> Column:
    """Daily price limit by exchange and code prefix."""
    wide = code.rlike(r"^(8|4|920)")
    if exchange is not None:
        wide = F.upper(F.coalesce(exchange, F.lit(""))).isin("BSE", "BJSE") | wide
    return F.when(wide, LIMIT_WIDE).when(code.rlike(r"^(300|301|688|689)"), LIMIT_GROWTH).otherwise(LIMIT_MAIN)


def at_limit_up(open_: Column, base: Column, pct: Column) -> Column:
    return F.coalesce((base > 0) & (open_ >= base * (1 + pct) - LIMIT_TOLERANCE), F.lit(False))


def at_limit_down(open_: Column, base: Column, pct: Column) -> Column:
    return F.coalesce((base > 0) & (open_ <= base * (1 - pct) + LIMIT_TOLERANCE), F.lit(False))


def with_exits(bars: DataFrame, horizons=LABEL_HORIZONS) -> DataFrame:
    """Bars with their limit base and the bar h rows later, for every horizon."""
    w = by_date()
    base = F.coalesce(F.col("pre_close"), F.lag("close").over(w))
    return bars.select(
        "ts_code", "trade_date", "open", "close", base.alias("limit_base"),
        *[F.lead("trade_date", h).over(w).alias(f"exit_date_{h}d") for h in horizons],
        *[F.lead("close", h).over(w).alias(f"exit_close_{h}d") for h in horizons],
    )


def forward_labels(bars: DataFrame, signals: DataFrame, horizons=LABEL_HORIZONS) -> DataFrame:
    """Entry at the first open after the signal date, exits h bars later; other signal columns pass through."""
    moves = with_exits(bars, horizons).withColumn("entry_date", F.col("trade_date")).withColumn("entry_open", F.col("open"))
    payload = ["entry_date", "entry_open", "limit_base",
               *[f"exit_date_{h}d" for h in horizons], *[f"exit_close_{h}d" for h in horizons]]
    j = asof.first_bar_after(moves, signals, "signal_date", payload, has_bars="_known")
    return _labelled(j, [n for n in signals.columns if n != "snapshot_created_at"], horizons)


def with_next_bar(bars: DataFrame, horizons=LABEL_HORIZONS) -> DataFrame:
    """Bars with what forward_labels finds for a signal on each of them: the entry is the next bar. Nothing is joined, as every bar of an instrument is there."""
    w = by_date()
    moves = bars.withColumn("limit_base", F.coalesce(F.col("pre_close"), F.lag("close").over(w)))
    return moves.select(
        *bars.columns, F.lead("trade_date").over(w).alias("entry_date"), F.lead("open").over(w).alias("entry_open"), F.lead("limit_base").over(w).alias("limit_base"),
        *[F.lead("trade_date", 1 + h).over(w).alias(f"exit_date_{h}d") for h in horizons],
        *[F.lead("close", 1 + h).over(w).alias(f"exit_close_{h}d") for h in horizons], F.lit(True).alias("_known"))


def next_bar_columns(horizons=LABEL_HORIZONS) -> list[str]:
    """The columns that with_next_bar adds."""
    return ["entry_date", "entry_open", "limit_base", *[f"exit_date_{h}d" for h in horizons], *[f"exit_close_{h}d" for h in horizons], "_known"]


def labels_on_bars(signals: DataFrame, horizons=LABEL_HORIZONS) -> DataFrame:
    """forward_labels of signals that carry the columns of with_next_bar."""
    return _labelled(signals, [n for n in signals.columns if n not in next_bar_columns(horizons)], horizons)


def _labelled(j: DataFrame, passed: list[str], horizons) -> DataFrame:
    """Status, flags and returns from the entry and the exits of each signal."""
    c = F.col
    pct = limit_pct(c("ts_code"))
    good = c("entry_open").isNotNull() & (c("entry_open") > 0)
    up = at_limit_up(c("entry_open"), c("limit_base"), pct)
    status = (
        F.when(~F.coalesce(c("_known"), F.lit(False)), "missing_price_history")
        .when(c("entry_date").isNull(), "missing_entry").when(~good, "bad_entry_price").otherwise("ok")
    )
    exits = []
    for h in horizons:
        exits += [
            F.when(good, c(f"exit_date_{h}d")).alias(f"exit_date_{h}d"),
            F.when(good, c(f"exit_close_{h}d")).alias(f"exit_close_{h}d"),
            F.when(good, c(f"exit_close_{h}d") / c("entry_open") - 1).alias(f"ret_{h}d"),
        ]
    return j.select(
        *passed, "entry_date", "entry_open", status.alias("label_status"),
        (c("entry_date").isNotNull() & up).alias("limit_up_at_entry"),
        (c("entry_date").isNotNull() & at_limit_down(c("entry_open"), c("limit_base"), pct)).alias("limit_down_at_entry"),
        (good & ~up).alias("tradable_buy"), *exits,
    )


def anchor_friday(d: Column) -> Column:
    """The Friday of a date's week."""
    return F.date_add(F.trunc(d, "week"), 4)


def cohort_returns(labels: DataFrame, score: str, top: int, ret: str, cost_bps: float) -> DataFrame:
    """Per week: tradable top-n of the last signal date, equal weight, net of costs, with compounded value."""
    ok = labels.where(F.col("tradable_buy") & F.col(ret).isNotNull() & F.col(score).isNotNull())
    week = F.trunc("signal_date", "week")
    lasts = ok.groupBy(week.alias("week")).agg(F.max("signal_date").alias("signal_date"))
    picked = top_n(ok.join(lasts, "signal_date"), ["week"], top, F.desc(score), F.col("ts_code"))
    per = picked.groupBy("week").agg(F.count(F.lit(1)).alias("held"), F.avg(ret).alias("gross"))
    per = per.withColumn("net", F.col("gross") - cost_bps / 10000.0)
    w = Window.orderBy("week").rowsBetween(Window.unboundedPreceding, 0)  # one row per week: the calendar bounds it
    return per.withColumn("nav", F.exp(F.sum(F.log1p("net")).over(w)))


def cohort_turnover(labels: DataFrame, score: str, top: int) -> DataFrame:
    """Share of names replaced from one weekly cohort to the next."""
    ok = labels.where(F.col("tradable_buy") & F.col(score).isNotNull())
    lasts = ok.groupBy(F.trunc("signal_date", "week").alias("week")).agg(F.max("signal_date").alias("signal_date"))
    picked = top_n(ok.join(lasts, "signal_date"), ["week"], top, F.desc(score), F.col("ts_code")).select("week", "ts_code")
    weeks = picked.select("week").distinct()
    order = weeks.select("week", F.lead("week").over(Window.orderBy("week")).alias("next_week"))  # calendar-sized
    before = picked.join(order, "week").where("next_week is not null").select(
        F.col("next_week").alias("week"), "ts_code", F.lit(1).alias("was"))
    both = picked.withColumn("now", F.lit(1)).join(before, ["week", "ts_code"], "full_outer")
    per = both.groupBy("week").agg(
        F.sum(F.when(F.col("now").isNotNull() & F.col("was").isNull(), 1).otherwise(0)).alias("bought"),
        F.sum(F.when(F.col("now").isNull(), 1).otherwise(0)).alias("sold"),
        F.count("now").alias("held"),
    )
    return per.withColumn("turnover", F.col("bought") / F.col("held"))


def first_sellable(bars: DataFrame, planned: DataFrame, date_col: str) -> DataFrame:
    """First bar on or after a planned exit date that does not open at the lower limit."""
    ready = with_exits(bars, ()).where(
        ~at_limit_down(F.col("open"), F.col("limit_base"), limit_pct(F.col("ts_code"))))
    moved = ready.withColumn("sell_date", F.col("trade_date")).withColumn("sell_open", F.col("open"))
    before = planned.withColumn("_eve", F.date_sub(F.col(date_col), 1))
    return asof.first_bar_after(moved, before, "_eve", ["sell_date", "sell_open"]).drop("_eve")
