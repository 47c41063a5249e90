"""Capital flow: listing events, seats, industry heat, sentiment and breadth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tickloom.functions.scores import half_up
from tickloom.operators.ranking import top_n

NORTH_SEATS, INST_SEAT = "沪股通|深股通", "机构专用"  # fixed values: seat names


def recent(df: DataFrame, as_of: str, days: int) -> DataFrame:
    """Rows of the last `days` days up to a date; a partition filter when stored by trade_date."""
    return df.where((F.col("trade_date") > F.date_sub(F.lit(as_of).cast("date"), days)) & (F.col("trade_date") <= F.lit(as_of).cast("date")))


def seat_class(c: str) -> Column:
    return F.when(F.col(c).rlike(NORTH_SEATS), "north").when(F.col(c) == INST_SEAT, "inst").otherwise("hot_money")


def hit_counts(top_list: DataFrame) -> DataFrame:
    h = top_list.groupBy("ts_code").agg(F.count(F.lit(1)).alias("toplist_hit_count"))
    return h.withColumn("toplist_recency_score", F.least(F.lit(1.0), F.col("toplist_hit_count") / 5.0))


def industry_trend(listed: DataFrame) -> DataFrame:
    """Net inflow of the second half of an industry's events against the first, halves by event order.

    Events are first counted per day; only the day that straddles the middle is looked
    at row by row, so an industry with a third of all events is never sorted in one task.
    """
    daily = listed.groupBy("industry", "trade_date").agg(F.count(F.lit(1)).alias("c"), F.sum("net_amount").alias("s"))
    w = Window.partitionBy("industry").orderBy("trade_date")
    d = daily.select("*", (F.sum("c").over(w) - F.col("c")).alias("before"), F.sum("c").over(Window.partitionBy("industry")).alias("n"))
    d = d.withColumn("half", F.floor(F.col("n") / 2))
    whole_days = d.groupBy("industry").agg(
        F.sum(F.when(F.col("before") + F.col("c") <= F.col("half"), F.col("s")).otherwise(0.0)).alias("f0"), F.sum("s").alias("total"))
    split = d.where((F.col("before") < F.col("half")) & (F.col("before") + F.col("c") > F.col("half"))).select(
        "industry", "trade_date", (F.col("half") - F.col("before")).alias("take"))
    # the event at position `take` of that day, found from coarse to fine: blocks of 4096 ids, then rows of one block
    day_rows = listed.join(split, ["industry", "trade_date"]).withColumn("b", F.floor(F.col("event_id") / 4096))
    blocks = day_rows.groupBy("industry", "b").agg(F.count(F.lit(1)).alias("bc"), F.sum("net_amount").alias("bs"), F.max("take").alias("take"))
    wb = Window.partitionBy("industry").orderBy("b")
    blocks = blocks.withColumn("bb", F.sum("bc").over(wb) - F.col("bc"))
    full_blocks = blocks.groupBy("industry").agg(F.sum(F.when(F.col("bb") + F.col("bc") <= F.col("take"), F.col("bs")).otherwise(0.0)).alias("f1"))
    edge = blocks.where((F.col("bb") < F.col("take")) & (F.col("bb") + F.col("bc") > F.col("take"))).select("industry", "b", (F.col("take") - F.col("bb")).alias("left"))
    inside = day_rows.join(edge, ["industry", "b"]).withColumn("r", F.row_number().over(Window.partitionBy("industry").orderBy("event_id")))
    rest = inside.where(F.col("r") <= F.col("left")).groupBy("industry").agg(F.sum("net_amount").alias("f2"))
    j = whole_days.join(full_blocks, "industry", "left").join(rest, "industry", "left")
    first = F.col("f0") + F.coalesce("f1", F.lit(0.0)) + F.coalesce("f2", F.lit(0.0))
    second = F.col("total") - first
    return j.select("industry", first.alias("first_half"), second.alias("second_half"),
                    F.when(second > first * 1.2, "accelerating").when(second < first * 0.8, "declining").otherwise("stable").alias("trend"))


def industry_heat(top_list: DataFrame, top_inst: DataFrame, basic: DataFrame) -> DataFrame:
    """Hits, net buying, leading names, seat mix and trend per industry."""
    listed = top_list.join(basic.select("ts_code", "industry", "name"), "ts_code", "left").where("industry is not null")
    per_name = listed.groupBy("industry", "ts_code").agg(F.count(F.lit(1)).alias("h"), F.sum("net_amount").alias("net"), F.first("name").alias("name"))
    base = per_name.groupBy("industry").agg(F.sum("h").alias("hit_count"), F.sum("net").alias("net_buy"))
    top = top_n(per_name, ["industry"], 5, F.desc("net"), F.col("ts_code"))
    names = top.groupBy("industry").agg(F.array_sort(F.collect_list(F.struct((-F.col("net")).alias("k"), "ts_code", F.coalesce("name", "ts_code").alias("name")))).alias("t"))
    names = names.select("industry", F.col("t.name").alias("hot_stocks"))
    # seats of names that were listed: one industry per name, so a plain join on the name
    seats = top_inst.groupBy("ts_code").agg(
        F.sum("buy").alias("buy"), *[F.sum(F.when(seat_class("exalter") == k, F.col("buy")).otherwise(0.0)).alias(k) for k in ("north", "inst")])
    mix = per_name.select("industry", "ts_code").join(seats, "ts_code").groupBy("industry").agg(
        F.try_divide(F.sum("north"), F.sum("buy")).alias("north"), F.try_divide(F.sum("inst"), F.sum("buy")).alias("inst"))
    j = base.join(names, "industry", "left").join(mix, "industry", "left").join(industry_trend(listed).select("industry", "trend"), "industry", "left")
    z = F.lit(0.0)
    return j.withColumn("north", F.coalesce("north", z)).withColumn("inst", F.coalesce("inst", z)).withColumn(
        "hot_money", F.when(F.col("north") + F.col("inst") > 0, 1 - F.col("north") - F.col("inst")).otherwise(0.0))


def theme_status(web: DataFrame, capital: DataFrame) -> DataFrame:
    """Themes known from the web, from capital flow, or both."""
    j = web.withColumn("_w", F.lit(1)).join(capital.withColumn("_c", F.lit(1)), "name", "full_outer")
    status = (F.when(F.col("_w").isNotNull() & F.col("_c").isNotNull(), "confirmed").when(F.col("_c").isNotNull(), "capital_only")
              .when(F.coalesce(F.col("support"), F.lit(0)) >= 2, "web_only").otherwise("weak"))
    return j.withColumn("validation_status", status).drop("_w", "_c")


def market_sentiment(top_list: DataFrame, top_inst: DataFrame, least_amount: float = 1e8) -> DataFrame:
    """One row: capital flow, breadth and theme strength from 0 to 1, the score of their weighted sum from 0 to 100, and its label.

    A net sum counts against the sum of amounts, `least_amount` at least, cut to -1 .. 1. Without listings the score is 50."""
    def part(net: Column, whole: Column) -> Column:
        share = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), net / F.greatest(F.abs(whole), F.lit(least_amount))))
        return (share + 1) / 2

    f = top_list.agg(F.sum("net_amount").alias("net"), F.sum("amount").alias("amount"), F.count_distinct("ts_code").alias("names"), F.count(F.lit(1)).alias("rows"))
    s = top_inst.agg(F.sum("net_buy").alias("seat"), (F.sum("buy") + F.sum("sell")).alias("seat_amount"))
    c = F.col
    j = f.crossJoin(s)  # one row each
    j = j.select("rows", F.when(c("amount") == 0, 0.5).otherwise(part(c("net"), c("amount"))).alias("flow"), F.least(F.lit(1.0), c("names") / 100).alias("breadth"),
                 F.coalesce(part(c("seat"), c("seat_amount")), F.lit(0.5)).alias("theme"))
    x = F.floor(F.round(c("flow") * 0.4 + c("breadth") * 0.3 + c("theme") * 0.3, 2) * 100).cast("int")
    score = F.when(c("rows") == 0, 50).otherwise(x)
    label = F.when(c("rows") == 0, "NO DATA").when(x >= 70, "BULLISH").when(x >= 55, "NEUTRAL-BULLISH").when(x >= 45, "NEUTRAL").when(x >= 30, "NEUTRAL-BEARISH").otherwise("BEARISH")
    return j.select(score.alias("score"), label.alias("label"), *[F.round(n, 2).alias(a) for n, a in (("flow", "capital_flow"), ("breadth", "breadth"), ("theme", "theme_strength"))])


def breadth(rows: DataFrame) -> DataFrame:
    """One row a date: advancing to declining names, shares above two averages, and of rising volume, in percent.

    rows: trade_date, close, sma20, sma60, return_5d, vol_ratio_5_20."""
    c = F.col
    share = lambda cond: half_up(F.count_if(cond) / F.count(F.lit(1)) * 100, 1)
    falling = F.count_if(c("return_5d") < 0)
    return rows.groupBy("trade_date").agg(
        F.when(falling > 0, half_up(F.count_if(c("return_5d") > 0) / falling, 2)).otherwise(1.0).alias("advance_decline_ratio"),
        share(c("close") > c("sma20")).alias("pct_above_ma20"), share(c("close") > c("sma60")).alias("pct_above_ma60"), share(c("vol_ratio_5_20") > 1).alias("volume_breadth"))


def latest_breadth(rows: DataFrame) -> DataFrame:
    """breadth of the latest date."""
    return breadth(rows.join(rows.agg(F.max("trade_date").alias("trade_date")), "trade_date", "left_semi"))


CARD_HORIZONS = (5, 20, 60, 120)


def factor_cards(rows: DataFrame) -> DataFrame:
    """Per instrument and horizon: the 5-day return at the far end of the horizon (or the oldest bar of it), and the latest bar's indicators, rounded.

    rows: ts_code, trade_date, close, return_5d, rsi14, adx, sma20, sma60, atr14, bb_width."""
    c = F.col
    w = Window.partitionBy("ts_code").orderBy(F.desc("trade_date"))
    d = rows.select("ts_code", "return_5d", "rsi14", "adx", (c("close") / c("sma20") - 1).alias("dist_ma20"), (c("close") / c("sma60") - 1).alias("dist_ma60"),
                    (c("atr14") / c("close")).alias("atr_pct"), c("bb_width").alias("bbw"), F.row_number().over(w).alias("_k")).where(c("_k") <= max(CARD_HORIZONS))
    digits = {"rsi14": 1, "adx": 1, "dist_ma20": 2, "dist_ma60": 2, "atr_pct": 2, "bbw": 2}
    far = [F.struct(F.lit(h).alias("horizon"), F.round(F.max_by(F.struct("return_5d"), F.when(c("_k") <= h, c("_k")))["return_5d"], 2).alias("ret")) for h in CARD_HORIZONS]
    per = d.groupBy("ts_code").agg(F.array(*far).alias("_far"), *[F.round(F.max(F.when(c("_k") == 1, c(n))), k).alias(n) for n, k in digits.items()])
    return per.select("ts_code", F.explode("_far").alias("_f"), *digits).select("ts_code", "_f.*", *digits)
