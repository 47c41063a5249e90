"""Model tables of the engine as views over the given star-schema tables.

Bars are unique per (instrument, week), so every per-instrument window below is
bounded by the calendar. The aggregation that builds them combines on the map
side; a supplier holding a third of all lines therefore never meets one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

# Fixed values of the adapter: board prefix and exchange by supplier key modulo 5.
BOARD_PREFIX = ["600", "000", "300", "688", "830"]
BOARD_EXCHANGE = ["SSE", "SZSE", "SZSE", "SSE", "BSE"]
BOARD_SUFFIX = [".SH", ".SZ", ".SZ", ".SH", ".BJ"]
BOARD_MARKET = ["主板", "主板", "创业板", "科创板", "北交所"]
FUND_EPOCH_YEAR = 1995


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by_board(key: Column, values: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), ((key % 5) + 1).cast("int"))


def ts_code_of(key: Column) -> Column:
    """Instrument code of a supplier key; at least six digits, longer for large keys."""
    digits = key.cast("string")
    padded = F.lpad(digits, F.greatest(F.lit(3), F.length(digits)), F.lit("0"))
    return F.concat(_by_board(key, BOARD_PREFIX), padded, _by_board(key, BOARD_SUFFIX))


def _line_order(spark: SparkSession, sf_dir: str, day: Column) -> Column:
    """(day of the week, order, line, part) of a line in one number, so min_by and max_by stay in the hash aggregate.

    A long where the largest keys leave room for it, else a 38-digit number, which costs several times as much a line;
    keys beyond its digits are an error, not another order."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    ends = table(spark, sf_dir, "lineitem").agg(*[f(k) for k in keys for f in (F.min, F.max)]).first()  # three columns, one row
    low, high = [v or 0 for v in ends[::2]], [v or 0 for v in ends[1::2]]
    return packed(day, keys, low, high)


def packed(day: Column, keys: list[str], low: list[int], high: list[int]) -> Column:
    """day (0 to 6) and three keys, whose least and largest values are given, as one number in their order."""
    if min(low) >= 0 and 7 * (high[0] + 1) * (high[1] + 1) * (high[2] + 1) < 2**63:
        out = day.cast("long")
        for k, most in zip(keys, high):
            out = out * F.lit(most + 1).cast("long") + F.col(k)
        return out
    order, line, part = keys
    digits = F.concat(day.cast("string"), F.lpad(order, 18, "0"), F.lpad(line, 5, "0"), F.lpad(part, 14, "0"))
    fits = (F.col(order) < 10**18) & (F.col(line) < 10**5) & (F.col(part) < 10**14)
    return F.when(fits, digits.cast("decimal(38,0)")).otherwise(F.raise_error(F.lit("a key of lineitem has more digits than the order of lines keeps")))


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly price bars: open/close by (ship date, order, line), prices on a log scale around 10."""
    line = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        F.col("l_shipdate").cast("date").alias("d"),
    ).where("l_quantity > 0 and l_extendedprice > 0")
    week = F.trunc("d", "week")
    seq = _line_order(spark, sf_dir, F.datediff("d", week))
    price = F.round(10 + 0.5 * F.log(F.col("l_extendedprice") / F.col("l_quantity") / 2000), 10)
    out = (
        line.select("l_suppkey", week.alias("trade_date"), (F.col("l_quantity") * (1 + F.col("l_discount"))).alias("q"),
                    "l_extendedprice", seq.alias("seq"), price.alias("p"))
        .groupBy("l_suppkey", "trade_date")
        .agg(
            F.min_by("p", "seq").alias("open"),
            F.max("p").alias("high"),
            F.min("p").alias("low"),
            F.max_by("p", "seq").alias("close"),
            F.round(F.sum("q"), 2).alias("vol"),
            F.round(F.sum("l_extendedprice"), 2).alias("amount"),
        )
    )
    # the second and last exchange: everything windowed by ts_code reuses it
    w = Window.partitionBy("ts_code").orderBy("trade_date")
    keyed = out.select(
        ts_code_of(F.col("l_suppkey")).alias("ts_code"), "trade_date", "open", "high", "low", "close", "vol", "amount",
        (F.col("vol") / 25.0).alias("turnover_rate"), F.col("l_suppkey").alias("instrument_key"),
    )
    return keyed.withColumn("pre_close", F.lag("close").over(w))


def _valuation_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bal, key = F.col("s_acctbal"), F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        key.alias("instrument_key"),
        ((bal + 1000) * 50).alias("total_share"),
        F.when(bal > 0, bal / 1000).alias("eps_base"),
        (2 + key % 7).cast("double").alias("bps_base"),
        (0.5 + (key % 11) * 0.4).alias("sps_base"),
    )


def with_valuation(spark: SparkSession, sf_dir: str, bar_rows: DataFrame) -> DataFrame:
    """Adds total_mv (10k CNY), pe, pe_ttm, pb, ps, ps_ttm to bar rows; the join side is chosen by size."""
    v = bar_rows.join(_valuation_inputs(spark, sf_dir), "instrument_key", "left")
    c = F.col("close")
    return v.select(
        *bar_rows.columns,
        (c * F.col("total_share")).alias("total_mv"),
        (c / F.col("eps_base")).alias("pe"),
        (c / F.col("eps_base") * 0.95).alias("pe_ttm"),
        (c / F.col("bps_base")).alias("pb"),
        (c / F.col("sps_base")).alias("ps"),
        (c / F.col("sps_base") * 1.05).alias("ps_ttm"),
    )


def stock_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    code = ts_code_of(key)
    return (
        s.join(n, s.s_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        .select(
            code.alias("ts_code"),
            F.split(code, r"\.")[0].alias("symbol"),
            F.when(key % 17 == 3, F.concat(F.lit("ST"), F.col("s_name"))).otherwise(F.col("s_name")).alias("name"),
            F.col("r_name").alias("area"),
            F.col("n_name").alias("industry"),
            _by_board(key, BOARD_MARKET).alias("market"),
            _by_board(key, BOARD_EXCHANGE).alias("exchange"),
            F.when(key % 23 == 7, "D").otherwise("L").alias("list_status"),
            F.date_add(F.lit("1990-01-01").cast("date"), (key % 1500).cast("int")).alias("list_date"),
            key.alias("instrument_key"),
        )
    )


def stock_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, bal = F.col("s_suppkey"), F.col("s_acctbal")
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(
        ts_code_of(key).alias("ts_code"),
        F.concat(F.lit("chair "), F.col("s_name")).alias("chairman"),
        F.round(bal + 1000, 2).alias("reg_capital"),
        F.col("n_name").alias("province"),
        F.concat(F.col("n_name"), F.lit(" trading")).alias("main_business"),
        F.concat(F.lit("supply of "), F.col("s_name")).alias("business_scope"),
        F.concat_ws(" ", "s_name", "n_name").alias("introduction"),
        F.concat(F.lit("www.s"), key.cast("string"), F.lit(".example.com")).alias("website"),
        (F.abs(bal).cast("long") + 10).alias("employees"),
    )


def instrument_count(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the instrument table; answered from Parquet footers, bounds every cross-section."""
    return table(spark, sf_dir, "supplier").count()


def _seats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = instrument_count(spark, sf_dir)
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.col("ts").cast("date").alias("trade_date"),
        ts_code_of(F.pmod(F.col("user_id"), F.lit(n).cast("long"))).alias("ts_code"),
        "event_type", "value",
    )


def top_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing event per row: signed net amount by event type."""
    t, v = F.col("event_type"), F.col("value")
    buy = F.when(t.isin("purchase", "view", "click"), v).otherwise(v * 0.25)
    sell = F.when(t.isin("error", "signup"), v).otherwise(v * 0.25)
    return _seats(spark, sf_dir).select(
        "event_id", "trade_date", "ts_code",
        buy.alias("l_buy"), sell.alias("l_sell"), (buy - sell).alias("net_amount"),
        (buy + sell).alias("amount"), t.alias("reason"),
    )


# Seat names by event type, fixed values of the adapter.
SEAT_OF_EVENT = {
    "click": "沪股通专用",
    "view": "深股通专用",
    "purchase": "机构专用",
    "signup": "华泰证券营业部",
    "error": "东方财富拉萨营业部",
}


def top_inst(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, v = F.col("event_type"), F.col("value")
    seat = F.lit(None).cast("string")
    for kind, name in SEAT_OF_EVENT.items():
        seat = F.when(t == kind, name).otherwise(seat)
    buy = F.when(t == "error", v * 0.5).otherwise(v)
    sell = F.when(t == "error", v).otherwise(v * 0.5)
    return _seats(spark, sf_dir).select(
        "event_id", "trade_date", "ts_code", seat.alias("exalter"),
        buy.alias("buy"), sell.alias("sell"), (buy - sell).alias("net_buy"), t.alias("reason"),
    )


def financial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly statements per instrument; some columns appear under an alias for part of the universe."""
    li = table(spark, sf_dir, "lineitem")
    ext = F.col("l_extendedprice")
    q = (
        li.select(
            F.col("l_suppkey").alias("k"), F.trunc(F.col("l_shipdate").cast("date"), "quarter").alias("q"),
            ext, (ext * F.col("l_discount")).alias("disc"), (ext * F.col("l_tax")).alias("tax"),
            F.when(F.col("l_returnflag") == "R", ext).otherwise(0.0).alias("ret"), "l_quantity",
        )
        .groupBy("k", "q")
        .agg(*[F.round(F.sum(c), 2).alias(a) for c, a in
               [("l_extendedprice", "rev0"), ("disc", "disc"), ("tax", "tax"), ("ret", "ret"), ("l_quantity", "qty")]])
    )
    k = F.col("k")
    idx = (F.year("q") - FUND_EPOCH_YEAR) * 4 + F.quarter("q") - 1
    scale = F.pow(F.lit(1.0) + (k % 7 - 2) * 0.03, idx) * F.when(k % 3 == 0, 1.0).otherwise(1000.0)
    rev = F.col("rev0") * scale
    ret, disc, tax = F.col("ret") * scale, F.col("disc") * scale, F.col("tax") * scale
    income = rev * 0.28 - ret * 0.6
    assets = rev * (3 + k % 4)
    liab = assets * (0.15 + (k % 9) * 0.08)
    base = q.select(
        "k", F.last_day(F.add_months("q", 2)).alias("end_date"), idx.cast("int").alias("qi"),
        rev.alias("rev"), income.alias("income"),
        (rev * 0.35 - ret * 0.55 - tax).alias("cash"),
        ((rev - ret * 0.5 - disc * 4) / rev * 100).alias("gm"),
        assets.alias("assets"), liab.alias("liab"),
        (rev * 0.3 - ret * 0.4 - disc).alias("op"),
        (income * 0.85).alias("dedt"), (assets * 0.1 + rev * 0.05).alias("cash_bal"),
        (disc * 3 + tax).alias("ar"), (rev * 0.6 + disc).alias("cost"), F.col("qty"),
    )
    w = Window.partitionBy("k").orderBy("qi")
    prev = F.when(F.lag("qi", 4).over(w) == F.col("qi") - 4, F.lag("rev", 4).over(w))
    prev_op = F.when(F.lag("qi", 4).over(w) == F.col("qi") - 4, F.lag("op", 4).over(w))
    return base.select(
        ts_code_of(k).alias("ts_code"), "end_date",
        F.when(k % 4 != 0, F.col("rev")).alias("revenue"),
        F.col("rev").alias("total_revenue"),
        F.when(k % 5 != 1, F.col("income")).alias("net_income"),
        F.when(k % 5 == 1, F.col("income")).alias("n_income"),
        F.when(k % 13 != 5, F.col("gm")).alias("gross_margin"),
        F.col("cash").alias("n_cashflow_act"),
        F.when(k % 6 != 2, F.col("income") / (F.col("assets") - F.col("liab")) * 100).alias("roe"),
        F.when(k % 8 != 3, F.col("liab") / F.col("assets") * 100).alias("debt_to_assets"),
        F.when(k % 10 != 4, 0.8 + (F.col("qty") % 40) / 20).alias("current_ratio"),
        F.col("assets").alias("total_assets"), F.col("liab").alias("total_liab"),
        (F.col("assets") - F.col("liab")).alias("total_hldr_eqy"),
        F.col("op").alias("operate_profit"), (F.col("op") * 1.05).alias("ebit"),
        (F.col("income") / F.col("assets")).alias("eps"),
        F.when(k % 12 != 6, (F.col("rev") - prev) / F.abs(prev) * 100).alias("or_yoy"),
        F.when(k % 12 != 7, (F.col("op") - prev_op) / F.abs(prev_op)).alias("op_yoy"),
        F.col("dedt").alias("profit_dedt"), F.col("cash_bal").alias("money_cap"),
        F.col("ar").alias("accounts_receiv"), F.col("cost").alias("oper_cost"),
        k.alias("instrument_key"),
    )


# Fixed values of the adapter: frequent words of the invented prose stand for the vocabulary
# of announcements; "{name}" becomes the instrument's name.
HIT_WORDS = [("that", "{name}"), ("with", "因涉嫌违规被立案调查"), ("from", "重大诉讼 被告"), ("tion", "计划减持 3.5% "), ("this", "中标 订单"), ("nicht", "专利 突破")]
HIT_HOSTS = ["cninfo.com.cn", "eastmoney.com", "xueqiu.com", "gov.cn", "news.example.com", "blog.example.net"]


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hit per document, over its whole text, assigned to an instrument."""
    n = instrument_count(spark, sf_dir)
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    key = F.pmod(i, F.lit(n).cast("long"))
    basic = stock_basic(spark, sf_dir).select("instrument_key", "ts_code", "symbol", "name", "industry")

    def told(c: Column) -> Column:
        for word, shown in HIT_WORDS:
            c = F.replace(c, F.lit(word), F.replace(F.lit(shown), F.lit("{name}"), F.col("name")))
        return c

    def first(c: Column) -> Column:
        return F.substring_index(c, "\n", 1)

    shift = F.date_sub(F.lit("2024-01-31").cast("date"), (i % 120).cast("int"))
    host = F.element_at(F.array(*[F.lit(h) for h in HIT_HOSTS]), (i % 6 + 1).cast("int"))
    j = d.withColumn("instrument_key", key).join(basic, "instrument_key")
    return j.select(
        "doc_id", "ts_code", "symbol", "name", "industry", "source", "lang",
        F.concat(F.lit("https://www."), host, F.lit("/a/"), i.cast("string"), F.when(i % 7 == 0, "?stockCode=600000").otherwise("")).alias("url"),
        F.when(i % 3 == 0, F.date_format(shift, "yyyyMMdd")).when(i % 3 == 1, F.date_format(shift, "yyyy/MM/dd")).otherwise(F.date_format(shift, "yyyy-MM-dd")).alias("date"),
        first(told(first(F.col("text")))).alias("title"), told(F.col("text")).alias("snippet"))  # no word holds a line's end: the title needs no whole text
