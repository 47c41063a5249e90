"""Source, sink and catalog queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickloom.plans.common import day, r6, rounded, sql_day, sql_round
from tickloom.plans.oracle_base import cte
from tickloom.plans.registry import query
from tickloom.sources import adapters as A
from tickloom.sources import catalog as K
from tickloom.sources import readers as D
from tickloom.sources import sinks as Z
from tickloom.sources.workspace import shared_folder
from tickloom.streaming import streams as R


@query("listed_instruments", "S-1", ("stock_basic",), "SELECT ts_code, symbol, name, industry, market, exchange, strftime(list_date,'%Y-%m-%d') AS list_date FROM stock_basic WHERE list_status='L'")
def listed_instruments(spark, sf_dir):
    return A.stock_basic(spark, sf_dir).where("list_status = 'L'").select("ts_code", "symbol", "name", "industry", "market", "exchange", day("list_date"))


@query("company_profiles", "S-2 J-2", ("stock_company", "stock_basic"), "SELECT b.ts_code, name, main_business, business_scope, introduction, employees, province FROM stock_basic b LEFT JOIN stock_company c ON b.ts_code=c.ts_code")
def company_profiles(spark, sf_dir):
    c = A.stock_company(spark, sf_dir).select("ts_code", "main_business", "business_scope", "introduction", "employees", "province")
    return A.stock_basic(spark, sf_dir).select("ts_code", "name").join(c, "ts_code", "left")


_OHLC = ["open", "high", "low", "close", "pre_close"]


def _raw(spark, sf_dir):
    """Bars as vendors deliver them: text dates, text prices, volume under another name."""
    b = A.bars(spark, sf_dir)
    return b.select("ts_code", F.date_format("trade_date", "yyyyMMdd").alias("trade_date"), *[F.col(c).cast("string").alias(c) for c in _OHLC], F.col("vol").alias("volume"))


@query("normalised_bars", "S-3 S-6", ("bars",), f"SELECT ts_code, {sql_day('trade_date')}, {sql_round(_OHLC)}, vol FROM bars")
def normalised_bars(spark, sf_dir):
    return D.normalise_bars(_raw(spark, sf_dir)).select("ts_code", day("trade_date"), *rounded(_OHLC), "vol")


@query("long_histories", "S-4", ("bars",), f"SELECT ts_code, {sql_day('trade_date')}, round(close,6) AS close FROM bars WHERE nbars>=300")
def long_histories(spark, sf_dir):
    return D.long_histories(A.bars(spark, sf_dir), 300).select("ts_code", day("trade_date"), r6("close"))


@query("price_history_keep_last", "S-5 W-4", (), """
  SELECT l_suppkey, strftime(l_shipdate,'%Y-%m-%d') AS d, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_shipdate ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC)=1""")
def price_history_keep_last(spark, sf_dir):
    li = A.table(spark, sf_dir, "lineitem").withColumn("_s", F.struct("l_orderkey", "l_linenumber", "l_partkey"))
    return D.keep_last(li, ["l_suppkey", "l_shipdate"], "_s").select("l_suppkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("d"), "l_orderkey", "l_linenumber")


@query("recent_prices", "S-7", ("bars",), f"""
  SELECT ts_code, {sql_day('trade_date')}, round(close,6) AS close, nbars-rn+1 AS recency FROM (SELECT *, max(trade_date) OVER (PARTITION BY ts_code) AS l FROM bars) WHERE trade_date>=l-60""")
def recent_prices(spark, sf_dir):
    return D.recent_days(A.bars(spark, sf_dir), 60).select("ts_code", day("trade_date"), r6("close"), F.col("recency").cast("long").alias("recency"))


@query("instrument_codes", "S-16", ("bars",), "SELECT DISTINCT ts_code FROM bars")
def instrument_codes(spark, sf_dir):
    return D.instrument_codes(A.bars(spark, sf_dir))


cte("fs", ("financial",), "SELECT * FROM financial")


@query("statement_upsert", "S-17 J-12", ("financial",), """
  SELECT ts_code, strftime(end_date,'%Y-%m-%d') AS end_date, round(total_revenue*CASE WHEN end_date>=DATE '2000-12-31' THEN 1.5 ELSE 1 END,2) AS total_revenue, round(eps,6) AS eps
  FROM financial QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY end_date DESC)<=12""")
def statement_upsert(spark, sf_dir):
    f = A.financial(spark, sf_dir)
    income = f.select("ts_code", "end_date", "total_revenue")
    indicator = f.select("ts_code", "end_date", "eps")
    merged = D.merge_feeds([income, indicator])
    fresh = merged.where("end_date >= date '2000-12-31'").withColumn("total_revenue", F.col("total_revenue") * 1.5)
    return D.upsert_quarters(merged, fresh).select("ts_code", day("end_date"), F.round("total_revenue", 2).alias("total_revenue"), r6("eps"))


@query("statement_store", "S-17 J-12", ("financial", "stock_basic"), """
  SELECT ts_code, strftime(end_date,'%Y-%m-%d') AS end_date, round(total_revenue*f,2) AS total_revenue, round(total_assets,2) AS total_assets, round(n_cashflow_act*f,2) AS n_cashflow_act, round(eps,6) AS eps
  FROM (SELECT x.*, CASE WHEN k%3=0 AND end_date>=DATE '2000-12-31' THEN 2 ELSE 1 END AS f FROM financial x) WHERE NOT (k%3<>0 AND end_date>DATE '2001-06-30')
  QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY end_date DESC)<=12""")
def statement_store(spark, sf_dir):
    """Four feeds up to a day, stored; then those of every third instrument again, changed and with later quarters, merged in."""
    f = A.financial(spark, sf_dir)
    columns = ["total_revenue", "total_assets", "n_cashflow_act", "eps"]
    feeds = lambda df: [df.select("ts_code", "end_date", c) for c in columns]
    path = f"{shared_folder(spark)}/statements-{uuid.uuid4().hex}"
    Z.merge_statements(spark, path, feeds(f.where("end_date <= date '2001-06-30'")))
    third = f.where("instrument_key % 3 = 0 AND end_date >= date '2000-12-31'")
    for c in ("total_revenue", "n_cashflow_act"):
        third = third.withColumn(c, F.col(c) * 2)
    Z.merge_statements(spark, path, feeds(third))
    return spark.read.parquet(path).select("ts_code", day("end_date"), *[F.round(c, 2).alias(c) for c in columns[:3]], r6("eps"))


@query("staleness_plan", "S-18", ("financial", "stock_basic"), """
  SELECT ts_code, strftime(m,'%Y-%m-%d') AS newest, CASE WHEN m IS NULL THEN 'full' WHEN m<DATE '2001-12-31' THEN 'stale' ELSE 'skip' END AS action FROM stock_basic LEFT JOIN (
    SELECT ts_code, max(end_date) AS m FROM financial WHERE n_income IS NULL GROUP BY 1) USING (ts_code)""")
def staleness_plan(spark, sf_dir):
    stored = A.financial(spark, sf_dir).where("n_income is null")
    return D.staleness_plan(A.stock_basic(spark, sf_dir), stored, "2002-01-20").select("ts_code", day("newest"), "action")


@query("latest_listing_day", "S-19", ("top_list",), f"SELECT event_id, {sql_day('trade_date')}, ts_code FROM top_list WHERE trade_date=(SELECT max(trade_date) FROM top_list)")
def latest_listing_day(spark, sf_dir):
    return D.latest_partition(A.top_list(spark, sf_dir)).select("event_id", day("trade_date"), "ts_code")


@query("live_bar_merge", "S-20", ("bars",), f"""
  SELECT ts_code, {sql_day('trade_date')}, round(CASE WHEN rn=nbars THEN close*1.01 ELSE close END,6) AS close, CASE WHEN rn=nbars THEN 'live' ELSE 'history' END AS source FROM bars""")
def live_bar_merge(spark, sf_dir):
    from tickloom.operators.timeseries import latest

    b = A.bars(spark, sf_dir).select("ts_code", "trade_date", "close")
    live = latest(b).withColumn("close", F.col("close") * 1.01)
    return D.merge_live(b, live).select("ts_code", day("trade_date"), r6("close"), "source")


@query("event_payloads", "S-13", (), "SELECT event_id, event_type AS event, CAST(json_extract(props,'$.k') AS BIGINT) AS k FROM events")
def event_payloads(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("event"), F.from_json("props", "k bigint")["k"].alias("k"))


@query("catalog_sql", "S-14 S-15", ("bars", "stock_basic"), """
  SELECT industry, count(*) AS bars, round(avg(close),6) AS mean_close FROM bars JOIN stock_basic USING (ts_code) WHERE industry < 'NATION_2' GROUP BY 1 ORDER BY industry LIMIT 20""")
def catalog_sql(spark, sf_dir):
    return K.run_sql(spark, sf_dir, """
        SELECT b.industry, count(*) AS bars, round(avg(d.close), 6) AS mean_close FROM stock_basic_daily d JOIN stock_basic b ON b.ts_code = d.ts_code
        WHERE b.industry < 'NATION_2' GROUP BY b.industry ORDER BY b.industry""")


@query("top50_export", "S-12 K-1", ("top50",), "SELECT ts_code, name, industry, printf('%.2f',composite_score) AS composite_score, printf('%.1f亿',market_cap/1e8) AS market_cap, printf('%.2f%%',volatility*100) AS volatility FROM top50")
def top50_export(spark, sf_dir):
    from tickloom.plans.screen_queries import screened

    return Z.top_candidates(screened(spark, sf_dir))


def event_prices(spark, sf_dir):
    n = A.instrument_count(spark, sf_dir)
    return A.table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), A.ts_code_of(F.pmod("user_id", F.lit(n).cast("long"))).alias("ts_code"), "value")


@query("event_time_bars", "R-3", ("top_list",), f"""
  SELECT ts_code, strftime(trade_date,'%Y-%m-%d') AS bar_start, arg_min(value,ts) AS open, max(value) AS high, min(value) AS low, arg_max(value,ts) AS close, count(*) AS trades
  FROM (SELECT t.ts_code, t.trade_date, e.value, e.ts FROM top_list t JOIN events e USING (event_id)) GROUP BY 1, trade_date""")
def event_time_bars(spark, sf_dir):
    return R.bars_from_events(event_prices(spark, sf_dir)).withColumn("bar_start", F.date_format("bar_start", "yyyy-MM-dd"))


@query("sliding_list_hits", "R-1", ("top_list",), """
  SELECT ts_code, strftime(CAST(trade_date - CAST(o AS INTEGER) AS DATE),'%Y-%m-%d') AS window_start, count(*) AS hits, round(sum(value),4) AS value
  FROM (SELECT t.ts_code, t.trade_date, e.value FROM top_list t JOIN events e USING (event_id)), range(60) r(o) GROUP BY 1, 2""")
def sliding_list_hits(spark, sf_dir):
    return R.sliding_hits(event_prices(spark, sf_dir)).select(
        "ts_code", F.date_format("window.start", "yyyy-MM-dd").alias("window_start"), "hits", F.round("value", 4).alias("value"))
