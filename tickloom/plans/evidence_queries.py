"""Evidence-text and theme queries over all documents and pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tickloom.functions import text as X
from tickloom.operators import evidence as V
from tickloom.operators.ranking import percentiles, top_n
from tickloom.plans.common import day, flag, r6
from tickloom.plans.oracle_base import code_of, cte
from tickloom.plans.registry import query
from tickloom.sources import adapters as A
from tickloom.sources.workspace import saved

_body = "text"
for _w, _s in A.HIT_WORDS:
    _body = f"replace({_body}, '{_w}', " + ("name" if _s == "{name}" else f"'{_s}'") + ")"
cte("hits", ("stock_basic",), f"""
  SELECT *, split_part(snippet, chr(10), 1) AS title FROM (
    SELECT doc_id, ts_code, symbol, name, industry, source, lang, 'https://www.'||{A.HIT_HOSTS!r}[doc_id%6+1]||'/a/'||doc_id||CASE WHEN doc_id%7=0 THEN '?stockCode=600000' ELSE '' END AS url,
      CASE WHEN doc_id%3=0 THEN strftime(dt,'%Y%m%d') WHEN doc_id%3=1 THEN strftime(dt,'%Y/%m/%d') ELSE strftime(dt,'%Y-%m-%d') END AS date, dt, {_body} AS snippet
    FROM (SELECT *, DATE '2024-01-31' - CAST(doc_id%120 AS INTEGER) AS dt FROM documents) d JOIN stock_basic b ON b.k = d.doc_id % (SELECT count(*) FROM supplier))""")
AS_OF = "2024-01-31"


@query("hit_dates", "F-19", ("hits",), f"SELECT doc_id, strftime(dt,'%Y-%m-%d') AS parsed, CAST(DATE '{AS_OF}'-dt<=60 AS INTEGER) AS recent FROM hits")
def hit_dates(spark, sf_dir):
    d = X.parse_date(F.col("date"))
    return A.search_hits(spark, sf_dir).select("doc_id", F.date_format(d, "yyyy-MM-dd").alias("parsed"),
                                               X.is_recent(d, F.lit(AS_OF).cast("date"), 60).cast("int").alias("recent"))


@query("hit_source_tier", "F-21", ("hits",), "SELECT doc_id, " + "CASE " + " ".join(f"WHEN contains(url,'{d}') THEN {w}" for d, w in X.SOURCE_TIERS) + " ELSE 0.6 END::DOUBLE AS tier FROM hits")
def hit_source_tier(spark, sf_dir):
    return A.search_hits(spark, sf_dir).select("doc_id", X.source_tier(F.col("url")).alias("tier"))


@query("compact_hits", "T-2 T-3", ("hits",), """
  SELECT doc_id, ts_code, substr(title,1,240) AS title, length(substr(snippet,1,500)) AS chars, CAST(contains(title||chr(10)||snippet||chr(10)||url,name) OR contains(title||chr(10)||snippet||chr(10)||url,symbol) AS INTEGER) AS relevant,
    CAST(doc_id%7=0 AND symbol<>'600000' AS INTEGER) AS code_mismatch FROM hits""")
def compact_hits(spark, sf_dir):
    return V.compact(A.search_hits(spark, sf_dir)).select("doc_id", "ts_code", "title", F.length("snippet").cast("long").alias("chars"), flag("relevant"), flag("code_mismatch"))


cte("veto", ("hits",), f"""
  SELECT doc_id, ts_code, first(r ORDER BY i) FILTER (r IS NOT NULL) AS veto FROM (
    SELECT doc_id, ts_code, i, CASE WHEN regexp_matches(s,'{X.INVESTIGATION}') THEN 'recent_investigation' WHEN regexp_matches(s,'{X.LITIGATION}') AND NOT regexp_matches(s,'{X.RESOLVED}') AND regexp_matches(s,'{X.DEFENDANT}') THEN 'major_litigation'
      WHEN regexp_matches(s,'{X.DELISTING}') THEN 'delisting_risk' WHEN regexp_matches(s,'{X.REDUCTION}') AND (coalesce(try_cast(nullif(regexp_extract(s,'(\\d+(?:\\.\\d+)?)\\s*%',1),'') AS DOUBLE)/100>=0.03,false) OR regexp_matches(s,'{X.LIQUIDATION}')) THEN 'material_reduction' END AS r
    FROM (SELECT doc_id, ts_code, name, symbol, unnest(string_split_regex(title||chr(10)||snippet,'[\\n。；;！!？?]')) AS s, generate_subscripts(string_split_regex(title||chr(10)||snippet,'[\\n。；;！!？?]'),1) AS i
          FROM hits WHERE NOT (doc_id%7=0 AND symbol<>'600000') AND DATE '{AS_OF}'-dt<=60)
    WHERE contains(s,name) OR contains(s,symbol)) GROUP BY 1,2""")


@query("hard_veto", "T-4 T-6", ("veto", "hits"), "SELECT h.doc_id, h.ts_code, veto FROM hits h LEFT JOIN veto v USING (doc_id)")
def hard_veto(spark, sf_dir):
    return V.hard_veto(A.search_hits(spark, sf_dir), AS_OF, 60, 0.03).select("doc_id", "ts_code", "veto")


@query("veto_by_instrument", "", ("veto", "hits"), """
  SELECT ts_code, count(veto) AS veto_hits, CASE WHEN count(veto)>0 THEN 'fail' ELSE 'pass' END AS verdict FROM (SELECT h.doc_id, h.ts_code, veto FROM hits h LEFT JOIN veto v USING (doc_id)) GROUP BY 1""")
def veto_by_instrument(spark, sf_dir):
    v = V.hard_veto(A.search_hits(spark, sf_dir), AS_OF, 60, 0.03)
    return v.groupBy("ts_code").agg(F.count("veto").alias("veto_hits")).withColumn("verdict", F.when(F.col("veto_hits") > 0, "fail").otherwise("pass"))


_K = " UNION ALL ".join(f"SELECT doc_id, ts_code, url, '{k}' AS category, " + "+".join(f"CAST(contains(t,'{w}') AS INTEGER)" for w in ws) + " AS k FROM ht" for k, ws in X.FINDING_WORDS.items())
cte("find", ("hits",), f"""
  SELECT * FROM (WITH ht AS (SELECT *, title||' '||snippet AS t FROM hits) SELECT doc_id, ts_code, category, k, CASE {' '.join(f"WHEN contains(url,'{d}') THEN {w}" for d, w in X.SOURCE_TIERS)} ELSE 0.6 END AS tier
  FROM ({_K}) WHERE k>0 AND doc_id IN (SELECT doc_id FROM ht WHERE contains(t,name)))""")


@query("positive_findings", "T-8", ("find",), "SELECT doc_id, ts_code, category, round((tier+least(1.0,k*0.3))/2::DOUBLE,2)::DOUBLE AS confidence FROM find")
def positive_findings(spark, sf_dir):
    return V.positive_findings(A.search_hits(spark, sf_dir)).select("doc_id", "ts_code", "category", "confidence")


@query("findings_per_instrument", "T-15", ("find",), """
  SELECT ts_code, count(*) AS findings, count(DISTINCT category) AS categories, 5-count(DISTINCT category) AS gaps FROM find GROUP BY 1""")
def findings_per_instrument(spark, sf_dir):
    f = V.positive_findings(A.search_hits(spark, sf_dir))
    per = f.groupBy("ts_code", "category").agg(F.count(F.lit(1)).alias("n"))  # five categories at most per name
    return per.groupBy("ts_code").agg(F.sum("n").alias("findings"), F.count(F.lit(1)).alias("categories")).withColumn("gaps", 5 - F.col("categories"))


_T = [(k, i, q) for k, qs in X.QUERY_TEMPLATES.items() for i, q in enumerate(qs)]


@query("query_expansion", "T-9", ("stock_basic",), f"""
  SELECT ts_code, category, CAST(i AS INTEGER) AS template, replace(q,'{{name}}',name) AS query FROM stock_basic, (VALUES {', '.join(f"('{k}',{i},'{q}')" for k, i, q in _T)}) t(category,i,q)""")
def query_expansion(spark, sf_dir):
    return V.expand_queries(A.stock_basic(spark, sf_dir))


@query("evidence_digest", "T-11", ("hits",), """
  SELECT ts_code, doc_id FROM hits QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY CASE WHEN regexp_matches(snippet,'立案|诉讼|减持|退市') THEN 0 ELSE 1 END, dt DESC, doc_id)<=10""")
def evidence_digest(spark, sf_dir):
    h = A.search_hits(spark, sf_dir).select("ts_code", "doc_id", X.parse_date(F.col("date")).alias("d"),
                                            F.when(F.col("snippet").rlike("立案|诉讼|减持|退市"), 0).otherwise(1).alias("p"))
    return top_n(h, ["ts_code"], 10, F.col("p"), F.desc("d"), F.col("doc_id")).select("ts_code", "doc_id")


@query("evidence_chunks", "T-10", (), """
  WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS items FROM documents WHERE text IS NOT NULL),
  st AS (
    SELECT doc_id, items, 1 AS i, 0 AS chunk, 0 AS used, -1 AS own, 0 AS kept FROM d
    UNION ALL
    SELECT doc_id, items, i + 1, CASE WHEN need > 120 THEN here + 1 ELSE here END, CASE WHEN need > 120 THEN 0 WHEN is_full THEN need ELSE used + need END,
           here, kept + CASE WHEN need > 120 THEN least(len(items[i]), 120) ELSE len(items[i]) END
    FROM (SELECT *, chunk + CASE WHEN is_full THEN 1 ELSE 0 END AS here
          FROM (SELECT *, used > 0 AND used + need > 120 AS is_full FROM (SELECT *, CAST(ceil(len(items[i]) / 2.0) AS INTEGER) AS need FROM st WHERE i <= len(items)))))
  SELECT doc_id, len(any_value(items)) AS items, max(own) + 1 AS chunks, max(kept) AS kept_chars FROM st GROUP BY doc_id""")
def evidence_chunks(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("items"))
    c = V.chunk_items(d, "items", 120)
    kept = F.aggregate("items", F.lit(0), lambda n, t: n + F.length(t))
    return c.where("items is not null").select("doc_id", F.size("items").alias("items"), (F.array_max("chunk") + 1).alias("chunks"), kept.alias("kept_chars"))


# a fixed list of themes; keyword words of the given prose
THEMES = {"industry three": ["NATION_3", "NATION_13"], "policy": ["entithe", "attion"], "growth": ["onnd", "erthe"]}
_TOK = {n: sorted({w for w in " ".join([n, *k]).replace("-", " ").split() if len(w) >= 2}) for n, k in THEMES.items()}
_any = lambda n, c: "(" + " OR ".join(f"contains({c},'{t}')" for t in _TOK[n]) + ")"


@query("theme_text_match", "", ("hits",), f"""
  SELECT doc_id, coalesce(array_to_string(list_filter([{', '.join(f"CASE WHEN {_any(n, 't')} THEN '{n}' END" for n in THEMES)}], lambda x: x IS NOT NULL)[1:2],'|'),'') AS themes FROM (SELECT doc_id, name||' '||industry||' '||snippet AS t FROM hits)""")
def theme_text_match(spark, sf_dir):
    h = A.search_hits(spark, sf_dir).select("doc_id", F.concat_ws(" ", "name", "industry", "snippet").alias("t"))
    return V.theme_matches(h, "t", THEMES, ["doc_id"]).select("doc_id", F.array_join("matched_themes", "|").alias("themes"))


@query("theme_industry_match", "J-16", ("stock_basic",), f"""
  SELECT ts_code, coalesce(array_to_string(list_filter([{', '.join(f"CASE WHEN {_any(n, 'industry')} THEN '{n}' END" for n in THEMES)}], lambda x: x IS NOT NULL)[1:2],'|'),'') AS themes FROM stock_basic""")
def theme_industry_match(spark, sf_dir):
    return V.theme_matches(A.stock_basic(spark, sf_dir), "industry", THEMES, ["ts_code"]).select("ts_code", F.array_join("matched_themes", "|").alias("themes"))


@query("theme_match_validation", "", ("hits",), " UNION ALL ".join(
    f"SELECT ts_code, '{n}' AS theme, " + "+".join(f"CAST(bool_or(contains(snippet,'{t}')) AS BIGINT)" for t in _TOK[n]) + " AS hits FROM hits GROUP BY 1 HAVING bool_or(" + _any(n, "snippet") + ")" for n in THEMES))
def theme_match_validation(spark, sf_dir):
    return V.token_hits(A.search_hits(spark, sf_dir), "snippet", THEMES, ["ts_code"]).select("ts_code", "theme", "hits")


@query("names_in_evidence", "", ("hits",), "SELECT ts_code, count(*) AS mentions FROM hits WHERE length(name)>=3 AND contains(snippet,name) GROUP BY 1")
def names_in_evidence(spark, sf_dir):
    h = A.search_hits(spark, sf_dir).where((F.length("name") >= 3) & F.col("snippet").contains(F.col("name")))
    return h.groupBy("ts_code").agg(F.count(F.lit(1)).alias("mentions"))


@query("page_links", "F-20", (), """
  SELECT page_id, len(list_distinct(list_filter(regexp_extract_all(url||' '||html,'(https?://[^\\s"''<>）)]+|www\\.[^\\s"''<>）)]+)',1), lambda u: NOT contains(u,'example.org')))) AS links FROM pages""")
def page_links(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", F.size(X.urls(F.concat_ws(" ", "url", "html"))).cast("long").alias("links"))


@query("metric_from_props", "F-26", (), "SELECT event_id, CAST(regexp_extract(props,'\"k\"[：:\\s]*([-+]?[\\d,]+)',1) AS DOUBLE) AS k FROM events")
def metric_from_props(spark, sf_dir):
    return A.table(spark, sf_dir, "events").select("event_id", X.metric_after(F.col("props"), '"k"').alias("k"))


# Conclusions of the two report generations.
CONCLUSIONS = ["可配置", "等回踩", "回避", "强烈推荐"]
BUYABLE, WATCHED = ["可配置", "强烈推荐"], ["等回踩"]


def report_texts(spark, sf_dir):
    """A report section per conversation turn, before its text."""
    n = A.instrument_count(spark, sf_dir)
    c = A.table(spark, sf_dir, "conversations")
    k = F.pmod(F.col("conv_id"), F.lit(n).cast("long"))
    con = F.element_at(F.array(*[F.lit(x) for x in CONCLUSIONS]), ((F.col("conv_id") + F.col("turn")) % 4 + 1).cast("int"))
    head = F.format_string("\n### Pick%d %s\n结论：%s\n综合质量得分：%d\n处于%d%%分位\n", F.col("conv_id"), A.ts_code_of(k), con, F.length("text") % 100, F.col("conv_id") % 101)
    return c.select("conv_id", "turn", F.date_add(F.lit("2000-01-01").cast("date"), ((F.col("conv_id") + F.col("turn")) % 500).cast("int")).alias("report_date"), F.concat(head, "text").alias("report"))


def report_picks(spark, sf_dir):
    """Picks parsed out of report sections."""
    s = report_texts(spark, sf_dir).select("conv_id", "turn", "report_date", F.explode(F.split("report", r"\n(?=### \S+ \d{6,}\.[A-Z]+)")).alias("s"))
    g = lambda p, i=1: F.nullif(F.regexp_extract("s", p, i), F.lit(""))
    p = s.select("conv_id", "turn", "report_date", g(r"^###\s+(.+?)\s+(\d{6,}\.[A-Z]+)").alias("name"), g(r"^###\s+(.+?)\s+(\d{6,}\.[A-Z]+)", 2).alias("ts_code"),
                 F.trim(g(r"结论[：:]\s*(.+?)(?:\n|$)")).alias("conclusion"), g(r"综合质量得分[：:]*\s*(\d+)").try_cast("double").alias("quality"), g(r"(\d+)%分位").try_cast("int").alias("position"))
    act = F.when(F.col("conclusion").isin(BUYABLE), "buy").when(F.col("conclusion").isin(WATCHED), "watch").otherwise("unknown")
    return p.where("ts_code is not null").withColumn("action", act)


cte("picks", (), f"""
  SELECT conv_id, turn, DATE '2000-01-01' + CAST((conv_id+turn)%500 AS INTEGER) AS report_date, 'Pick'||conv_id AS name, {code_of('(conv_id % (SELECT count(*) FROM supplier))')} AS ts_code,
    {CONCLUSIONS!r}[(conv_id+turn)%4+1] AS conclusion, CAST(length(text)%100 AS DOUBLE) AS quality, CAST(conv_id%101 AS INTEGER) AS position, ['buy','watch','unknown','buy'][(conv_id+turn)%4+1] AS action FROM conversations""")


@query("report_picks", "T-12", ("picks",), "SELECT conv_id, turn, name, ts_code, conclusion, quality, position, action FROM picks")
def report_picks_query(spark, sf_dir):
    return report_picks(spark, sf_dir).select("conv_id", "turn", "name", "ts_code", "conclusion", "quality", "position", "action")


def pick_returns(spark, sf_dir):
    """Distinct picks with entry, latest and calendar-day returns."""
    from tickloom.operators.asof import last_bar_at_or_before as at

    picks = report_picks(spark, sf_dir).groupBy("ts_code", "report_date").agg(F.min(F.struct("conv_id", "turn", "action", "conclusion", "name")).alias("m")).select("ts_code", "report_date", "m.action", "m.conclusion", "m.name")
    bars = A.bars(spark, sf_dir).select("ts_code", "trade_date", F.col("trade_date").alias("d"), F.col("close").alias("p"))
    # all dates of a pick asked for in one pass: day 0 and the horizons
    days = F.explode(F.array(*[F.lit(h) for h in (0, 1, 3, 5, 10, 20)]))
    kept = ["ts_code", "report_date", "action", "conclusion", "name"]
    asks = picks.select(*kept, days.alias("h")).withColumn("ask", F.expr("date_add(report_date, h)"))
    a = at(bars, asks, "ask", ["d", "p"])
    wide = a.groupBy(*kept).agg(
        F.max(F.when(F.col("h") == 0, F.col("d"))).alias("entry_date"), *[F.max(F.when(F.col("h") == h, F.col("p"))).alias(f"p{h}") for h in (0, 1, 3, 5, 10, 20)])
    last = bars.groupBy("ts_code").agg(F.max(F.struct("d", "p")).alias("l"))
    j = wide.join(last, "ts_code").where("entry_date is not null and entry_date <> l.d")
    return j.select(*kept, "entry_date", F.col("p0").alias("entry_price"), ((F.col("l.p") / F.col("p0") - 1) * 100).alias("total_return_pct"),
                    *[((F.col(f"p{h}") / F.col("p0") - 1) * 100).alias(f"d{h}") for h in (1, 3, 5, 10, 20)])


_pa = lambda h: f"(SELECT arg_max(close,trade_date) FROM bars b WHERE b.ts_code=p.ts_code AND b.trade_date<=p.report_date+{h})"
cte("pr", ("picks", "bars"), f"""
  SELECT *, (lp/p0-1)*100 AS total_return_pct FROM (SELECT ts_code, report_date, action, {_pa(0)} AS p0, {_pa(5)} AS p5, {_pa(20)} AS p20,
    (SELECT max(trade_date) FROM bars b WHERE b.ts_code=p.ts_code AND b.trade_date<=p.report_date) AS entry_date, (SELECT arg_max(close,trade_date) FROM bars b WHERE b.ts_code=p.ts_code) AS lp, (SELECT max(trade_date) FROM bars b WHERE b.ts_code=p.ts_code) AS ld
   FROM (SELECT * FROM picks QUALIFY row_number() OVER (PARTITION BY ts_code, report_date ORDER BY conv_id, turn)=1) p) WHERE entry_date IS NOT NULL AND entry_date<>ld""")


@query("pick_returns", "T-13 J-6 U-4", ("pr",), """
  SELECT ts_code, strftime(report_date,'%Y-%m-%d') AS report_date, strftime(entry_date,'%Y-%m-%d') AS entry_date, round(total_return_pct,4) AS total_return_pct, round((p5/p0-1)*100,4) AS d5, round((p20/p0-1)*100,4) AS d20 FROM pr""")
def pick_returns_query(spark, sf_dir):
    return pick_returns(spark, sf_dir).select("ts_code", day("report_date"), day("entry_date"), r6("total_return_pct", 4), r6("d5", 4), r6("d20", 4))


@query("pick_performance", "A-27", ("pr",), """
  SELECT coalesce(action,'all') AS action, count(*) AS picks, round(avg(total_return_pct),4) AS mean_return, round(median(total_return_pct),4) AS median_return, round(avg(CASE WHEN total_return_pct>0 THEN 1.0 ELSE 0.0 END),6) AS win_rate,
    round(max(total_return_pct),4) AS best, round(min(total_return_pct),4) AS worst FROM pr GROUP BY GROUPING SETS ((action),())""")
def pick_performance(spark, sf_dir):
    r = F.col("total_return_pct")
    p = pick_returns(spark, sf_dir)
    groups = F.explode(F.array(F.col("action"), F.lit("all")))
    long = p.select(groups.alias("action"), "total_return_pct")
    med = percentiles(long, ["action"], "total_return_pct", {"median_return": 0.5}, A.table(spark, sf_dir, "conversations").count())
    stats = long.groupBy("action").agg(
        F.count(F.lit(1)).alias("picks"), F.round(F.avg(r), 4).alias("mean_return"),
        F.round(F.avg(F.when(r > 0, 1.0).otherwise(0.0)), 6).alias("win_rate"), F.round(F.max(r), 4).alias("best"), F.round(F.min(r), 4).alias("worst"))
    return stats.join(med, "action").withColumn("median_return", F.round("median_return", 4))


@query("pick_repeats", "A-28", ("picks",), """
  SELECT ts_code, strftime(min(report_date),'%Y-%m-%d') AS first_seen, count(DISTINCT report_date) AS reports FROM picks GROUP BY 1 HAVING count(DISTINCT report_date)>=3""")
def pick_repeats(spark, sf_dir):
    p = report_picks(spark, sf_dir).select("ts_code", "report_date").distinct()
    return p.groupBy("ts_code").agg(F.min("report_date").alias("first_seen"), F.count(F.lit(1)).alias("reports")).where("reports >= 3").select("ts_code", day("first_seen"), "reports")


# Conclusions of the first report generation; the others are of the second. Days from which a pick is recent.
OLD_SYSTEM = ["观察", "推荐", "回避", "强烈推荐"]
RECENT_FROM = "2000-09-01"
HORIZONS = (1, 3, 5, 10, 20)


def pick_splits(picks, bound):
    """Performance per split and action in one aggregation: overall, recency, system, report date, and each horizon by its own return.

    (split, value, action, picks, mean, median, win rate, best, worst, mix); mix counts the conclusions, most frequent first."""
    c = F.col
    own = lambda split, value: F.struct(F.lit(split).alias("split"), value.alias("value"), c("total_return_pct").alias("r"))
    parts = [own("overall", F.lit("all")), own("recency", F.when(c("report_date") >= RECENT_FROM, "recent").otherwise("older")),
             own("system", F.when(c("conclusion").isin(OLD_SYSTEM), "old").otherwise("new")), own("report_date", F.date_format("report_date", "yyyy-MM-dd"))]
    parts += [F.struct(F.lit("horizon").alias("split"), F.lit(f"d{h}").alias("value"), c(f"d{h}").alias("r")) for h in HORIZONS]
    actions = F.when(c("action").isin("buy", "watch"), F.array(F.lit("all"), "action")).otherwise(F.array(F.lit("all")))
    long = picks.select("conclusion", actions.alias("_a"), F.explode(F.array(*parts)).alias("s")).select("conclusion", F.explode("_a").alias("action"), "s.*")
    long = long.where("r IS NOT NULL")
    keys = ["split", "value", "action"]
    med = percentiles(long, keys, "r", {"median_return": 0.5}, bound)
    mixed = long.groupBy(*keys, "conclusion").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("sum"), F.count_if(c("r") > 0).alias("won"), F.max("r").alias("best"), F.min("r").alias("worst"))
    mix = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-c("n")).alias("o"), "conclusion", "n"))), lambda x: F.concat(x["conclusion"], F.lit(":"), x["n"])), ", ")
    stats = mixed.groupBy(*keys).agg(F.sum("n").alias("picks"), F.round(F.sum("sum") / F.sum("n"), 4).alias("mean_return"), F.round(F.sum("won") / F.sum("n"), 6).alias("win_rate"),
                                     F.round(F.max("best"), 4).alias("best"), F.round(F.min("worst"), 4).alias("worst"), mix.alias("mix"))
    return stats.join(med, keys).withColumn("median_return", F.round("median_return", 4))


cte("pr2", ("picks", "bars"), f"""
  SELECT *, (lp/p0-1)*100 AS total_return_pct FROM (SELECT ts_code, report_date, action, conclusion, name, {', '.join(f'{_pa(h)} AS p{h}' for h in (0, *HORIZONS))},
    (SELECT max(trade_date) FROM bars b WHERE b.ts_code=p.ts_code AND b.trade_date<=p.report_date) AS entry_date, (SELECT arg_max(close,trade_date) FROM bars b WHERE b.ts_code=p.ts_code) AS lp, (SELECT max(trade_date) FROM bars b WHERE b.ts_code=p.ts_code) AS ld
   FROM (SELECT * FROM picks QUALIFY row_number() OVER (PARTITION BY ts_code, report_date ORDER BY conv_id, turn)=1) p) WHERE entry_date IS NOT NULL AND entry_date<>ld""")
_OLD = ", ".join(f"'{x}'" for x in OLD_SYSTEM)
cte("prl", ("pr2",), f"""
  SELECT x.*, a AS act FROM (
    SELECT 'overall' AS split, 'all' AS value, total_return_pct AS r, action, conclusion FROM pr2 UNION ALL
    SELECT 'recency', CASE WHEN report_date>=DATE '{RECENT_FROM}' THEN 'recent' ELSE 'older' END, total_return_pct, action, conclusion FROM pr2 UNION ALL
    SELECT 'system', CASE WHEN conclusion IN ({_OLD}) THEN 'old' ELSE 'new' END, total_return_pct, action, conclusion FROM pr2 UNION ALL
    SELECT 'report_date', strftime(report_date,'%Y-%m-%d'), total_return_pct, action, conclusion FROM pr2 UNION ALL
    {' UNION ALL '.join(f"SELECT 'horizon', 'd{h}', (p{h}/p0-1)*100, action, conclusion FROM pr2" for h in HORIZONS)}) x,
    (VALUES ('all'),('buy'),('watch')) v(a) WHERE (a='all' OR a=action) AND r IS NOT NULL""")


@query("pick_splits", "A-27", ("prl",), """
  SELECT split, value, act AS action, count(*) AS picks, round(avg(r),4) AS mean_return, round(median(r),4) AS median_return, round(avg(CASE WHEN r>0 THEN 1.0 ELSE 0.0 END),6) AS win_rate,
    round(max(r),4) AS best, round(min(r),4) AS worst, any_value(mix) AS mix
  FROM prl JOIN (SELECT split, value, act, string_agg(conclusion||':'||n, ', ' ORDER BY n DESC, conclusion) AS mix FROM (SELECT split, value, act, conclusion, count(*) AS n FROM prl GROUP BY ALL) GROUP BY ALL) USING (split, value, act)
  GROUP BY split, value, act""")
def pick_splits_query(spark, sf_dir):
    return pick_splits(saved(pick_returns(spark, sf_dir), "picks"), A.table(spark, sf_dir, "conversations").count())


@query("pick_extremes", "A-28", ("pr2",), """
  SELECT kind, CAST(row_number() OVER (PARTITION BY kind ORDER BY o, ts_code, report_date) AS INTEGER) AS place, ts_code, name, strftime(report_date,'%Y-%m-%d') AS report_date, conclusion, round(total_return_pct,4) AS total_return_pct
  FROM (SELECT 'winner' AS kind, -total_return_pct AS o, * FROM pr2 UNION ALL SELECT 'loser', total_return_pct, * FROM pr2) QUALIFY place<=10""")
def pick_extremes(spark, sf_dir):
    p = pick_returns(spark, sf_dir).select("ts_code", "name", "report_date", "conclusion", "total_return_pct")
    sides = []
    for kind, first in (("winner", F.desc("total_return_pct")), ("loser", F.asc("total_return_pct"))):
        top = p.orderBy(first, "ts_code", "report_date").limit(10)
        sides.append(top.select(F.lit(kind).alias("kind"), F.row_number().over(Window.orderBy(first, "ts_code", "report_date")).alias("place"), "*"))  # ten rows
    both = sides[0].union(sides[1])
    return both.select("kind", "place", "ts_code", "name", day("report_date"), "conclusion", r6("total_return_pct", 4))
