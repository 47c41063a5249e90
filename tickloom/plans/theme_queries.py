"""Themes as a table: who is named, matched, picked and merged."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions import text as X
from tickloom.operators import evidence as V
from tickloom.operators import themes as H
from tickloom.operators.ranking import top_n
from tickloom.plans.evidence_queries import AS_OF
from tickloom.plans.oracle_base import cte
from tickloom.plans.registry import query
from tickloom.sources import adapters as A
from tickloom.sources.workspace import saved

STATUS = ["confirmed", "web_only", "capital_only", "weak"]


def themes(spark, sf_dir):
    """A theme per document: its first word and its instrument's industry as keywords, its text as evidence, which names instruments."""
    h, d = A.search_hits(spark, sf_dir), F.col("doc_id")
    n = A.instrument_count(spark, sf_dir)
    other = A.stock_basic(spark, sf_dir).select(F.col("instrument_key").alias("_k"), F.col("name").alias("_other"))
    j = h.withColumn("_k", F.pmod(d * 7 + 1, F.lit(n).cast("long"))).join(other, "_k", "left")
    more = F.when(d % 7 == 0, "trading").when(d % 5 == 0, "supply of").otherwise("行业")
    return j.select(
        F.concat(F.lit("T"), d).alias("theme"), d.alias("ord"), F.array("industry", F.split_part("title", F.lit(" "), F.lit(1)), more).alias("keywords"),
        F.when(d % 4 == 0, F.col("title")).otherwise("").alias("capital_signal"),
        F.concat("snippet", F.when((d % 3 == 0) & F.col("_other").isNotNull(), F.concat(F.lit(" "), "_other")).otherwise("")).alias("evidence"),
        F.element_at(F.array(*map(F.lit, STATUS)), (d % 4 + 1).cast("int")).alias("status"))


cte("thm", ("hits", "stock_basic"), """
  SELECT 'T'||doc_id AS theme, doc_id AS ord, h.industry||' '||split_part(title,' ',1)||' '||CASE WHEN doc_id%7=0 THEN 'trading' WHEN doc_id%5=0 THEN 'supply of' ELSE '行业' END AS words,
    CASE WHEN doc_id%4=0 THEN title ELSE '' END||' '||snippet||CASE WHEN doc_id%3=0 AND b.name IS NOT NULL THEN ' '||b.name ELSE '' END AS told
  FROM hits h LEFT JOIN stock_basic b ON b.k=(doc_id*7+1)%(SELECT count(*) FROM supplier)""")


def _sql_tokens(stop):
    return f"""SELECT DISTINCT theme, ord, token FROM (SELECT theme, ord, unnest(string_split_regex(theme||' '||words, '[^\\p{{L}}\\p{{N}}_]+')) AS token FROM thm)
      WHERE length(token)>=2 AND token NOT IN ({', '.join(f"'{w}'" for w in stop)})"""


for _n, _s in (("text", H.TEXT_STOP), ("industry", H.INDUSTRY_STOP), ("check", H.CHECK_STOP)):
    cte(f"tok_{_n}", ("thm",), _sql_tokens(_s))
cte("prof", ("stock_basic", "stock_company"), """
  SELECT b.ts_code, name, industry, coalesce(main_business,'') AS main_business, coalesce(introduction,'') AS introduction, coalesce(business_scope,'') AS business_scope, b.k
  FROM stock_basic b LEFT JOIN stock_company c ON c.ts_code=b.ts_code WHERE list_status='L'""")
cte("named", ("thm", "prof"), """
  SELECT ts_code, list(theme ORDER BY ord) AS themes FROM prof JOIN thm ON length(name)>=3 AND contains(told, name) GROUP BY 1""")


def profiles(spark, sf_dir):
    b = A.stock_basic(spark, sf_dir).where("list_status = 'L'").select("ts_code", "name", "industry", F.col("instrument_key").alias("k"))
    return b.join(A.stock_company(spark, sf_dir).select("ts_code", "main_business", "introduction", "business_scope"), "ts_code", "left")


def _named(spark, sf_dir):
    return saved(H.named_stocks(themes(spark, sf_dir), profiles(spark, sf_dir)), "named")


@query("theme_named_stocks", "J-14", ("named",), "SELECT ts_code, len(themes) AS n, array_to_string(themes,'|') AS themes FROM named")
def theme_named_stocks(spark, sf_dir):
    return _named(spark, sf_dir).select("ts_code", F.size("themes").cast("long").alias("n"), F.array_join("themes", "|").alias("themes"))


def _first_two(tokens, text, where="true"):
    return f"""SELECT ts_code, list(theme ORDER BY ord)[1:2] AS themes FROM (
      SELECT DISTINCT ts_code, ord, theme FROM prof JOIN {tokens} ON contains({text}, token) WHERE {where}) GROUP BY 1"""


# every third code has a match already, which stays
_HAS = "k % 3 = 0"


def _some(spark, sf_dir):
    return profiles(spark, sf_dir).withColumn("matched_themes", F.when(F.expr(_HAS), F.array(F.lit("kept"))).otherwise(F.array().cast("array<string>")))


@query("theme_heuristic_match", "J-15 F-28 P-11", ("prof", "tok_text"), f"""
  SELECT p.ts_code, coalesce(array_to_string(CASE WHEN {_HAS} THEN ['kept'] ELSE t.themes END,'|'),'') AS themes, CAST(NOT ({_HAS}) AND t.themes IS NULL AS INTEGER) AS off_theme
  FROM prof p LEFT JOIN ({_first_two('tok_text', "name||' '||industry||' '||main_business||' '||business_scope||' '||introduction")}) t USING (ts_code)""")
def theme_heuristic_match(spark, sf_dir):
    out = H.with_off_theme(H.heuristic_match(themes(spark, sf_dir), _some(spark, sf_dir)))
    return out.select("ts_code", F.array_join("matched_themes", "|").alias("themes"), F.col("off_theme").cast("int").alias("off_theme"))


@query("theme_industry_fallback", "J-16 F-28", ("prof", "tok_industry"), f"""
  SELECT p.ts_code, coalesce(array_to_string(CASE WHEN {_HAS} THEN ['kept'] ELSE t.themes END,'|'),'') AS themes
  FROM prof p LEFT JOIN ({_first_two('tok_industry', 'industry')}) t USING (ts_code)""")
def theme_industry_fallback(spark, sf_dir):
    return H.industry_match(themes(spark, sf_dir), _some(spark, sf_dir)).select("ts_code", F.array_join("matched_themes", "|").alias("themes"))


# model answers: a batch of five codes each, in the forms that models give
def items(spark, sf_dir):
    return profiles(spark, sf_dir).select(F.floor(F.col("k") / 5).cast("long").alias("batch"), "ts_code", "k")


def answers(spark, sf_dir):
    """An answer per batch. By batch modulo 6: as asked, with spaces in names, turned round, in notes only, cut off, fenced with a theme that isn't there."""
    each = items(spark, sf_dir).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("k", "ts_code"))).alias("i"))
    b = F.col("batch") % 6

    def joined(make):
        return F.array_join(F.transform("i", make), ",")

    def said(i):  # three themes of a code: its own number's, and two others that exist in tables large enough
        return [i["k"].cast("string"), (i["k"] * 3 % 50).cast("string"), (i["k"] + 1).cast("string")]

    q, mark = F.lit('"'), F.when(b == 1, "T ").otherwise("T")
    normal = joined(lambda i: F.concat(q, i["ts_code"], F.lit('":["'), mark, said(i)[0], F.lit('","'), mark, said(i)[1], F.lit('","'), F.when(b == 5, "X").otherwise(mark), said(i)[2], F.lit('"]')))
    turned = joined(lambda i: F.concat(F.lit('"T '), said(i)[0], F.lit('":["'), i["ts_code"], F.lit('"]')))
    notes = joined(lambda i: F.concat(q, i["ts_code"], F.lit('":"直接 T '), said(i)[0], F.lit(' / T'), said(i)[1], q))
    matches = F.when(b == 2, turned).when(b == 3, '').otherwise(normal)
    body = F.concat(F.lit('{"matches":{'), matches, F.lit('},"notes":{'), notes, F.lit('}}'))
    content = F.when(b == 4, F.substring(body, 1, 40)).when(b == 5, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return each.select("batch", content.alias("content"))


def _sql_said(f):
    return {"a": "k", "b": "k*3%50", "c": "k+1"}[f]


cte("ans", ("prof",), f"""
  SELECT batch, CASE batch%6 WHEN 4 THEN substr(body,1,40) WHEN 5 THEN '```json'||chr(10)||body||chr(10)||'```' ELSE body END AS content, codes FROM (
    SELECT batch, codes, '{{"matches":{{'||CASE batch%6 WHEN 2 THEN turned WHEN 3 THEN '' ELSE normal END||'}},"notes":{{'||notes||'}}}}' AS body FROM (
      SELECT batch, list(ts_code) AS codes,
        string_agg('"'||ts_code||'":["'||m||k||'","'||m||({_sql_said('b')})||'","'||CASE WHEN batch%6=5 THEN 'X' ELSE m END||({_sql_said('c')})||'"]', ',' ORDER BY k) AS normal,
        string_agg('"T '||k||'":["'||ts_code||'"]', ',' ORDER BY k) AS turned,
        string_agg('"'||ts_code||'":"直接 T '||k||' / T'||({_sql_said('b')})||'"', ',' ORDER BY k) AS notes
      FROM (SELECT *, k//5 AS batch, CASE WHEN (k//5)%6=1 THEN 'T ' ELSE 'T' END AS m FROM prof) GROUP BY batch))""")
# written from the rule: keys that are codes; else lists of codes; else notes
cte("picks_said", ("ans", "thm"), r"""
  WITH t AS (SELECT batch, codes, regexp_replace(regexp_replace(trim(content),'^```[a-zA-Z]*\s*',''),'\s*```$','') AS body FROM ans),
  g AS (SELECT batch, codes, CAST(json_extract(body,'$.matches') AS MAP(VARCHAR, VARCHAR[])) AS m, CAST(json_extract(body,'$.notes') AS MAP(VARCHAR, VARCHAR)) AS n FROM t WHERE json_valid(body)),
  e AS (SELECT batch, codes, n, unnest(map_entries(m)) AS x FROM g),
  r AS (SELECT batch, bool_or(list_contains(codes, x.key)) AS keyed FROM e GROUP BY 1),
  direct AS (SELECT batch, x.key AS ts_code, unnest(x.value) AS said, generate_subscripts(x.value,1)-1 AS pos FROM e WHERE list_contains(codes, x.key)),
  turned AS (SELECT e.batch, unnest(x.value) AS ts_code, theme AS said, ord AS pos FROM e JOIN r ON r.batch=e.batch AND NOT keyed JOIN thm ON regexp_replace(x.key,'\s+','','g')=theme WHERE len(list_filter(x.value, lambda v: NOT list_contains(codes, v)))=0),
  noted AS (SELECT batch, c AS ts_code, theme AS said, ord AS pos FROM (SELECT batch, n, unnest(codes) AS c FROM g WHERE batch NOT IN (SELECT batch FROM direct UNION SELECT batch FROM turned)) JOIN thm ON contains(regexp_replace(n[c],'\s+','','g'), theme))
  SELECT s.batch, ts_code, pos, theme FROM (SELECT * FROM direct UNION ALL SELECT * FROM turned UNION ALL SELECT * FROM noted) s JOIN thm ON regexp_replace(said,'\s+','','g')=theme""")


def _decoded(spark, sf_dir):
    """Picks, damaged answers and the themes without their texts; picks and themes are written once, as several joins read them."""
    t = saved(themes(spark, sf_dir).select("theme", "ord", "keywords"), "themes")
    picks, damaged = H.decoded_answers(answers(spark, sf_dir), items(spark, sf_dir), t)
    return saved(picks, "picks"), damaged, t


@query("theme_answers", "T-14", ("picks_said", "ans"), """
  SELECT batch, ts_code, CAST(pos AS BIGINT) AS pos, theme, 0 AS damaged FROM picks_said
  UNION ALL SELECT batch, NULL, NULL, NULL, 1 FROM ans WHERE batch%6=4""")
def theme_answers(spark, sf_dir):
    picks, damaged, _ = _decoded(spark, sf_dir)
    none = F.lit(None)
    return picks.select("batch", "ts_code", F.col("pos").cast("long").alias("pos"), "theme", F.lit(0).alias("damaged")).union(
        damaged.select("batch", none.cast("string"), none.cast("long"), none.cast("string"), F.lit(1)))


cte("checked", ("picks_said", "tok_check", "prof", "named"), """
  SELECT s.ts_code, s.pos, s.theme, m>=1 OR b>=2 AS strict, m>=1 OR b>=2 OR f>=2 OR n.ts_code IS NOT NULL AS relaxed FROM picks_said s LEFT JOIN (
    SELECT ts_code, theme, count(*) FILTER (contains(main_business,token)) AS m, count(*) FILTER (contains(main_business||' '||introduction,token)) AS b,
      count(*) FILTER (contains(main_business||' '||introduction||' '||business_scope,token)) AS f
    FROM (SELECT DISTINCT ts_code, theme FROM picks_said) JOIN (SELECT DISTINCT theme, token FROM tok_check) USING (theme) JOIN prof USING (ts_code) GROUP BY 1,2) h
    ON h.ts_code=s.ts_code AND h.theme=s.theme LEFT JOIN named n ON n.ts_code=s.ts_code""")


@query("theme_picks_checked", "J-17 F-28", ("checked",), """
  SELECT ts_code, pos, theme, 'strict' AS rule FROM checked WHERE strict UNION ALL SELECT ts_code, pos, theme, 'relaxed' FROM checked WHERE relaxed""")
def theme_picks_checked(spark, sf_dir):
    picks, _, t = _decoded(spark, sf_dir)
    picks, p = picks.select("ts_code", F.col("pos").cast("long").alias("pos"), "theme"), profiles(spark, sf_dir)
    strict = H.checked_picks(picks, t, p)
    relaxed = H.checked_picks(picks, t, p, _named(spark, sf_dir), relaxed=True)
    return strict.withColumn("rule", F.lit("strict")).union(relaxed.withColumn("rule", F.lit("relaxed")))


@query("theme_merge", "J-18 P-11", ("checked", "named", "prof"), """
  SELECT ts_code, coalesce(array_to_string(list_concat(p, list_filter(coalesce(n,[]), lambda x: NOT list_contains(p, x))),'|'),'') AS themes, CAST(len(p)+len(coalesce(n,[]))=0 AS INTEGER) AS off_theme
  FROM (SELECT prof.ts_code, coalesce(p,[]) AS p, n.themes AS n FROM prof
    LEFT JOIN (SELECT ts_code, list(theme ORDER BY pos) AS p FROM (SELECT ts_code, theme, min(pos) AS pos FROM checked WHERE relaxed GROUP BY 1,2) GROUP BY 1) c ON c.ts_code=prof.ts_code
    LEFT JOIN named n ON n.ts_code=prof.ts_code)""")
def theme_merge(spark, sf_dir):
    picks, _, t = _decoded(spark, sf_dir)
    named, p = _named(spark, sf_dir), profiles(spark, sf_dir)
    once = H.checked_picks(picks.select("ts_code", "pos", "theme"), t, p, named, relaxed=True).groupBy("ts_code", "theme").agg(F.min("pos").alias("pos"))
    out = H.merged(p, once, named)
    return out.select("ts_code", F.array_join("matched_themes", "|").alias("themes"), F.col("off_theme").cast("int").alias("off_theme"))


# regulatory events and the verdict of a name
_REG = [("hand", "被出具问询函"), ("eren", "收到行政处罚")]
_reg = "snippet"
for _w, _t in _REG:
    _reg = f"replace({_reg}, '{_w}', '{_t}')"
cte("rhits", ("hits",), f"SELECT * REPLACE ({_reg} AS snippet) FROM hits")
_PARTS = "string_split_regex(title||chr(10)||snippet,'[\\n。；;！!？?]')"
cte("sev", ("rhits",), f"""
  SELECT doc_id, bool_or(regexp_matches(s,'{X.SEVERE_REGULATORY}')) AS severe, bool_or(regexp_matches(s,'{X.MINOR_REGULATORY}')) AS minor FROM (
    SELECT doc_id, name, symbol, unnest({_PARTS}) AS s FROM rhits WHERE NOT (doc_id%7=0 AND symbol<>'600000') AND DATE '{AS_OF}'-dt<=60)
  WHERE contains(s,name) OR contains(s,symbol) GROUP BY 1""")


def regulatory_hits(spark, sf_dir):
    h, snippet = A.search_hits(spark, sf_dir), F.col("snippet")
    for word, shown in _REG:
        snippet = F.replace(snippet, F.lit(word), F.lit(shown))
    return V.regulatory(h.withColumn("snippet", snippet), AS_OF, 60)


@query("regulatory_severity", "T-5", ("sev", "hits"), """
  SELECT h.doc_id, h.ts_code, CAST(coalesce(severe,false) AS INTEGER) AS severe, CAST(coalesce(minor,false) AS INTEGER) AS minor FROM hits h LEFT JOIN sev USING (doc_id)""")
def regulatory_severity(spark, sf_dir):
    return regulatory_hits(spark, sf_dir).select("doc_id", "ts_code", F.col("severe").cast("int").alias("severe"), F.col("minor").cast("int").alias("minor"))


_PRIMARY = " OR ".join(f"contains(url,'{d}')" for d in X.PRIMARY_SOURCES)


@query("merged_verdicts", "T-7", ("hits", "veto", "sev", "find", "stock_basic"), f"""
  WITH h AS (SELECT h.doc_id, h.ts_code, h.url, h.snippet, v.veto, coalesce(severe,false) AS severe, coalesce(minor,false) AS minor FROM hits h LEFT JOIN veto v USING (doc_id) LEFT JOIN sev USING (doc_id)),
  f AS (SELECT ts_code, count(*) AS n, list(DISTINCT doc_id ORDER BY doc_id) AS docs FROM find GROUP BY 1),
  op AS (SELECT ts_code, list(url ORDER BY doc_id)[1:2] AS links FROM h WHERE doc_id IN (SELECT doc_id FROM find) GROUP BY 1),
  d AS (SELECT ts_code, arg_min(veto, doc_id) FILTER (veto IS NOT NULL) AS veto, arg_min(url, doc_id) FILTER (veto IS NOT NULL) AS vurl, arg_max(url, doc_id) FILTER (severe) AS surl, bool_or(severe) AS severe, bool_or(minor) AS minor,
      list(url ORDER BY doc_id) FILTER ({_PRIMARY}) AS prim, list(url ORDER BY doc_id) AS flat FROM h GROUP BY 1),
  m AS (SELECT b.ts_code, ['pass','fail','warn'][b.k%3+1] AS soft, d.*, coalesce(f.n,0) AS n, coalesce(op.links,[]) AS links, (SELECT count(*) FROM h WHERE h.ts_code=b.ts_code AND contains(h.snippet,'订单')) AS snippets
    FROM stock_basic b LEFT JOIN d ON d.ts_code=b.ts_code LEFT JOIN f ON f.ts_code=b.ts_code LEFT JOIN op ON op.ts_code=b.ts_code),
  v AS (SELECT *, CASE WHEN veto IS NOT NULL THEN veto WHEN severe THEN 'severe_regulatory' END AS reason,
      CASE WHEN veto IS NOT NULL OR coalesce(severe,false) THEN 'fail' WHEN soft='fail' AND (n>=1 OR snippets>=2) THEN 'warn' ELSE soft END AS verdict,
      coalesce(prim, flat, [])[1:3] AS src FROM m)
  SELECT ts_code, verdict, reason, CAST(verdict<>'fail' AND coalesce(minor,false) AS INTEGER) AS noted,
    coalesce(CASE WHEN reason IS NOT NULL THEN coalesce(vurl, surl) ELSE array_to_string(list_concat(src, list_filter(links, lambda x: NOT list_contains(src,x))),'|') END,'') AS sources FROM v""")
def merged_verdicts(spark, sf_dir):
    h = regulatory_hits(spark, sf_dir)
    vetoed = V.hard_veto(A.search_hits(spark, sf_dir), AS_OF, 60, 0.03).select("doc_id", "veto", F.col("snippet").contains("订单").alias("_op"))
    h = h.select("doc_id", "ts_code", "url", "severe", "minor").join(vetoed, "doc_id")
    soft = A.stock_basic(spark, sf_dir).select("ts_code", F.element_at(F.array(F.lit("pass"), F.lit("fail"), F.lit("warn")), (F.col("instrument_key") % 3 + 1).cast("int")).alias("verdict"))
    found = V.positive_findings(A.search_hits(spark, sf_dir))
    links = top_n(found.select("ts_code", "doc_id", "source_url").distinct(), ["ts_code"], 2, F.col("doc_id"))
    links = links.groupBy("ts_code").agg(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "source_url"))), lambda x: x["source_url"]).alias("links"))
    count = found.groupBy("ts_code").agg(F.count(F.lit(1)).alias("findings"))
    snippets = h.where("_op").groupBy("ts_code").agg(F.count(F.lit(1)).alias("snippets"))
    f = soft.select("ts_code").join(count, "ts_code", "left").join(snippets, "ts_code", "left").join(links, "ts_code", "left")
    out = V.merged_verdicts(h, soft, f)
    return out.select("ts_code", "verdict", "reason", F.col("noted").cast("int").alias("noted"), F.array_join("sources", "|").alias("sources"))
