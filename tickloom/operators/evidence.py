"""Evidence hits: relevance, veto rules, findings, digest and chunks.

Every rule looks at one hit at a time; what is said about an instrument is an
aggregate with map-side combine, so an instrument with a third of all hits is safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions import text as X
from tickloom.operators.ranking import top_n


def identity(name: Column, symbol: Column, body: Column) -> Column:
    return body.contains(name) | body.contains(symbol)


def flatten_hits(payloads: DataFrame, body: str, keys: list[str], limit: int = 20) -> DataFrame:
    """Nested search payloads to hits under common names, one per link, at most `limit` per payload."""
    item = "struct<title:string,url:string,link:string,href:string,snippet:string,description:string,content:string,date:string,published:string,publishedDate:string>"
    parsed = F.from_json(body, f"struct<results:array<{item}>,hits:array<{item}>>")
    rows = payloads.select(*keys, F.posexplode(F.concat(F.coalesce(parsed["results"], F.array()), F.coalesce(parsed["hits"], F.array()))).alias("pos", "h"))
    h = rows.select(*keys, "pos", "h.title", F.coalesce("h.url", "h.link", "h.href").alias("url"),
                    F.coalesce("h.snippet", "h.description", "h.content").alias("snippet"), F.coalesce("h.date", "h.published", "h.publishedDate").alias("date"))
    first = h.groupBy(*keys, "url").agg(F.min(F.struct("pos", "title", "snippet", "date")).alias("m")).select(*keys, "url", "m.*")
    return top_n(first, keys, limit, F.col("pos"))


def compact(hits: DataFrame, snippet_chars: int = 500) -> DataFrame:
    """Presentation fields with their length limits and identity flags."""
    c = F.col
    sym = X.url_symbol(c("url"))
    return hits.select(
        "doc_id", "ts_code", F.substring("title", 1, 240).alias("title"), F.substring("snippet", 1, snippet_chars).alias("snippet"),
        F.substring("url", 1, 500).alias("url"), F.substring("date", 1, 80).alias("date"),
        identity(c("name"), c("symbol"), F.concat_ws("\n", "title", "snippet", "url")).alias("relevant"),
        F.coalesce(sym != c("symbol"), F.lit(False)).alias("code_mismatch"))


def hard_veto(hits: DataFrame, as_of: str, max_age: int, threshold: float, require_recency: bool = True) -> DataFrame:
    """Hits with the first veto reason of a sentence that names the instrument."""
    c = F.col
    body = F.concat_ws("\n", "title", "snippet")
    mismatch = F.coalesce(X.url_symbol(c("url")) != c("symbol"), F.lit(False))
    usable = ~mismatch & identity(c("name"), c("symbol"), body)
    if require_recency:
        usable = usable & X.is_recent(X.parse_date(c("date")), F.lit(as_of).cast("date"), max_age)
    about = F.filter(F.split(body, X.SENTENCE_END), lambda s: identity(F.col("name"), F.col("symbol"), s))
    reasons = F.filter(F.transform(about, lambda s: X.sentence_veto(s, threshold)), lambda r: r.isNotNull())
    return hits.withColumn("veto", F.when(usable, F.try_element_at(reasons, F.lit(1))))


def regulatory(hits: DataFrame, as_of: str, max_age: int) -> DataFrame:
    """Hits with `severe` and `minor`: a recent hit, not of another code, with a sentence that names the instrument and such an event."""
    c = F.col
    mismatch = F.coalesce(X.url_symbol(c("url")) != c("symbol"), F.lit(False))
    recent = X.is_recent(X.parse_date(c("date")), F.lit(as_of).cast("date"), max_age) & ~mismatch
    told = F.split(F.concat_ws("\n", "title", "snippet"), X.SENTENCE_END)

    def says(pattern: str) -> Column:
        return recent & F.exists(told, lambda s: identity(F.col("name"), F.col("symbol"), s) & s.rlike(pattern))

    return hits.withColumns({"severe": says(X.SEVERE_REGULATORY), "minor": says(X.MINOR_REGULATORY)})


def merged_verdicts(hits: DataFrame, soft: DataFrame, findings: DataFrame, order: str = "doc_id") -> DataFrame:
    """One verdict per instrument with the reason that decided, whether a minor event is noted, and at most five sources.

    hits: ts_code, url, veto, severe, minor, in `order`. soft: ts_code, verdict, as a model gives it. findings: ts_code, findings,
    snippets, links. The first veto of a hit fails a name; else the last severe event does; both keep only the link that decided. Else the model's
    verdict holds, but its fail becomes a warning beside a finding or two snippets. The sources are then three links, of primary
    sources where there are any, and two of the findings'. One aggregation over the hits, rows of one name combined before the shuffle."""
    c = F.col
    at = F.struct(order, c("url"))
    decided = hits.groupBy("ts_code").agg(
        F.min(F.when(c("veto").isNotNull(), F.struct(order, "veto", "url"))).alias("_first"), F.max(F.when(c("severe"), at)).alias("_severe"), F.max("minor").alias("_minor"))
    primary = F.lit(False)
    for domain in X.PRIMARY_SOURCES:
        primary = primary | c("url").contains(domain)
    links = hits.where("length(url) > 0").groupBy("ts_code", "url").agg(F.min(order).alias("_at")).withColumn("_primary", primary)
    links = top_n(links, ["ts_code"], 3, F.desc("_primary"), c("_at")).groupBy("ts_code").agg(
        F.array_sort(F.collect_list(F.struct("_at", "url"))).alias("_l"), F.max("_primary").alias("_any"))
    some = F.transform(F.filter("_l", lambda x: ~F.col("_any") | x["url"].rlike("|".join(d.replace(".", "[.]") for d in X.PRIMARY_SOURCES))), lambda x: x["url"])
    links = links.select("ts_code", some.alias("_links"))
    j = soft.select("ts_code", c("verdict").alias("_soft")).join(decided, "ts_code", "left").join(links, "ts_code", "left").join(findings, "ts_code", "left")
    hard = F.when(c("_first").isNotNull(), c("_first.veto")).when(c("_severe").isNotNull(), "severe_regulatory")
    trigger = F.when(c("_first").isNotNull(), c("_first.url")).otherwise(c("_severe.url"))
    good = (F.coalesce("findings", F.lit(0)) >= 1) | (F.coalesce("snippets", F.lit(0)) >= 2)
    verdict = F.when(hard.isNotNull(), "fail").when((c("_soft") == "fail") & good, "warn").otherwise(c("_soft"))
    none = F.array().cast("array<string>")
    every = F.array_distinct(F.concat(F.coalesce("_links", none), F.slice(F.coalesce("links", none), 1, 2)))
    return j.select("ts_code", verdict.alias("verdict"), hard.alias("reason"), ((verdict != "fail") & F.coalesce("_minor", F.lit(False))).alias("noted"),
                    F.when(hard.isNotNull() & (F.length(trigger) > 0), F.array(trigger)).otherwise(every).alias("sources"))


def positive_findings(hits: DataFrame) -> DataFrame:
    """One row per hit and category whose words it carries, with confidence from source and word count."""
    text = F.concat_ws(" ", "title", "snippet")
    cats = F.explode(F.array(*[
        F.struct(F.lit(k).alias("category"), sum((F.when(text.contains(w), 1).otherwise(0) for w in words), F.lit(0)).alias("words"))
        for k, words in X.FINDING_WORDS.items()]))
    f = hits.where(text.contains(F.col("name"))).select("doc_id", "ts_code", "url", "title", "snippet", "date", cats.alias("k")).where("k.words > 0")
    conf = (X.source_tier(F.col("url")) + F.least(F.lit(1.0), F.col("k.words") * 0.3)) / 2
    return f.select("doc_id", "ts_code", "k.category", F.substring("title", 1, 100).alias("description"),
                    F.substring("snippet", 1, 300).alias("evidence"), F.round(conf, 2).alias("confidence"), F.col("url").alias("source_url"), "date")


def expand_queries(basic: DataFrame) -> DataFrame:
    """Search texts per instrument from the category templates."""
    t = F.explode(F.array(*[F.struct(F.lit(k).alias("category"), F.lit(i).alias("n"), F.lit(q).alias("t"))
                            for k, qs in X.QUERY_TEMPLATES.items() for i, q in enumerate(qs)]))
    return basic.select("ts_code", "name", t.alias("q")).select("ts_code", "q.category", F.col("q.n").alias("template"),
                                                                F.replace(F.col("q.t"), F.lit("{name}"), F.col("name")).alias("query"))


def chunk_items(df: DataFrame, items: str, budget: int, out: str = "chunk") -> DataFrame:
    """Splits an ordered array of texts into chunks under a token budget, without leaving the row.

    A token is half a character pair; the budget is 50 at least; an oversized text fills a chunk of its own and is cut to
    twice the budget less 1000 characters, 120 at least. Adds `<out>` (chunk numbers) and replaces the texts by their cuts.
    """
    budget = max(50, budget)
    most = max(120, budget * 2 - 1000)
    need = lambda t: F.ceil(F.length(t) / 2).cast("int")
    none = F.array().cast("array<struct<at:int,chunk:int>>")
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("used"), F.lit(0).alias("at"), F.lit(-1).alias("last"), none.alias("starts"))

    def step(acc: Column, text: Column) -> Column:
        n = need(text)
        full = (acc["used"] > 0) & (acc["used"] + n > budget)
        own = n > budget
        chunk = acc["chunk"] + F.when(full, 1).otherwise(0)
        begun = F.array(F.struct(acc["at"].alias("at"), chunk.alias("chunk")))
        return F.struct(
            F.when(own, chunk + 1).otherwise(chunk).alias("chunk"),
            F.when(own, 0).otherwise(F.when(full, 0).otherwise(acc["used"]) + n).alias("used"),
            (acc["at"] + 1).alias("at"), chunk.alias("last"),
            F.when(chunk == acc["last"], acc["starts"]).otherwise(F.concat(acc["starts"], begun)).alias("starts"))

    # only where chunks start is carried along; each start then stands for the items up to the next
    df = df.withColumn("_starts", F.aggregate(items, start, step, lambda a: a["starts"]))
    ends = lambda i: F.coalesce(F.get(F.col("_starts"), i + 1)["at"], F.size(items))
    df = df.withColumn(out, F.flatten(F.transform("_starts", lambda s, i: F.array_repeat(s["chunk"], ends(i) - s["at"])))).drop("_starts")
    return df.withColumn(items, F.transform(items, lambda t: F.when(need(t) > budget, F.substring(t, 1, most)).otherwise(t)))


def theme_matches(texts: DataFrame, text_col: str, themes: dict[str, list[str]], keys: list[str], most: int = 2) -> DataFrame:
    """First themes, in theme order, with any token inside the text."""
    cond = [F.when(F.exists(X.tokens(F.lit(" ".join([n, *kws]))), lambda t: F.col(text_col).contains(t)), n) for n, kws in themes.items()]
    return texts.withColumn("matched_themes", F.slice(F.filter(F.array(*cond), lambda x: x.isNotNull()), 1, most))


def token_hits(texts: DataFrame, text_col: str, themes: dict[str, list[str]], keys: list[str]) -> DataFrame:
    """Distinct theme tokens found in any text of a key."""
    per = F.explode(F.array(*[F.struct(F.lit(n).alias("theme"), X.tokens(F.lit(" ".join([n, *kws]))).alias("toks")) for n, kws in themes.items()]))
    m = texts.select(*keys, text_col, per.alias("p"))
    found = m.select(*keys, "p.theme", F.explode(F.filter("p.toks", lambda t: F.col(text_col).contains(t))).alias("tok"))
    return found.distinct().groupBy(*keys, "theme").agg(F.count(F.lit(1)).alias("hits"))
