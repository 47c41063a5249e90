"""URL filter: rules by host and path, and a logistic regression on hashed character n-grams for the rest.

The model is trained on a small labelled URL table (at most MOST_LABELLED rows; more is refused rather than sampled) with
Spark's own logistic regression. Features are counts of 3- to 5-grams of the host and, apart from it, of the path, hashed
into BUCKETS columns. Scoring is a sum over the n-grams of a URL in SQL functions; the weights, BUCKETS doubles, travel as
one literal.

The rules are a short list and become one expression. A rule fits its host and the host's subdomains if the path starts
with the rule's; the longest fitting rule wins, by the length of host and path together, ties to the smaller rule text.

Defined cases: a null URL, or one without `://`, has an empty host and path and is scored like any other; an empty rule or
label table is allowed (no rule fits; without both labels everything is allowed); repeated rows and null ids give a row
each; other columns of the input are ignored.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS, SIZES, MOST_LABELLED = 4096, (3, 4, 5), 100_000
#: Log-odds above which the model blocks: two to one.
BLOCK_ABOVE = 0.693

#: Fixed values of the contract: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: The small labelled table: kinds of sites nobody wants in a corpus, and ordinary ones.
BLOCKED = ["casino-royal.example/slots/1", "online-casino.example/play", "win-casino.example/bonus", "best-bets.example/odds", "free-bets.example/tips/77",
           "sport-bets.example/live", "poker-win.example/table/3", "jackpot.example/slots", "cheap-pills.example/order", "buy-pills.example/blue/2",
           "pills-shop.example/cheap", "meds-cheap.example/no-rx", "adult-video.example/1", "xxx-adult.example/cams", "adult-chat.example/girls", "hot-cams.example/xxx",
           "ads-click.example/r?u=1", "track-ads.example/pixel.gif", "ads-server.example/banner/9", "click-track.example/go", "pop-ads.example/ad.js",
           "spam-links.example/page/4", "link-farm.example/seo", "seo-spam.example/buy-links", "spamfarm.example/cheap/2", "content-farm.example/spin", "adult-pics.example/gallery/8", "x-adult.example/free", "www.adult-zone.example/en/31", "m.casino-top.example/de/52",
           "pills24.example/fr/12.html", "bets-today.example/es/905", "blog.spam-net.example/en/7", "www.ads-hub.example/en/66?ref=x", "farm-spam.example/en/18"]
ALLOWED = ["news.example/world/2020/1", "www.university.example/en/courses", "library.example/catalog/55", "blog.gardening.example/tomatoes", "docs.project.example/guide/intro",
           "www.museum.example/fr/visite", "recipes.example/de/kuchen", "www.city.example/es/transporte", "weather.example/today", "history.example/en/771",
           "m.travel.example/en/25", "forum.cycling.example/thread/901", "www.school.example/de/klasse", "science.example/article/42.html", "www.theatre.example/season",
           "math.example/en/9437", "blog.nation.example/en/512", "the-hospital.example/contact", "www.station.example/fr/842", "books.example/author/7",
           "radio.example/es/4833/", "www.council.example/agenda", "m.theatre.example/de/6928.html", "translation.example/en/16?page=2", "physics.example/lecture/3", "maps.example/region/12",
           "www.thornton.example/en/2001", "blog.tinder-box.example/de/14", "m.whether.example/en/88.html", "three-rivers.example/fr/61", "www.northern.example/en/5530",
           "antenna.example/es/73", "m.ontheroad.example/en/404/", "www.shed.example/de/9", "blog.ouest.example/fr/320", "www.thing.example/en/12#top"]


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, blocked), the built-in table."""
    rows = [("https://" + u, 1) for u in BLOCKED] + [("https://" + u, 0) for u in ALLOWED]
    return spark.createDataFrame(rows, "url string, blocked int").coalesce(1)


def host_path(urls: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.locate("://", u) > 0, F.expr(f"substring({url}, locate('://', {url}) + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return urls.withColumns({"host": lowered, "path": F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)})


def _grams(text: Column, mark: str) -> Column:
    """Bucket numbers of the n-grams of one part, marked with the part and fenced at both ends."""
    fenced = F.concat(F.lit("^"), text, F.lit("$"))

    def of(n: int) -> Column:
        starts = F.when(F.char_length(fenced) >= n, F.sequence(F.lit(1), F.char_length(fenced) - (n - 1)))
        return F.coalesce(F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(mark), F.substring(fenced, i, F.lit(n))), F.lit(BUCKETS)).cast("int")), F.array())

    return F.concat(*[of(n) for n in SIZES])


def features(parts: DataFrame) -> DataFrame:
    """Adds grams: bucket numbers, repeats included, of host and path."""
    return parts.withColumn("grams", F.concat(_grams(F.col("host"), "h"), _grams(F.col("path"), "p")))


def train(labelled: DataFrame) -> tuple[list[float], float] | None:
    """Weights by bucket and intercept from (url, blocked); None where a label is missing."""
    own = labelled.where("url IS NOT NULL AND blocked IN (0, 1)")
    sizes = {r.blocked: r["count"] for r in own.groupBy("blocked").count().collect()}
    if sum(sizes.values()) > MOST_LABELLED:
        raise ValueError(f"{sum(sizes.values())} labelled URLs; at most {MOST_LABELLED} are meant")
    if len(sizes) < 2:
        return None
    numbered = features(host_path(own)).withColumn("id", F.xxhash64("url", "blocked"))
    counts = numbered.select("id", F.col("blocked").cast("double").alias("label"), F.explode("grams").alias("b")).groupBy("id", "label", "b").agg(F.count(F.lit(1)).alias("n"))
    packed = counts.groupBy("id", "label").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("n"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda k: F.coalesce(F.element_at("n", k), F.lit(0)).cast("double"))
    model = LogisticRegression(maxIter=50, regParam=0.002, standardization=False).fit(packed.orderBy("id").coalesce(1).select("label", array_to_vector(dense).alias("features")))
    return [float(w) for w in model.coefficients], float(model.intercept)


def judge(urls: DataFrame, labelled: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """urls with host, path, rule, score (log-odds of being blocked) and verdict: the longest fitting rule's, else the model's."""
    model = train(labelled)
    df = features(host_path(urls.drop("host", "path", "grams", "rule", "score", "verdict"), url))
    if model:
        weights = F.from_json(F.lit(json.dumps(model[0])), "array<double>")
        df = df.withColumn("score", F.aggregate(F.transform("grams", lambda b: F.get(weights, b)), F.lit(model[1]), lambda a, w: a + w))
    else:
        df = df.withColumn("score", F.lit(-1.0))
    fitting = [F.when(((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p),
                      F.struct(F.lit(-len(h + p)).alias("long"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in rules]
    best = F.array_min(F.array_compact(F.array(*fitting))) if fitting else F.lit(None).cast("struct<long:int,rule:string,verdict:string>")
    return df.withColumn("_best", best).withColumns({
        "rule": F.col("_best.rule"), "verdict": F.coalesce(F.col("_best.verdict"), F.when(F.col("score") > BLOCK_ABOVE, "block").otherwise("allow"))}).drop("_best", "grams")
