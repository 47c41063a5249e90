"""Themes as a table: named stocks, token matches, validation, model answers and their merge.

A theme is a row (theme, ord, keywords, capital_signal, evidence, status); a candidate is a row of a profile table. Nothing here
holds a list of themes in code, so both tables may grow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.operators.containment import contained

#: Words that tell no theme, for text matches, for industry matches and for the check of picked matches.
TEXT_STOP = ["主题", "板块", "产业", "行业", "概念"]
INDUSTRY_STOP = ["主题", "板块", "产业", "行业", "概念", "方向"]
CHECK_STOP = ["题材", "板块", "产业", "行业", "应用", "前沿", "高端", "制造"]


def theme_tokens(themes: DataFrame, stop: list[str]) -> DataFrame:
    """(theme, ord, token): distinct words of two characters or more of a theme's name and keywords."""
    text = F.concat_ws(" ", "theme", F.coalesce("keywords", F.array().cast("array<string>")))
    words = F.split(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " "), " ")
    kept = F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(stop)))
    return themes.where("length(theme) > 0").select("theme", "ord", F.explode(kept).alias("token"))


def named_stocks(themes: DataFrame, names: DataFrame, least: int = 3) -> DataFrame:
    """(ts_code, themes): for each name of `least` characters or more, the themes whose capital signal or evidence names it, in theme order.

    names: ts_code, name; of rows with one name the last code counts."""
    text = F.concat(F.coalesce("capital_signal", F.lit("")), F.lit(" "), F.coalesce("evidence", F.lit("")))
    own = names.select(F.trim("name").alias("pattern"), F.trim("ts_code").alias("ts_code")).where((F.length("pattern") >= least) & (F.length("ts_code") > 0))
    code = own.groupBy("pattern").agg(F.max("ts_code").alias("ts_code"))
    found = contained(own, themes.select(F.struct("ord", "theme").alias("tid"), text.alias("text"))).join(code, "pattern")
    first = found.select("ts_code", "tid.theme", "tid.ord").groupBy("ts_code", "theme").agg(F.min("ord").alias("ord"))
    return first.groupBy("ts_code").agg(F.array_sort(F.collect_list(F.struct("ord", "theme"))).alias("t")).select("ts_code", F.col("t.theme").alias("themes"))


def token_match(themes: DataFrame, candidates: DataFrame, text: Column, stop: list[str], most: int = 2) -> DataFrame:
    """candidates (ts_code, matched_themes, ...) where those without a match get the first `most` themes, in theme order, of which a token stands in the text.

    A theme among a candidate's first is among the first of each of its tokens, so a token keeps `most` themes before the join."""
    tokens = theme_tokens(themes, stop)
    short = tokens.withColumn("_k", F.row_number().over(Window.partitionBy("token").orderBy("ord", "theme"))).where(F.col("_k") <= most)
    none = F.size(F.coalesce("matched_themes", F.array().cast("array<string>"))) == 0
    texts = candidates.where(none).select(F.col("ts_code").alias("tid"), text.alias("text"))
    found = contained(tokens.select(F.col("token").alias("pattern")), texts).join(short.withColumnRenamed("token", "pattern"), "pattern")
    ordered = found.select(F.col("tid").alias("ts_code"), "ord", "theme").distinct()
    ordered = ordered.withColumn("_k", F.row_number().over(Window.partitionBy("ts_code").orderBy("ord", "theme"))).where(F.col("_k") <= most)
    new = ordered.groupBy("ts_code").agg(F.array_sort(F.collect_list(F.struct("ord", "theme"))).alias("_new")).select("ts_code", F.col("_new.theme").alias("_new"))
    kept = F.when(none, F.coalesce("_new", F.array().cast("array<string>"))).otherwise(F.col("matched_themes"))
    return candidates.join(new, "ts_code", "left").withColumn("matched_themes", kept).drop("_new")


def heuristic_match(themes: DataFrame, candidates: DataFrame) -> DataFrame:
    """token_match on all fields of the profile."""
    fields = [F.coalesce(c, F.lit("")) for c in ("name", "industry", "main_business", "business_scope", "introduction")]
    return token_match(themes, candidates, F.concat_ws(" ", *fields), TEXT_STOP)


def industry_match(themes: DataFrame, candidates: DataFrame) -> DataFrame:
    return token_match(themes, candidates, F.coalesce("industry", F.lit("")), INDUSTRY_STOP)


def checked_picks(picks: DataFrame, themes: DataFrame, profiles: DataFrame, named: DataFrame | None = None, relaxed: bool = False) -> DataFrame:
    """picks (ts_code, pos, theme) whose theme has a token in the main business, or two in main business and introduction.

    relaxed: also two with the business scope, and every pick of a named code (named: ts_code). Picks of codes without a profile stay."""
    p = profiles.select("ts_code", F.coalesce("main_business", F.lit("")).alias("_main"), F.coalesce("introduction", F.lit("")).alias("_intro"),
                        F.coalesce("business_scope", F.lit("")).alias("_scope"), F.lit(True).alias("_known"))
    both = F.concat_ws(" ", "_main", "_intro")
    tokens = theme_tokens(themes, CHECK_STOP).select("theme", "token").distinct()
    hit = picks.select("ts_code", "theme").distinct().join(tokens, "theme").join(p, "ts_code")
    counts = hit.groupBy("ts_code", "theme").agg(
        F.count_if(F.col("_main").contains(F.col("token"))).alias("_m"), F.count_if(both.contains(F.col("token"))).alias("_b"),
        F.count_if(F.concat_ws(" ", both, "_scope").contains(F.col("token"))).alias("_f"))
    ok = (F.col("_m") >= 1) | (F.col("_b") >= 2)
    out = picks.join(counts, ["ts_code", "theme"], "left").join(p.select("ts_code", "_known"), "ts_code", "left")
    if relaxed:
        ok = ok | (F.col("_f") >= 2)
        if named is not None:
            out = out.join(named.select("ts_code", F.lit(True).alias("_named")).distinct(), "ts_code", "left")
            ok = ok | F.col("_named")
    return out.where(F.col("_known").isNull() | F.coalesce(ok, F.lit(False))).select(*picks.columns)


def merged(candidates: DataFrame, picks: DataFrame, named: DataFrame) -> DataFrame:
    """candidates with matched_themes, picked themes in their order and then named ones, each once, and off_theme where there are none."""
    none = F.array().cast("array<string>")
    own = picks.groupBy("ts_code").agg(F.array_sort(F.collect_list(F.struct("pos", "theme"))).alias("_p")).select("ts_code", F.col("_p.theme").alias("_p"))
    out = candidates.join(own, "ts_code", "left").join(named.select("ts_code", F.col("themes").alias("_n")), "ts_code", "left")
    both = F.array_distinct(F.concat(F.coalesce("_p", none), F.coalesce("_n", none)))
    return with_off_theme(out.withColumn("matched_themes", F.when(F.col("_n").isNull(), F.coalesce("_p", none)).otherwise(both)).drop("_p", "_n"))


def with_off_theme(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("off_theme", F.size("matched_themes") == 0)


def _plain(c: Column) -> Column:
    """A name without white space, by which model spellings are compared."""
    return F.regexp_replace(c, r"\s+", "")


def decoded_answers(answers: DataFrame, items: DataFrame, themes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model answers (batch, content) to picks (batch, ts_code, pos, theme) of the batch's items (batch, ts_code), and the damaged answers (batch, content).

    The content is JSON with `matches` and `notes`, maybe between fences. Keys of `matches` should be codes. If none is one of the
    batch, lists of codes under a theme are turned round; if that gives nothing, themes that a code's note names are taken, in theme order. Theme names
    are compared without white space, and those that aren't in the table go. An answer that is no JSON object is damaged."""
    text = F.trim(F.regexp_replace(F.regexp_replace(F.trim("content"), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))
    parsed = F.from_json(text, "struct<matches:map<string,string>,notes:map<string,string>>")
    read = answers.select("batch", "content", text.alias("_t"), parsed.alias("_j"))
    whole = F.col("_t").startswith("{") & F.expr("try_parse_json(_t)").isNotNull()
    damaged = read.where(~F.coalesce(whole, F.lit(False))).select("batch", "content")
    good = read.where(whole).select("batch", "_j.matches", "_j.notes")
    names = themes.where("length(theme) > 0").groupBy("theme").agg(F.min("ord").alias("ord"))
    spelled = names.select("theme", "ord", _plain(F.col("theme")).alias("_plain")).groupBy("_plain").agg(F.max_by("theme", "ord").alias("theme"))  # of two that look alike the last
    listed = good.select("batch", F.explode("matches").alias("key", "value"))
    listed = listed.select("batch", "key", F.from_json(F.when(F.col("value").startswith("["), F.col("value")), "array<string>").alias("values"))
    codes = items.select("batch", "ts_code").distinct()
    keyed = listed.join(codes.withColumnRenamed("ts_code", "key").withColumn("_code", F.lit(True)), ["batch", "key"], "left")
    right = keyed.groupBy("batch").agg(F.max(F.coalesce("_code", F.lit(False))).alias("_right"))
    keyed = keyed.join(right, "batch")
    direct = keyed.where("_code").select("batch", F.col("key").alias("ts_code"), F.posexplode("values").alias("pos", "said"))
    # the other way round: a theme with codes of the batch and nothing else
    turned = keyed.where("NOT _right").select("batch", "key", "values", F.posexplode_outer("values").alias("pos", "ts_code")).join(
        codes.withColumn("_code2", F.lit(True)), ["batch", "ts_code"], "left")
    sound = turned.groupBy("batch", "key").agg(F.count("ts_code").alias("n"), F.count("_code2").alias("known")).where("n > 0 AND n = known")
    turned = turned.join(sound.select("batch", "key"), ["batch", "key"]).withColumn("_plain", _plain(F.col("key"))).join(spelled, "_plain").join(names, "theme")
    turned = turned.select("batch", "ts_code", F.col("ord").cast("int").alias("pos"), F.col("theme").alias("said"))
    # lists that hold a theme under a key that is no code keep the notes from being read
    kept = keyed.where("NOT _right").select("batch", F.explode("values").alias("said")).withColumn("_plain", _plain(F.col("said"))).join(spelled, "_plain").select("batch")
    done = kept.union(turned.select("batch")).union(right.where("_right").select("batch")).distinct()
    notes = good.join(done, "batch", "left_anti").select("batch", F.explode("notes").alias("ts_code", "note")).join(codes, ["batch", "ts_code"])
    said = contained(spelled.select(F.col("_plain").alias("pattern")), notes.select(F.struct("batch", "ts_code").alias("tid"), _plain(F.col("note")).alias("text")))
    noted = said.join(spelled.withColumnRenamed("_plain", "pattern"), "pattern").join(names, "theme").select(
        "tid.batch", "tid.ts_code", F.col("ord").cast("int").alias("pos"), F.col("theme").alias("said"))
    every = direct.union(turned).union(noted).withColumn("_plain", _plain(F.col("said")))
    exact = names.select(F.col("theme").alias("said"), F.col("theme").alias("_same"))
    out = every.join(exact, "said", "left").join(spelled, "_plain", "left").select("batch", "ts_code", "pos", F.coalesce("_same", "theme").alias("theme")).where("theme IS NOT NULL")
    return out, damaged
