"""Normalisers and presentation fields of reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that make a theme name too vague to act on, and the wordings of verdicts in the order they are tried.
NOISE_WORDS = ["股票", "辨识度", "传统经济", "蓝筹", "龙虎榜", "游资", "机构", "复盘", "涨停"]
VERDICT_WORDS = {"fail": ["fail", "否决"], "warn": ["warn", "存疑", "谨慎"], "pass": ["pass", "通过"]}
MAX_THEME_NAME = 12


def verdict(c: Column) -> Column:
    """pass, warn or fail from free wording; unclear wording is warn."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    found = F.lit("warn")
    for name, words in reversed(VERDICT_WORDS.items()):
        found = F.when(t.rlike("|".join(words)), name).otherwise(found)
    return found


def quality_label(score: Column) -> Column:
    return F.when(score >= 65, "改善").when(score < 40, "承压").otherwise("平稳")


def box_band(pos: Column) -> Column:
    """Band of the position inside the box."""
    return F.when(pos.isNull(), "未知").when(pos < 0.3, "低位").when(pos < 0.6, "中位").when(pos < 0.8, "中高位").otherwise("高位")


def tag_position(text: Column, pos: Column) -> Column:
    """Names a high position in front of a text that does not mention position."""
    return F.when((pos > 0.70) & ~text.rlike("位置|高位|分位"), F.concat(F.lit("【高位】"), text)).otherwise(text)


def position_card(pos: Column, amplitude: Column, dist: Column) -> Column:
    pct = lambda c: F.format_string("%.1f%%", c * 100)
    return F.concat_ws(" | ", F.concat(F.lit("箱体位置 "), pct(pos)), F.concat(F.lit("振幅 "), pct(amplitude)), F.concat(F.lit("距箱顶 "), pct(dist)))


def actionable_theme(name: Column) -> Column:
    own = F.trim(F.coalesce(name, F.lit("")))
    return (F.length(own) > 0) & (F.length(own) <= MAX_THEME_NAME) & ~own.rlike("|".join(NOISE_WORDS))


def normalise_findings(findings: Column, allowed: list[str], fallback: Column) -> Column:
    """Findings with a description, their evidence and date; category, confidence and an allow-listed source filled in, or the fallback list."""
    said = lambda c: F.trim(F.coalesce(c, F.lit("")))
    ok = F.filter(findings, lambda f: F.length(said(f["description"])) > 0)
    full = F.transform(ok, lambda f: F.struct(
        F.when(said(f["category"]) == "", "other").otherwise(said(f["category"])).alias("category"), said(f["description"]).alias("description"),
        said(f["evidence"]).alias("evidence"), F.when(said(f["date"]) != "", said(f["date"])).alias("date"),
        F.coalesce(f["confidence"], F.lit(0.5)).alias("confidence"),
        F.when(f["source_url"].rlike("|".join(a.replace(".", r"\.") for a in allowed)), f["source_url"]).alias("source_url")))
    return F.when(F.size(full) > 0, full).otherwise(fallback)
