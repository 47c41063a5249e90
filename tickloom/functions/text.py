"""Text and URL rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Credibility weight by domain, first match in this order.
SOURCE_TIERS = [
    ("cninfo.com.cn", 1.0), ("sse.com.cn", 1.0), ("szse.cn", 1.0), ("eastmoney.com", 0.85), ("10jqka.com.cn", 0.85), ("cls.cn", 0.80),
    ("yicai.com", 0.80), ("caixin.com", 0.80), ("sina.com.cn", 0.75), ("gelonghui.com", 0.75), ("xueqiu.com", 0.70), ("ndrc.gov.cn", 0.90),
    ("miit.gov.cn", 0.90), ("most.gov.cn", 0.90), ("gov.cn", 0.90), ("tianyancha.com", 0.70), ("qichacha.com", 0.70),
]
FINDING_WORDS = {
    "policy_driver": ["补贴", "扶持", "政策支持", "专项资金", "政府采购", "入选", "获批"],
    "tech_breakthrough": ["专利", "首创", "突破", "领先", "自主研发", "核心技术", "创新"],
    "market_expansion": ["出海", "海外", "新市场", "产能扩张", "投产", "新工厂", "拓展"],
    "competitive_moat": ["龙头", "市占率", "竞争优势", "行业第一", "领先地位", "壁垒"],
    "contract_evidence": ["中标", "签约", "订单", "大客户", "框架协议", "供货", "合同"],
}
QUERY_TEMPLATES = {
    "policy_driver": ["{name} 政策 补贴 支持 扶持 产业", "{name} 国家项目 专项资金 政府采购"],
    "tech_breakthrough": ["{name} 研发 专利 技术突破 创新", "{name} 技术领先 行业首创 自主研发"],
    "market_expansion": ["{name} 新产品 新市场 海外拓展 出海", "{name} 产能扩张 新工厂 产线投产"],
    "competitive_moat": ["{name} 龙头 市占率 竞争优势 行业地位", "{name} 技术壁垒 护城河 核心竞争力"],
    "contract_evidence": ["{name} 中标 订单 大客户 框架协议", "{name} 签约 合同 战略合作 供货"],
}
THEME_STOP_WORDS = ["主题", "板块", "产业", "行业", "概念", "方向"]
SENTENCE_END = "[\n。；;！!？?]"
INVESTIGATION = r"(被|遭|因|涉嫌).{0,12}(立案|立案调查)"
LITIGATION = r"(重大诉讼|未决诉讼|仲裁|诉讼事项)"
RESOLVED = r"(胜诉|判决获支持|已结案|已和解|已撤诉|已了结|调解结案)"
DEFENDANT = r"(被诉|被告|被仲裁|遭.{0,6}诉讼|因.{0,6}诉讼|涉诉|涉及.{0,6}诉讼|面临.{0,6}诉讼)"
DELISTING = r"(终止上市|退市风险警示|暂停上市|强制退市)"
REDUCTION = r"(拟|计划).{0,12}减持|减持计划"
# Regulatory events that fail a name, and those that are only noted.
SEVERE_REGULATORY = r"(行政处罚|处罚决定书|纪律处分|公开谴责|市场禁入)"
MINOR_REGULATORY = r"(监管函|问询函|关注函|责令改正|监管措施决定书)"
PRIMARY_SOURCES = ["cninfo.com.cn", "sse.com.cn", "szse.cn"]
LIQUIDATION = r"清仓|全部减持|大比例减持|集中竞价减持"


def source_tier(url: Column) -> Column:
    out = F.when(F.coalesce(url, F.lit("")) == "", 0.5)
    for domain, weight in SOURCE_TIERS:
        out = out.when(url.contains(domain), weight)
    return out.otherwise(0.6)


def parse_date(text: Column) -> Column:
    """Dates written Y-m-d, Y/m/d, Y.m.d or Ymd."""
    plain = F.regexp_replace(F.trim(text), r"[/.]", "-")
    return F.coalesce(F.try_to_timestamp(plain, F.lit("yyyy-M-d")), F.try_to_timestamp(plain, F.lit("yyyyMMdd"))).cast("date")


def is_recent(date: Column, as_of: Column, days: int) -> Column:
    return F.coalesce(F.date_diff(as_of, date) <= days, F.lit(False))


def tokens(text: Column) -> Column:
    """Words of at least two characters without theme stop words; punctuation separates."""
    words = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}_]+", " "), " ")
    stop = F.array(*[F.lit(w) for w in THEME_STOP_WORDS])
    return F.array_except(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 2)), stop)


def reduce_ratio(text: Column) -> Column:
    """First percentage of a text as a fraction."""
    return F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*%", 1), F.lit("")).try_cast("double") / 100


def material_reduction(text: Column, threshold: float) -> Column:
    return F.coalesce(reduce_ratio(text) >= threshold, F.lit(False)) | text.rlike(LIQUIDATION)


def sentence_veto(s: Column, threshold: float) -> Column:
    """Veto reason of one sentence, or null."""
    return (
        F.when(s.rlike(INVESTIGATION), "recent_investigation")
        .when(s.rlike(LITIGATION) & ~s.rlike(RESOLVED) & s.rlike(DEFENDANT), "major_litigation")
        .when(s.rlike(DELISTING), "delisting_risk")
        .when(s.rlike(REDUCTION) & material_reduction(s, threshold), "material_reduction"))


def urls(text: Column) -> Column:
    """Distinct links of a text in order of appearance, bare www links completed, placeholders left out."""
    found = F.regexp_extract_all(text, F.lit(r"(https?://[^\s\"'<>）)]+|www\.[^\s\"'<>）)]+)"), 1)
    full = F.transform(found, lambda u: F.when(u.startswith("www."), F.concat(F.lit("https://"), u)).otherwise(u))
    return F.array_distinct(F.filter(full, lambda u: ~u.contains("example.org")))


def url_symbol(url: Column) -> Column:
    """Six-digit stock code of a structured link."""
    return F.nullif(F.regexp_extract(url, r"[?&](?:stockCode|code)=(\d{6})", 1), F.lit(""))


def metric_after(text: Column, label: str) -> Column:
    """First number after a label, thousands separators removed."""
    return F.regexp_replace(F.nullif(F.regexp_extract(text, label + r"[：:\s]*([-+]?[\d,]+(?:\.\d+)?)", 1), F.lit("")), ",", "").try_cast("double")
