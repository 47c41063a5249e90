"""Named views over the model tables and read-only SQL on them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources import adapters as A

RESULT_ROWS = 20
_WRITE = re.compile(r"\b(insert|update|delete|merge|create|drop|alter|truncate|copy|attach|install|load|set|cache|refresh|add)\b", re.I)


def daily_view(bars: DataFrame) -> DataFrame:
    return bars.withColumn("date", F.col("trade_date")).withColumn("volume", F.col("vol"))


VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "stock_basic": A.stock_basic, "stock_company": A.stock_company, "stock_ticks": A.bars,
    "stock_basic_daily": lambda s, d: daily_view(A.bars(s, d)), "top_list": A.top_list, "top_inst": A.top_inst,
}


def check_read_only(sql: str) -> str:
    """The statement without its closing semicolon; anything but one SELECT or WITH is refused."""
    text = sql.strip().rstrip(";").strip()
    if ";" in text or not re.match(r"(?is)^(select|with)\b", text) or _WRITE.search(re.sub(r"'[^']*'", "''", text)):
        raise ValueError("only a single read-only SELECT is allowed")
    return text


def run_sql(spark: SparkSession, sf_dir: str, sql: str, context: dict[str, DataFrame] | None = None) -> DataFrame:
    """First rows of a read-only query over the catalog views it names and given frames."""
    text = check_read_only(sql)
    for name, make in VIEWS.items():
        if re.search(rf"\b{name}\b", text):
            make(spark, sf_dir).createOrReplaceTempView(name)
    for name, df in (context or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(text).limit(RESULT_ROWS)
