"""Small helpers shared by the query modules."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(name: str, digits: int = 6) -> Column:
    return F.round(F.col(name), digits).alias(name)


def rounded(names: Iterable[str], digits: int = 6) -> list[Column]:
    return [r6(n, digits) for n in names]


def day(name: str) -> Column:
    return F.date_format(F.col(name), "yyyy-MM-dd").alias(name)


def flag(name: str) -> Column:
    return F.col(name).cast("int").alias(name)


def sql_round(names: Iterable[str], digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def sql_day(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d') AS {name}"
