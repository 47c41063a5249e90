"""Cross-sectional ranks, quantile buckets and exact percentiles.

A cross-section is one group (a date, or the whole market) with one row per
instrument, so its size is bounded by the instrument count. Up to
`PLAIN_ROWS` instruments a window per group is the cheapest plan. Beyond it ranks are
running totals over the distinct values and their counts (operators/running.py): the
input is written and read once for all columns that are ranked, no group meets in one task,
and each rank starts a new lineage, so chained ranks plan in seconds. Both plans give the same ranks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tickloom.operators.running import numbered, running
from tickloom.sources.workspace import saved

PLAIN_ROWS = 1_000_000


def placed(df: DataFrame, group: list[str], values: list[str]) -> DataFrame:
    """(group, _name, _v, _ties, _upto, _n): each distinct value of each column, how many rows have it, how many have it or a lower one, and
    how many have any. df is read once for all columns; a value that many rows share is one row here."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("_name"), F.col(v).cast("double").alias("_v")) for v in values]))
    counts = df.select(*group, each.alias("_e")).select(*group, "_e.*").where("_v IS NOT NULL").groupBy(*group, "_name", "_v").agg(F.count(F.lit(1)).alias("_ties"))
    upto = saved(running(counts, [*group, "_name"], ["_v"], {"_upto": F.col("_ties")}), "placed")
    return upto.join(upto.groupBy(*group, "_name").agg(F.max("_upto").alias("_n")), [*group, "_name"])


def _attach(df: DataFrame, group: list[str], places: DataFrame, values: dict[str, str], made: Column) -> DataFrame:
    """df with made, an expression over a place, for each column of values under its new name; null values have none."""
    out = df
    for v, name in values.items():
        own = places.where(F.col("_name") == v).select(*group, F.col("_v").cast(df.schema[v].dataType).alias(v), made.alias(name))
        out = out.join(own, [*group, v], "left")
    return out.select(*df.columns, *values.values())


def average_ranks(df: DataFrame, group: list[str], values: dict[str, str], bound: int, pct: bool = False, plain_rows: int = PLAIN_ROWS) -> DataFrame:
    """Average-tie ranks of non-null values in a group, 1-based, for several columns; `pct` divides by the number of them."""
    if bound <= plain_rows:
        for value, out in values.items():
            v = F.col(value)
            # rows below plus one, and rows not above, from one sorted window
            w = Window.partitionBy(*group).orderBy(v.asc_nulls_last())
            rank = (F.rank().over(w) + F.count(v).over(w)) / 2.0
            if pct:
                rank = rank / F.count(v).over(Window.partitionBy(*group))
            df = df.withColumn(out, F.when(v.isNotNull(), rank))
        return df
    df = saved(df, "ranked")
    rank = F.col("_upto") - (F.col("_ties") - 1) / 2.0
    return _attach(df, group, placed(df, group, list(values)), values, rank / F.col("_n") if pct else rank)


def average_rank(df: DataFrame, group: list[str], value: str, out: str, bound: int, pct: bool = False,
                 plain_rows: int = PLAIN_ROWS) -> DataFrame:
    """average_ranks of one column."""
    return average_ranks(df, group, {value: out}, bound, pct, plain_rows)


def row_rank(df: DataFrame, group: list[str], value: str, tie: str, out: str, bound: int,
             plain_rows: int = PLAIN_ROWS) -> DataFrame:
    """Row number by (value, tie) in a group; rows must have a value."""
    if bound <= plain_rows:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(value, tie)))
    return numbered(df, group, [value, tie], out)


def shares_at_most(df: DataFrame, group: list[str], values: dict[str, str], bound: int, plain_rows: int = PLAIN_ROWS) -> DataFrame:
    """Shares of the group's values that are <= the row's value, for several columns; null for null values."""
    if bound <= plain_rows:
        for value, out in values.items():
            has = F.col(value).isNotNull()
            df = df.withColumn(out, F.when(has, F.cume_dist().over(Window.partitionBy(*group, has).orderBy(value))))
        return df
    df = saved(df, "ranked")
    return _attach(df, group, placed(df, group, list(values)), values, F.col("_upto") / F.col("_n"))


def share_at_most(df: DataFrame, group: list[str], value: str, out: str, bound: int,
                  plain_rows: int = PLAIN_ROWS) -> DataFrame:
    """shares_at_most of one column."""
    return shares_at_most(df, group, {value: out}, bound, plain_rows)


def percentiles(df: DataFrame, group: list[str], value: str, probs: dict[str, float], bound: int,
                plain_rows: int = PLAIN_ROWS) -> DataFrame:
    """Exact interpolated percentiles per group, one column per entry of `probs`."""
    df = df.where(F.col(value).isNotNull())
    if bound <= plain_rows:
        return df.groupBy(*group).agg(*[F.percentile(value, p).alias(k) for k, p in probs.items()])
    near = _around(df, group, value, probs)
    return placed(df, group, [value]).groupBy(*group).agg(*_at_places(probs)) if near is None else near


def _at_places(probs: dict[str, float], own=lambda k: F.lit(True)) -> list[Column]:
    """Interpolated values at the positions of probs, of rows (_v, _ties, _upto, _n) that own(k) keeps for k."""
    aggs = []
    for k, p in probs.items():  # the values at the two places around the position
        pos = (F.col("_n") - 1) * F.lit(p) + 1
        at = lambda r: F.max(F.when(own(k) & (r > F.col("_upto") - F.col("_ties")) & (r <= F.col("_upto")), F.col("_v")))  # noqa: E731, B023
        part = F.max(pos - F.floor(pos))
        aggs.append((at(F.floor(pos)) + F.when(part > 0, (at(F.floor(pos) + 1) - at(F.floor(pos))) * part).otherwise(0.0)).alias(k))
    return aggs


def _around(df: DataFrame, group: list[str], value: str, probs: dict[str, float], accuracy: int = 2000) -> DataFrame | None:
    """Exact percentiles from the rows near them: approximate ones give two ends, rows below are counted, and only values between are sorted.

    None if the ends of any percentile don't hold both of its places."""
    v, margin = F.col(value).cast("double"), 3.0 / accuracy
    ends = {k: [max(0.0, p - margin), min(1.0, p + margin)] for k, p in probs.items()}
    held = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), *[F.percentile_approx(v, e, accuracy).alias(f"_e_{k}") for k, e in ends.items()])
    j = df.select(*group, v.alias("_v")).join(saved(held, "ends"), group)
    small = F.col("_n") < 5 * accuracy  # kept whole: the ends may be one row apart; NaN is the largest double
    low = {k: F.when(small, F.lit(float("-inf"))).otherwise(F.col(f"_e_{k}")[0]) for k in probs}
    high = {k: F.when(small, F.lit(float("nan"))).otherwise(F.col(f"_e_{k}")[1]) for k in probs}
    sides = j.groupBy(*group, "_n").agg(*[F.count_if(F.col("_v") < low[k]).alias(f"_below_{k}") for k in probs],
                                        *[F.count_if(F.col("_v") <= high[k]).alias(f"_up_{k}") for k in probs])
    sides = saved(sides, "sides")
    missed = F.lit(False)
    for k, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(p) + 1
        missed = missed | (F.floor(pos) <= F.col(f"_below_{k}")) | (F.ceil(pos) > F.col(f"_up_{k}"))
    if not sides.where(missed).isEmpty():
        return None
    each = F.explode(F.array(*[F.when((F.col("_v") >= low[k]) & (F.col("_v") <= high[k]), F.lit(k)) for k in probs]))
    counts = j.select(*group, "_v", each.alias("_k")).where("_k IS NOT NULL").groupBy(*group, "_k", "_v").agg(F.count(F.lit(1)).alias("_ties"))
    below = F.lit(0)
    for k in probs:
        below = F.when(F.col("_k") == k, F.col(f"_below_{k}")).otherwise(below)
    upto = running(counts, [*group, "_k"], ["_v"], {"_upto": F.col("_ties")}).join(sides, group).withColumn("_upto", F.col("_upto") + below)
    return upto.groupBy(*group).agg(*_at_places(probs, lambda k: F.col("_k") == k))


def top_n(df: DataFrame, group: list[str], n: int, *order: Column) -> DataFrame:
    """First n rows per group; Spark trims each task to n rows before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("_top", F.row_number().over(w)).where(F.col("_top") <= n).drop("_top")
