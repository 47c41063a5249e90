"""Running totals and row numbers in groups of any size.

Rows are cut into ranges of (group, order, tie) that hold about as many rows each, whatever the groups are. Totals
run inside a range and are shifted by what earlier ranges hold of the same group. A group with a third of all rows lies in as
many ranges as it fills, so it never meets in one task. Only a range's first group can have begun before it, so
the shifts are one row a range at most, and they are broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.sources.workspace import saved


def running(df: DataFrame, group: list[str], order: list[Column | str], sums: dict[str, Column]) -> DataFrame:
    """df with the sums of this and all earlier rows of the group, in `order`; rows that tie follow in any order.

    The sums must be exact in any order of addition (whole numbers), and without null."""
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    own = df.withColumns({f"_own_{k}": v for k, v in sums.items()}).withColumn("_tie", F.monotonically_increasing_id())
    dealt = own.repartitionByRange(*group, *order, "_tie").withColumn("_part", F.spark_partition_id())
    dealt = saved(dealt, "dealt")
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = dealt.groupBy("_part", *group).agg(*[F.sum(f"_own_{k}").alias(k) for k in sums])
    shifts = held.select("_part", *[F.col(c).alias(f"_g_{c}") for c in group], *[F.sum(k).over(earlier).alias(f"_shift_{k}") for k in sums])
    shifts = F.broadcast(shifts.where(F.col(f"_shift_{next(iter(sums))}").isNotNull()))  # a row for each range at most
    same = F.col("_part") == F.col("_shift_part")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    inside = Window.partitionBy("_part", *group).orderBy(*order, "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.withColumns({k: F.sum(f"_own_{k}").over(inside) for k in sums})
    out = out.join(shifts.withColumnRenamed("_part", "_shift_part"), same, "left")
    return out.select(*df.columns, *[(F.col(k) + F.coalesce(f"_shift_{k}", F.lit(0))).alias(k) for k in sums])


def numbered(df: DataFrame, group: list[str], order: list[Column | str], out: str) -> DataFrame:
    """Row numbers, from 1, in groups of any size; an empty group numbers all rows."""
    return running(df, group, order, {out: F.lit(1).cast("long")})
