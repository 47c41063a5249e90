"""Seven entry detectors on the latest bar of every instrument."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tickloom.functions.scores import snapped
from tickloom.operators.timeseries import EPS, by_date, rows, sma, to_date_rows, true_range, whole

SWING = 10
POC_BARS, POC_BINS = 60, 30

DETECTORS = ("timing_bos", "timing_true_bos", "timing_joc", "timing_poc", "timing_poc_retest", "timing_gap_hold", "timing_lps")


def volume_profile_poc(bars: DataFrame) -> DataFrame:
    """Middle of the price bin with the most volume over the last 60 closes (at least 20), the lowest of equal ones."""
    back = F.row_number().over(Window.partitionBy("ts_code").orderBy(F.desc("trade_date")))
    recent = bars.select("ts_code", "trade_date", "close", "vol", back.alias("_b")).where(F.col("_b") <= POC_BARS)
    w = Window.partitionBy("ts_code")
    r = recent.select("ts_code", "close", "vol", F.min("close").over(w).alias("lo"), F.max("close").over(w).alias("hi"),
                      F.count(F.lit(1)).over(w).alias("n"), F.sum("vol").over(w).alias("total")).where("n >= 20 and total > 0")
    pos = F.try_divide(F.col("close") - F.col("lo"), F.col("hi") - F.col("lo")) * POC_BINS - 1e-9
    bin_ = F.least(F.lit(POC_BINS - 1), F.greatest(F.lit(0), F.floor(F.coalesce(pos, F.lit(0.0))))).cast("int")
    per = r.groupBy("ts_code", bin_.alias("bin")).agg(F.round(F.sum("vol"), 6).alias("v"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    best = per.groupBy("ts_code").agg(F.max(F.struct(F.col("v"), -F.col("bin"), F.col("lo"), F.col("hi"))).alias("m"))
    b = -F.col("m.col2")
    step = (F.col("m.hi") - F.col("m.lo")) / POC_BINS
    return best.select("ts_code", F.when(F.col("m.hi") <= F.col("m.lo"), F.col("m.lo")).otherwise(
        F.col("m.lo") + step * (b + 0.5)).alias("poc"))


def latest_timing(bars: DataFrame) -> DataFrame:
    """One row per instrument with the seven flags and their share."""
    c, w, all_rows = F.col, by_date(), whole()
    before, after = rows(-SWING, -1), rows(1, SWING)
    raw = ((F.count("high").over(before) == SWING) & (F.count("high").over(after) == SWING)
           & (c("high") > F.max("high").over(before)) & (c("high") > F.max("high").over(after)))
    df = bars.select(
        "*", F.row_number().over(w).alias("rn"), F.count(F.lit(1)).over(all_rows).alias("n"), true_range().alias("tr"),
        F.when(raw, c("high")).alias("swing"), F.lag("close").over(w).alias("pc"), sma("close", 20).alias("ma20"))
    later_low = F.min("low").over(Window.partitionBy("ts_code").orderBy(F.desc("trade_date")).rowsBetween(Window.unboundedPreceding, -1))
    df = df.select(
        "*", F.last("swing", True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("swing_before"),
        sma("tr", 14).alias("atr"), later_low.alias("later_low"), F.avg("vol").over(rows(-19, 0)).alias("vol20"),
        F.lag("ma20", 5).over(w).alias("ma20_ago"), F.last("swing", True).over(to_date_rows()).alias("_swing_now"))
    df = df.withColumn("broke_now", F.coalesce(c("close") > c("swing_before"), F.lit(False)))
    gap = (c("open") - c("pc")) / (c("pc") + EPS) > 0.005
    held_gap = gap & (c("n") - c("rn") >= 5) & F.coalesce(c("later_low") >= c("pc") * 0.999, F.lit(True))
    df = df.select(
        "*", F.max(F.when(held_gap, 1).otherwise(0)).over(all_rows).alias("any_gap"),
        F.max(F.when(c("broke_now"), 1).otherwise(0)).over(rows(-20, 0)).alias("recent_break"),
        F.max(F.when(c("rn") == c("n"), c("close"))).over(all_rows).alias("last_close"),
        F.max(F.when(c("rn") == c("n"), c("atr"))).over(all_rows).alias("last_atr"),
        F.max(F.when(c("swing").isNotNull(), c("rn"))).over(all_rows).alias("_last_swing_rn"),
    )
    # the swing before the last one: its first break, then a later low back in the zone
    earlier = c("swing").isNotNull() & (c("rn") < c("_last_swing_rn"))
    df = df.withColumn("_prev", F.max(F.when(earlier, F.struct("rn", "swing"))).over(all_rows))
    df = df.withColumn("_break_rn", F.min(F.when((c("rn") > c("_prev.rn")) & (c("close") > c("_prev.swing")), c("rn"))).over(all_rows))
    bottom, top = c("_prev.swing") - c("last_atr") * 0.3, c("_prev.swing") + c("last_atr") * 0.2
    touched = (c("rn") > c("_break_rn")) & (c("low") >= bottom) & (c("low") <= top)
    df = df.withColumn("_touched", F.max(F.when(touched, 1).otherwise(0)).over(all_rows))
    past = F.collect_list("close").over(rows(-5, -1))
    last = df.withColumn("_past", past).where("rn = n").join(volume_profile_poc(bars), "ts_code", "left")
    enough = c("n") >= 2 * SWING + 1
    atr_ok = F.coalesce(c("atr") > 0, F.lit(False))
    no = F.lit(False)
    against = snapped(F.try_divide("vol", "vol20"))
    bos = enough & F.coalesce(c("close") > c("_swing_now"), no) & c("swing").isNull()
    flags = last.select(
        "ts_code", "trade_date", "poc", bos.alias("timing_bos"),
        (bos & atr_ok & c("_prev").isNotNull() & (c("_touched") == 1) & F.coalesce(c("close") > bottom, no)).alias("timing_true_bos"),
        (bos & (c("vol20") > 0) & (against > 1.5)).alias("timing_joc"),
        F.coalesce(atr_ok & (F.abs(c("close") - c("poc")) <= c("atr")), no).alias("timing_poc"),
        F.coalesce(atr_ok & (F.abs(c("close") - c("poc")) <= c("atr")) & (c("n") >= 20)
                   & F.exists("_past", lambda x: x > c("poc") + c("atr") * 0.5) & (against < 1), no).alias("timing_poc_retest"),
        ((c("any_gap") == 1) & (c("n") >= 7)).alias("timing_gap_hold"),
        F.coalesce((c("n") >= 60) & atr_ok & (c("ma20") > c("ma20_ago")) & (F.abs(c("close") - c("ma20")) <= c("atr"))
                   & (c("recent_break") == 1) & (against < 1), no).alias("timing_lps"),
    )
    total = sum((c(d).cast("int") for d in DETECTORS), F.lit(0))
    return flags.withColumn("timing_score", total / 7.0).withColumn("structure_score", c("timing_score"))
