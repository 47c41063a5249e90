"""Scoring functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def clamp(c: Column, lo: float, hi: float) -> Column:
    # least and greatest skip nulls, so a null must be kept on purpose
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def clamp01(c: Column) -> Column:
    return clamp(c, 0.0, 1.0)


def finite(c: Column, default: float = 0.0) -> Column:
    """The number, or the default for null, NaN and infinities."""
    bad = c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    return F.when(bad, F.lit(default)).otherwise(c)


def positive(c: Column) -> Column:
    """The number when it is positive and finite, else null."""
    return F.when((c > 0) & ~F.isnan(c) & (c < F.lit(float("inf"))), c)


def half_up(x: Column, digits: int) -> Column:
    """The number to `digits` decimals: it is scaled, rounded half away from zero and scaled back, as SQL engines do with doubles.

    F.round goes by the shortest decimal text instead: 56.949999999999996, a sum that should be 56.95, would become 56.9."""
    return F.round(x * 10.0**digits) / 10.0**digits


def snapped(x: Column) -> Column:
    """The number on a grid of 1e-12. Means of doubles differ in their last bits with the order of addition; on the grid
    a ratio that is exactly 1, 0.8 or 1.5 compares as such, whatever the order was."""
    return F.rint(x * 1e12) / 1e12


def printed(x: Column, digits: int) -> Column:
    """The number with no or one decimal as C's printf shows it: its exact binary value, ties to even; Java's format takes ties up."""
    if digits == 0:
        return F.rint(x)
    a = F.abs(x)
    whole = F.floor(a)
    tenths = ((a - whole) * 2.0**59).cast("long") * 10  # the fraction is exact in 59 bits wherever a tie can be
    digit, rest, half = F.shiftright(tenths, 59), tenths.bitwiseAND(F.lit(2**59 - 1)), 2**58
    up = F.when((rest > half) | ((rest == half) & (digit % 2 == 1)), 1).otherwise(0)
    shown = F.when(a < 2.0**52, (whole * 10 + digit + up) / 10.0).otherwise(a)
    return F.when(x < 0, -shown).otherwise(shown)


def linear(v: Column, lo: float, hi: float, points: float, invert: bool = False) -> Column:
    if hi <= lo:
        return F.lit(0.0)
    t = clamp01((v - lo) / (hi - lo))
    return (1 - t if invert else t) * points


def gaussian(v: Column, best: float, width: float, points: float) -> Column:
    z = (v - best) / (width + EPS)
    return F.exp(z * z * -0.5) * points


def in_range(v: Column, lo: float, hi: float, points: float) -> Column:
    """Full points inside the range, tapering to zero one range width outside."""
    away = F.greatest(F.lit(lo) - v, v - hi, F.lit(0.0))
    return F.greatest(F.lit(0.0), (1 - away / (hi - lo + EPS)) * points)


def volume_quality(boost: Column, turnover: Column, obv: Column) -> Column:
    return F.least(F.lit(100.0), linear(obv, 0, 100, 40) + in_range(boost, 1.2, 3.0, 35) + in_range(turnover, 1.0, 5.0, 25))


def trend_emergence(r5: Column, r10: Column, r20: Column, vol_ratio: Column, fresh: Column, near: Column, obv: Column) -> Column:
    returns = F.when(r20 > 0.45, F.least(F.lit(8.0), linear(r20, 0, 0.45, 25))).when(r20 <= 0.25, linear(r20, 0, 0.05, 25)).otherwise(8.0)
    speed = (F.when(r5 > 0, linear(r5, 0, 0.08, 10)).otherwise(0.0) + F.when(r10 > 0, linear(r10, 0, 0.15, 6)).otherwise(0.0)
             + F.when(r5 > r20 / 4, 4.0).otherwise(0.0))
    volume = F.when(vol_ratio > 4, F.least(F.lit(12.0), linear(vol_ratio, 1, 2.5, 20))).otherwise(linear(vol_ratio, 1, 2.5, 20))
    place = F.when(fresh, 0.0).when(near, 5.0).otherwise(15.0)
    return F.least(F.lit(100.0), returns + speed + volume + place + linear(obv, 0, 100, 15))


def consolidation(volatility: Column, spread: Column, spread_std: Column, position: Column, boost: Column) -> Column:
    def part(x: Column, points: float) -> Column:
        return F.greatest(F.lit(0.0), x) * points

    total = (part(1 - volatility / 0.5, 40) + part(1 - spread / 0.15, 25) + part(1 - spread_std / 0.03, 5)
             + part(1 - F.abs(position - 0.5) / 0.2, 20) + part((boost - 1) / 0.5, 10))
    return F.floor(F.least(F.lit(100.0), total)).cast("double")


def squeeze(atr_ratio: Column, bbw_pct: Column, adx: Column) -> Column:
    return F.least(F.lit(100.0), linear(atr_ratio, 0.5, 1.0, 40, True) + linear(bbw_pct, 0, 0.5, 30, True) + gaussian(adx, 15, 10, 30))


def composite(cons: Column, volq: Column, sq: Column, valq: Column, fund: Column) -> Column:
    return cons * 0.48 + volq * 0.05 + sq * 0.15 + valq * 0.10 + fund * 0.22


def valuation_label(stretch: Column) -> Column:
    return (F.when(stretch.isNull(), "估值待补充").when(stretch >= 85, "显著高估").when(stretch >= 65, "偏贵")
            .when(stretch >= 40, "适中溢价").otherwise("合理"))


def pre_audit(fund: Column, valq: Column, cons: Column, sq: Column, recency: Column) -> Column:
    return fund * 0.35 + valq * 0.15 + cons * 0.35 + sq * 0.15 - recency * 0.05
