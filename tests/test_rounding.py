"""Numbers at a rounding tie: scores as SQL rounds them, texts as printf shows them."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tickloom.functions.scores import half_up, printed
from tickloom.operators import flow


def test_half_up_is_not_moved_by_the_last_bit(spark):
    xs = [56.949999999999996, 0.15, -2.5, 44.44999999999999, None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(half_up(F.col("x"), 1)).collect()]
    assert got == [57.0, 0.2, -2.5, 44.4, None]


def test_printed_is_what_printf_shows(spark):
    xs = [44.5, 43.5, 20.25, -20.35, 0.15, 0.05, -0.04, 12.349999999999998, 1e6 + 0.25, 99.95, 0.0, -7.75, 1e-9]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    rows = df.select("x", F.format_string("%.0f", printed(F.col("x"), 0)), F.format_string("%+.1f", printed(F.col("x"), 1))).collect()
    assert [tuple(r)[1:] for r in rows] == [("%.0f" % x, "%+.1f" % x) for x in xs]


def test_breadth_has_every_date(spark):
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 8)]
    rows = [(d, 10.0, 9.0, 11.0, r, 1.2) for d in days for r in (0.1, 0.2, -0.1)]
    df = spark.createDataFrame(rows, "trade_date date, close double, sma20 double, sma60 double, return_5d double, vol_ratio_5_20 double")
    got = {r["trade_date"]: tuple(r)[1:] for r in flow.breadth(df).collect()}
    assert got == {d: (2.0, 100.0, 0.0, 100.0) for d in days}
    assert [r["trade_date"] for r in flow.latest_breadth(df).collect()] == days[1:]
