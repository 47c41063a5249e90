"""Ties that rounding errors of sums must not decide."""

from __future__ import annotations

import datetime as dt
import random

from tickloom.operators import indicators, panel

DAY = dt.date(2024, 1, 1)


def test_equal_means_give_a_ratio_of_one(spark):
    rng = random.Random(5)
    rows = []
    for k in range(60):
        five = [rng.randrange(1000, 9999) / 100 for _ in range(5)]
        rows += [(f"{k:03}", DAY + dt.timedelta(days=i), 10.0, 11.0, 9.0, 10.0, 10.0, v, v / 25.0) for i, v in enumerate(five * 4)]
    df = spark.createDataFrame(rows, "ts_code string, trade_date date, open double, high double, low double, close double, pre_close double, vol double, turnover_rate double")
    last = panel.factor_panel(df, 1).where(f"trade_date = date '{DAY + dt.timedelta(days=19)}'")
    assert {r[0] for r in last.select("vol_contraction").collect()} == {1.0}


def test_turnover_of_exactly_the_multiple_is_no_spike(spark):
    rng = random.Random(6)
    rows = []
    for k in range(60):
        cents = [rng.randrange(100, 999) for _ in range(18)]
        cents.append(37 * 300 - sum(cents) % 37 - (sum(cents) - sum(cents) % 37))
        cents.append(3 * sum(cents) // 37)  # 20 t = 1.5 (s + t)
        assert 40 * cents[-1] == 3 * sum(cents)
        rows += [(f"{k:03}", DAY + dt.timedelta(days=i), c / 100) for i, c in enumerate(cents)]
    df = spark.createDataFrame(rows, "ts_code string, trade_date date, turnover_rate double")
    assert indicators.turnover_spikes(df).where(f"trade_date = date '{DAY + dt.timedelta(days=19)}'").count() == 0
