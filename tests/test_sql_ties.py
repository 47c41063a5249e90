"""Queries at exact ties of means: the doubles are compared as their SQL compares them."""

from __future__ import annotations

import datetime as dt
import math
import os
import random

import pandas as pd
import pytest

import __spark_entry__ as entry_mod
from tickloom.oracle_check import TABLES, compare, duck

SMALL = "/root/testdata/sf0.001"
WEEKS, FIRST, EVERY = 170, 21, 32  # frames of 20 rows that end at 21, 53, ... and don't overlap


def added(xs):
    total = 0.0
    for x in xs:
        total += x
    return total / len(xs)


def spike(rng):
    """20 volumes, the last exactly 1.5 times their mean, which the doubles put above it."""
    while True:
        cents = [rng.randrange(2000, 9000) for _ in range(18)]
        cents.append(37 * 150 - sum(cents) % 37)
        cents.append(3 * sum(cents) // 37)
        assert 40 * cents[-1] == 3 * sum(cents)
        vol = [c / 100 for c in cents]
        if vol[-1] > added(vol) * 1.5 and vol[-1] / 25 > added([v / 25 for v in vol]) * 1.5:
            return vol


def level(rng):
    """20 volumes whose last five have the same mean, which the doubles put below it."""
    while True:
        cents = [rng.randrange(2000, 9000) for _ in range(19)]
        cents.append((sum(cents[:15]) - 3 * sum(cents[15:19])) // 3)
        vol = [c / 100 for c in cents]
        if cents[-1] > 0 and 4 * sum(cents[15:]) == sum(cents) and added(vol[-5:]) / added(vol) < 1:
            return vol


def calm(rng):
    """20 volumes whose last five have a mean of exactly 0.8 of theirs, which the doubles put below it."""
    while True:
        cents = [rng.randrange(2000, 9000) for _ in range(19)]
        cents.append((sum(cents[:15]) - 4 * sum(cents[15:19])) // 4)
        vol = [c / 100 for c in cents]
        if cents[-1] > 0 and 5 * sum(cents[15:]) == sum(cents) and added(vol[-5:]) / added(vol) < 0.8:
            return vol


def write_tables(folder, frame):
    swing, end = (12.0, 11.0) if frame is calm else (11.0, 12.0)
    rng, vols = random.Random(7), []
    while len(vols) < WEEKS:
        at = len(vols) - (FIRST - 19)
        vols += frame(rng) if at >= 0 and at % EVERY == 0 else [rng.randrange(2000, 9000) / 100]
    rows = []
    for i, v in enumerate(vols[:WEEKS]):
        o = (i - FIRST) % EVERY  # a swing high 15 rows before the frame's end, and a break of it there; where calm a price half way
        price = end if o == 0 else swing if o == 17 else 10.0
        rows.append((i, 1, 1, 1, v, v * 2000 * math.exp((price - 10) / 0.5), 0.0, 0.0, "N", "O", dt.datetime(1996, 1, 1) + dt.timedelta(weeks=i)))
    lines = pd.DataFrame(rows, columns="l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate".split())
    lines["l_linenumber"] = lines["l_linenumber"].astype("int32")
    lines["l_shipdate"] = lines["l_shipdate"].astype("datetime64[us]")
    lines.to_parquet(folder / "lineitem.parquet")
    for t in TABLES:
        if t != "lineitem":
            os.symlink(f"{SMALL}/{t}.parquet", folder / f"{t}.parquet")


@pytest.mark.parametrize("frame,name", [(spike, "turnover_spikes"), (spike, "pattern_break_of_structure"), (spike, "pattern_rolling_max"),
                                        (level, "snapshot_payload_hash"), (level, "robustness_breakdowns"), (calm, "pattern_derived_signals")])
def test_ties_of_doubles_are_those_of_the_sql(spark, tmp_path, frame, name):
    write_tables(tmp_path, frame)
    ok, note = compare(spark, duck(str(tmp_path)), str(tmp_path), name, entry_mod.queries()[name], entry_mod.oracle_sql()[name])
    assert ok and "EMPTY" not in note, note
