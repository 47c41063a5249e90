"""The layout of the factor study: what moves, and that moving less gives the same rows."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import ic, labels
from tickloom.plans import validation_queries as V

SF = "/root/testdata/sf0.001"


def gaps(spark):
    rng = np.random.default_rng(9)
    gap = lambda v: None if rng.random() < 0.2 else float(v)
    rows = [(dt.date(2026, 1, 1 + d), f"{i:03}", gap(rng.integers(0, 4)), gap(rng.normal()), gap(rng.normal()), gap(rng.normal())) for d in range(3) for i in range(40)]
    rows += [(dt.date(2026, 1, 9), f"{i:03}", 1.0, None if i else 2.0, 0.5, None) for i in range(4)]
    return spark.createDataFrame(rows, "signal_date date, ts_code string, f1 double, f2 double, r1 double, r2 double")


def test_quantiles_move_a_row_once_and_not_once_a_pair(spark):
    out = ic.quantile_returns(gaps(spark), ["f1", "f2"], ["r1", "r2"], 3, 40)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.rindex("Generate") < plan.index("Window")
    assert plan.count("Generate") == 1


def test_quantiles_of_pairs_with_gaps_are_those_of_pandas(spark):
    df = gaps(spark)
    got = {(r["signal_date"], r["factor"], r["return_col"], r["quantile"]): r for r in ic.quantile_returns(df, ["f1", "f2"], ["r1", "r2"], 3, 40).collect()}
    pdf, want = df.toPandas(), {}
    for d in pdf["signal_date"].unique():
        for f in ("f1", "f2"):
            for r in ("r1", "r2"):
                both = pdf[pdf["signal_date"] == d].dropna(subset=[f, r]).sort_values([f, "ts_code"]).reset_index(drop=True)
                n, q = len(both), min(3, both[f].nunique(), len(both))
                if q >= 2:
                    bucket = np.maximum(1, np.ceil(both.index.to_numpy() * q / (n - 1))).astype(int)
                    for b, part in both.groupby(bucket):
                        want[d, f, r, b] = part[r]
    assert set(got) == set(want) and len(want) > 30
    for k, ys in want.items():
        assert got[k]["n"] == len(ys) and got[k]["mean_return"] == pytest.approx(ys.mean()) and got[k]["median_return"] == pytest.approx(ys.median())


def test_labels_on_bars_are_forward_labels(spark):
    day = dt.date(2026, 1, 5)
    bars = [(c, day + dt.timedelta(days=i), 10.0 + i if i != 7 else 0.0, 11.0 + i * i, 10.5 if i % 3 else None) for c in ("600001.SH", "300002.SZ", "830003.BJ") for i in range(12)]
    bars.append(("000009.SZ", day, 10.0, 10.0, None))  # no next bar
    b = spark.createDataFrame(bars, "ts_code string, trade_date date, open double, close double, pre_close double")
    own = b.select("ts_code", F.col("trade_date").alias("signal_date"), F.lit("run").alias("run_id"))
    want = labels.forward_labels(b, own, (1, 3))
    carried = labels.with_next_bar(b, (1, 3)).select("ts_code", F.col("trade_date").alias("signal_date"), F.lit("run").alias("run_id"), *labels.next_bar_columns((1, 3)))
    got = labels.labels_on_bars(carried, (1, 3)).select(*want.columns)
    assert got.count() == 37 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert {r[0] for r in got.select("label_status").collect()} == {"ok", "missing_entry", "bad_entry_price"}


def test_labels_of_the_snapshots_need_the_bars_once(spark):
    plan = V.labels(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("min_by(") == 1 and "Union" not in plan


def test_study_without_ranks_counts_the_same(spark):
    df = gaps(spark).withColumn("list_type", F.lit("a"))
    a, b = (ic.evaluate_factors(df, ["f1"], ["r1", "r2"], 40, 40, date_ranks=r) for r in (True, False))
    for frame in ("ic_by_date", "ic_summary"):
        with_ranks, without = getattr(a, frame), getattr(b, frame)
        assert not [c for c in without.columns if "rank" in c]
        key = [c for c in ("signal_date", "factor", "return_col", "n", "periods") if c in without.columns]
        assert sorted(map(tuple, with_ranks.select(key).collect())) == sorted(map(tuple, without.select(key).collect()))
