"""Running totals and ranks over ranges, with hot groups and ties, and the split plan of whole queries."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickloom.operators import ic, ranking
from tickloom.operators.running import numbered, running


def test_running_totals_over_hot_groups(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": np.where(rng.random(5_000) < 0.5, "hot", rng.integers(0, 200, 5_000).astype(str)), "o": rng.permutation(5_000), "n": rng.integers(0, 9, 5_000)})
    df = spark.createDataFrame(pdf).repartition(7)
    got = running(df, ["g"], [F.desc("o")], {"s": F.col("n"), "k": F.lit(1).cast("long")}).toPandas().sort_values(["g", "o"], ascending=[True, False])
    want = pdf.sort_values(["g", "o"], ascending=[True, False])
    assert got["s"].tolist() == want.groupby("g")["n"].cumsum().tolist() and got["k"].tolist() == (want.groupby("g").cumcount() + 1).tolist()
    every = numbered(df, [], ["o"], "r").toPandas()
    assert (every["r"] == every["o"] + 1).all()
    assert running(df.limit(0), ["g"], ["o"], {"s": F.col("n")}).count() == 0


def test_null_groups_and_equal_rows(spark):
    df = spark.createDataFrame([(None, 1)] * 5 + [("a", 1)] * 3, "g string, o int")
    got = sorted((r.g or "", r.k) for r in numbered(df, ["g"], ["o"], "k").collect())
    assert got == [("", k) for k in range(1, 6)] + [("a", k) for k in range(1, 4)]


def test_several_ranks_from_one_read(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 600).astype(str), "x": rng.integers(0, 9, 600).astype(float), "y": np.where(rng.random(600) < 0.1, np.nan, rng.normal(size=600))})
    df = spark.createDataFrame(pdf).withColumn("y", F.nanvl("y", F.lit(None).cast("double")))
    got = ranking.average_ranks(df, ["g"], {"x": "rx", "y": "ry"}, 600, plain_rows=1).toPandas()
    for c in "xy":
        assert np.allclose(got[f"r{c}"].fillna(-1), got.groupby("g")[c].rank().fillna(-1))


def test_many_features_plan_in_seconds_on_the_split_plan(spark):
    """The case that had no plan in 120 s: ranks of several returns, then of 19 features."""
    rng = np.random.default_rng(3)
    feats, rets = [f"f{k}" for k in range(19)], {h: f"y{h}" for h in (1, 3, 5)}
    pdf = pd.DataFrame({c: rng.normal(size=240).round(1) for c in [*feats, *rets.values()]})
    pdf["trade_date"] = np.repeat(pd.date_range("2024-01-01", periods=4).date, 60)
    df = spark.createDataFrame(pdf)
    start = time.time()
    split = ic.panel_ic(df, feats, rets, 60, 5, 2, plain_rows=1)
    split._jdf.queryExecution().executedPlan()
    assert time.time() - start < 60
    key = ["feature", "horizon"]
    a, b = (f.toPandas().sort_values(key).reset_index(drop=True) for f in (ic.panel_ic(df, feats, rets, 60, 5, 2), split))
    pd.testing.assert_frame_equal(a, b)
    assert len(a) == 57


def test_ablation_same_in_both_plans(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame({"s": rng.integers(0, 40, 500).astype(float), "r": rng.normal(size=500), "audit_risk_score": rng.random(500)}))
    a, b = (ic.ablation(df, "s", "r", 500, plain_rows=p).toPandas().sort_values("scenario").reset_index(drop=True) for p in (1000, 1))
    pd.testing.assert_frame_equal(a, b[a.columns])
    assert len(a) == 2
    assert a["top_decile_hit_rate"].between(0, 1).all() and a["top_decile_median_return"].notna().all()
