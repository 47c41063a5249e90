"""Stored tables: statement merges that leave untouched partitions alone, snapshot appends that read their own days, readers of differing files."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tickloom.operators import snapshots as S
from tickloom.sources import readers as D
from tickloom.sources import sinks as Z

D1, D2, D3 = dt.date(2024, 3, 31), dt.date(2024, 6, 30), dt.date(2024, 9, 30)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_statement_merge(spark, tmp_path):
    path = f"{tmp_path}/store"
    feed = lambda rows, c: spark.createDataFrame(rows, f"ts_code string, end_date date, {c} double")
    codes = [f"c{i}" for i in range(20)]
    Z.merge_statements(spark, path, [feed([(c, d, 1.0) for c in codes for d in (D1, D2)], "a"), feed([(c, D2, 2.0) for c in codes], "b"), feed([("c0", D1, 7.0), (None, D1, 1.0)], "c"), feed([], "d")], keep=2, parts=8)
    before = files(path)
    change = [feed([("c3", D2, 9.0), ("c3", D3, 5.0), ("c3", D3, 5.0)], "a"), feed([("c3", D3, 6.0)], "b"), feed([], "c"), feed([], "d")]
    for _ in range(2):  # a rerun gives the same rows
        Z.merge_statements(spark, path, change, keep=2, parts=8)
        rows = {(r.ts_code, r.end_date): (r.a, r.b, r.c, r.d) for r in spark.read.parquet(path).collect()}
        assert len(rows) == 40 and rows["c3", D2] == (9.0, None, None, None) and rows["c3", D3] == (5.0, 6.0, None, None) and rows["c0", D1] == (1.0, None, 7.0, None) and ("c3", D1) not in rows
        part = spark.range(1).select(F.pmod(F.xxhash64(F.lit("c3")), F.lit(8))).first()[0]
        after = files(path)
        assert {f for f in before if f"part={part}/" not in f} == {f for f in after if f"part={part}/" not in f} and all(after[f] == m for f, m in before.items() if f in after)


def test_append_reads_the_days_at_hand(spark, tmp_path):
    path = f"{tmp_path}/snaps"
    make = lambda day, codes, x=1.0: S.prepare(spark.createDataFrame([("r", day, c, x) for c in codes], "run_id string, signal_date date, ts_code string, x double"), "v1", "h", "t")
    assert S.append_snapshots(spark, path, make(D1, "ab")) == 2 and S.append_snapshots(spark, path, make(D2, "ab")) == 2
    for f in list(files(path)):
        if "2024-03-31" in f:
            os.remove(f)  # a day that isn't at hand needs no files
    assert S.append_snapshots(spark, path, make(D2, "abc")) == 1
    with pytest.raises(ValueError, match="conflicting"):
        S.append_snapshots(spark, path, make(D2, "a", 2.0))
    plan = S.stored_days(spark, path, [D2])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "2024-06-30" in plan.split("PartitionFilters")[1]


def test_statement_files_that_differ(spark, tmp_path):
    rows = {"end_date": "20240331", "report_date": "2024-06-30", "ann_date": "2024-09-30 00:00:00", "f_ann_date": "20241231", "trade_date": "2025-03-31"}
    for name, text in rows.items():
        spark.createDataFrame([("a", text, 1.5), ("b", "no date", 2.0), ("c", None, 3.0)], f"ts_code string, {name} string, {'revenue' if name < 'f' else 'total_revenue'} double").write.parquet(f"{tmp_path}/t/from={name}")
    got = D.read_statements(spark, f"{tmp_path}/t")
    assert sorted(str(r.end_date) for r in got.collect()) == ["2024-03-31", "2024-06-30", "2024-09-30", "2024-12-31", "2025-03-31"]
    assert {"revenue", "total_revenue"} <= set(got.columns)
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{tmp_path}/none")
    with pytest.raises(ValueError):
        D.read_statements(spark, f"{tmp_path}/none")
