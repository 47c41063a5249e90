"""Golden cases, brute-force checks and properties of the operators on small fixtures."""

from __future__ import annotations

import datetime as dt
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import evidence, fundamentals, ic, labels, patterns, ranking, selection, snapshots, timeseries
from tickloom.sources import adapters, catalog, readers


def bars_frame(spark, closes, code="600001.SH", start="2024-01-01", **cols):
    days = [dt.date.fromisoformat(start) + dt.timedelta(days=i) for i in range(len(closes))]
    rows = []
    for i, c in enumerate(closes):
        r = {"ts_code": code, "trade_date": days[i], "open": c, "high": c, "low": c, "close": float(c), "vol": 100.0, "pre_close": float(closes[i - 1]) if i else None}
        r.update({k: float(v[i]) if v[i] is not None else None for k, v in cols.items()})
        rows.append({k: (float(v) if isinstance(v, int) and k != "ts_code" else v) for k, v in r.items()})
    return spark.createDataFrame(rows, "ts_code string, trade_date date, open double, high double, low double, close double, vol double, pre_close double")


def test_ema_matches_pandas_across_blocks(spark):
    x = np.random.default_rng(1).normal(10, 2, 1300)
    df = timeseries.with_row_number(bars_frame(spark, x.tolist()))
    got = timeseries.add_ema(df, 14, {"close": "e"}).orderBy("trade_date").toPandas()["e"].to_numpy()
    want = pd.Series(x).ewm(span=14, adjust=False).mean().to_numpy()
    assert np.allclose(got, want, rtol=1e-12)


@pytest.fixture(scope="module")
def cross(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(3):
        for i in range(400):
            v = None if i % 37 == 0 else (1.0 if i % 3 == 0 else float(rng.integers(0, 50)))  # a third of the rows share one value
            rows.append((f"g{g}", f"{600000 + i}.SH", v))
    return spark.createDataFrame(rows, "g string, ts_code string, v double").cache()


def test_split_ranks_equal_plain_ranks(cross):
    for pct in (False, True):
        a = ranking.average_rank(cross, ["g"], "v", "r", 400, pct=pct).toPandas()
        b = ranking.average_rank(cross, ["g"], "v", "r", 400, pct=pct, plain_rows=10).toPandas()
        want = a.groupby("g")["v"].rank(pct=pct)
        assert np.allclose(a["r"].fillna(-1), want.fillna(-1))
        m = a.merge(b, on=["g", "ts_code"])
        assert len(m) == len(a) == len(b) and np.allclose(m["r_x"].fillna(-1), m["r_y"].fillna(-1))


def test_split_row_ranks_shares_and_percentiles_equal_plain(cross):
    full = cross.where("v is not null")
    for fn in (lambda p: ranking.row_rank(full, ["g"], "v", "ts_code", "r", 400, plain_rows=p),
               lambda p: ranking.share_at_most(cross, ["g"], "v", "r", 400, plain_rows=p)):
        a, b = fn(1000).toPandas(), fn(10).toPandas()
        m = a.merge(b, on=["g", "ts_code"])
        assert len(m) == len(a) == len(b) and np.allclose(m["r_x"].fillna(-1).astype(float), m["r_y"].fillna(-1).astype(float))
    probs = {"a": 0.1, "b": 0.5, "c": 0.9}
    a = ranking.percentiles(full, ["g"], "v", probs, 400).toPandas().sort_values("g")
    b = ranking.percentiles(full, ["g"], "v", probs, 400, plain_rows=10).toPandas().sort_values("g")
    assert np.allclose(a[list(probs)].to_numpy(), b[list(probs)].to_numpy())


def test_panel_ic_same_in_both_plans(spark):
    rng = np.random.default_rng(5)
    rows = [(dt.date(2024, 1, 1) + dt.timedelta(days=d), float(rng.integers(0, 9)), float(rng.normal()), float(rng.normal())) for d in range(5) for _ in range(60)]
    df = spark.createDataFrame(rows, "trade_date date, f1 double, f2 double, y double")
    go = lambda p: ic.panel_ic(df, ["f1", "f2"], {1: "y"}, 60, 5, 2, plain_rows=p).toPandas().sort_values("feature").reset_index(drop=True)
    pd.testing.assert_frame_equal(go(1000), go(10))


def test_opposed_factor_has_ic_minus_one(spark):
    df = spark.createDataFrame([(dt.date(2026, 1, 1), f"{i}", float(i), float(5 - i)) for i in range(1, 5)], "signal_date date, ts_code string, f double, ret_1d double")
    r = ic.ic_by_date(df, ["f"], ["ret_1d"], 4).first()
    assert r["ic"] == pytest.approx(-1) and r["rank_ic"] == pytest.approx(-1) and r["n"] == 4


def test_constant_factor_has_no_ic(spark):
    df = spark.createDataFrame([(dt.date(2026, 1, 1), f"{i}", 1.0, float(i)) for i in range(4)], "signal_date date, ts_code string, f double, ret_1d double")
    r = ic.ic_by_date(df, ["f"], ["ret_1d"], 4).first()
    assert r["ic"] is None and r["rank_ic"] is None


def test_quantiles_follow_qcut(spark):
    rng = np.random.default_rng(2)
    rows = [(dt.date(2026, 1, 1 + d), f"{i:03d}", float(rng.permutation(100)[i % 100]), float(i)) for d in range(3) for i in range(7 + 5 * d)]
    df = spark.createDataFrame(rows, "signal_date date, ts_code string, f double, ret_1d double")
    got = ic.quantile_returns(df, ["f"], ["ret_1d"], 5, 100).toPandas()
    pdf = df.toPandas().sort_values("ts_code")
    for d, g in pdf.groupby("signal_date"):
        q = min(5, g["f"].nunique(), len(g))
        want = (pd.qcut(g["f"].rank(method="first"), q=q, labels=False) + 1).value_counts().to_dict()
        assert got[got["signal_date"] == d].set_index("quantile")["n"].to_dict() == want


def test_quantiles_and_ic_same_in_both_plans(spark):
    rng = np.random.default_rng(4)
    rows = [(dt.date(2026, 1, 1 + d), f"{600000 + i}", None if i % 29 == 0 else float(rng.integers(0, 3)), float(rng.normal())) for d in range(2) for i in range(120)]
    df = spark.createDataFrame(rows, "signal_date date, ts_code string, f double, ret_1d double")
    for fn, key in ((lambda p: ic.quantile_returns(df, ["f"], ["ret_1d"], 5, 120, plain_rows=p), ["signal_date", "quantile"]),
                    (lambda p: ic.ic_by_date(df, ["f"], ["ret_1d"], 120, plain_rows=p), ["signal_date"])):
        a, b = (fn(p).toPandas().sort_values(key).reset_index(drop=True) for p in (1000, 10))
        pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False)


def test_pairs_with_gaps_rank_as_in_pandas(spark):
    rng = np.random.default_rng(6)
    gap = lambda v: None if rng.random() < 0.2 else float(v)
    rows = [(d, gap(rng.integers(0, 5)), gap(rng.normal()), gap(rng.integers(0, 4)), gap(rng.normal())) for d in range(3) for _ in range(50)]
    df = spark.createDataFrame([*rows, (9, 1.0, None, None, None)], "signal_date int, f1 double, f2 double, y1 double, y2 double")
    out = ic.ic_by_date(df, ["f1", "f2"], ["y1", "y2"], 50)
    assert "explode" not in out._jdf.queryExecution().optimizedPlan().toString().split("Window")[-1]  # a row is ranked once, not once a pair
    got, pdf = {(r["signal_date"], r["factor"], r["return_col"]): r for r in out.collect()}, df.toPandas()
    assert len(got) == 16 and got[9, "f1", "y1"]["n"] == 0
    for (d, f, y), r in got.items():
        both = pdf[pdf["signal_date"] == d][[f, y]].dropna()
        if len(both) > 2:
            assert r["n"] == len(both) and r["rank_ic"] == pytest.approx(both[f].rank().corr(both[y].rank())) and r["ic"] == pytest.approx(both[f].corr(both[y]))


def test_study_of_pooled_sizes_ranks_no_pool(spark, monkeypatch):
    df = spark.createDataFrame([(dt.date(2026, 1, 1), f"{i}", "a", float(i), float(-i)) for i in range(6)], "signal_date date, ts_code string, industry string, f double, ret_1d double")
    monkeypatch.setattr(ranking, "placed", lambda *_: pytest.fail("ranked the pool"))
    study = ic.evaluate_factors(df, ["f"], ["ret_1d"], 6, ranking.PLAIN_ROWS + 1, pooled_ranks=False)
    r = study.robustness.first()
    assert r["n"] == 6 and r["ic"] == pytest.approx(-1)


def test_percentiles_sort_only_values_near_them(spark, monkeypatch):
    rng = np.random.default_rng(7)
    vals = {"a": rng.normal(size=40000), "b": rng.integers(0, 3, 9000).astype(float), "c": np.array([5.0]), "d": np.array([1.0, 2.0])}
    df = spark.createDataFrame(pd.DataFrame([(g, v) for g, vs in vals.items() for v in vs], columns=["g", "v"]))
    sorted_rows, own = [], ranking.running
    monkeypatch.setattr(ranking, "running", lambda d, *a: (sorted_rows.append(d.count()), own(d, *a))[1])
    got = ranking.percentiles(df, ["g"], "v", {"p10": 0.1, "p90": 0.9}, 10**9, 10).toPandas().set_index("g")
    for g, vs in vals.items():
        assert got.loc[g, "p10"] == pytest.approx(np.percentile(vs, 10), abs=1e-12) and got.loc[g, "p90"] == pytest.approx(np.percentile(vs, 90), abs=1e-12)
    assert 0 < sum(sorted_rows) < 2000
    monkeypatch.setattr(ranking, "_around", lambda *_: None)  # ends that miss a place: all values are placed
    pd.testing.assert_frame_equal(got, ranking.percentiles(df, ["g"], "v", {"p10": 0.1, "p90": 0.9}, 10**9, 10).toPandas().set_index("g").loc[got.index])


@pytest.mark.parametrize("high, kind", [([600, 7, 90], "bigint"), ([2**40, 7, 2**30], "decimal(38,0)")])
def test_lines_keep_their_order_in_one_number(spark, high, kind):
    rng = np.random.default_rng(8)
    rows = [(int(d), int(o), int(n), int(p)) for d, o, n, p in zip(rng.integers(0, 7, 200), rng.integers(0, high[0] + 1, 200), rng.integers(0, 8, 200), rng.integers(0, high[2] + 1, 200))]
    df = spark.createDataFrame([*rows, (6, *high), (0, 0, 0, 0)], "d int, o long, n long, p long")
    out = df.withColumn("s", adapters.packed(F.col("d"), ["o", "n", "p"], [0, 0, 0], high))
    assert dict(out.dtypes)["s"] == kind
    got = [tuple(r)[:4] for r in out.orderBy("s").collect()]
    assert got == sorted(got)


def test_top_n_ties_by_code(spark):
    df = spark.createDataFrame([("b", 90.0), ("a", 90.0), ("c", 80.0)], "ts_code string, s double").withColumn("d", F.lit(1))
    got = [r["ts_code"] for r in ranking.top_n(df, ["d"], 2, F.desc("s"), F.col("ts_code")).orderBy(F.desc("s"), "ts_code").collect()]
    assert got == ["a", "b"]


def test_forward_label_timing_and_statuses(spark):
    b = bars_frame(spark, [10.0, 12.0, 13.2, 14.0], start="2026-01-01", open=[10.0, 11.0, 12.5, 13.5])
    sig = spark.createDataFrame([("r", dt.date(2026, 1, 1), "600001.SH"), ("r", dt.date(2026, 1, 4), "600001.SH"), ("r", dt.date(2026, 1, 1), "000002.SZ")],
                                "run_id string, signal_date date, ts_code string")
    got = {(r["ts_code"], r["signal_date"].day): r for r in labels.forward_labels(b, sig, (1, 3)).collect()}
    first = got[("600001.SH", 1)]
    assert first["entry_date"] == dt.date(2026, 1, 2) and first["entry_open"] == 11.0
    assert first["ret_1d"] == pytest.approx(13.2 / 11 - 1) and first["ret_3d"] is None
    assert first["limit_up_at_entry"] and not first["tradable_buy"]  # opened ten percent up
    assert got[("600001.SH", 4)]["label_status"] == "missing_entry"
    assert got[("000002.SZ", 1)]["label_status"] == "missing_price_history"


def test_sell_waits_while_limit_down(spark):
    b = bars_frame(spark, [10.0, 9.0, 9.2], start="2026-01-01", open=[10.0, 9.0, 9.1])
    p = spark.createDataFrame([("600001.SH", dt.date(2026, 1, 2))], "ts_code string, planned date")
    assert labels.first_sellable(b, p, "planned").first()["sell_date"] == dt.date(2026, 1, 3)


def test_limits_by_board(spark):
    df = spark.createDataFrame([("830001.BJ",), ("300001.SZ",), ("688001.SH",), ("600001.SH",)], "c string")
    assert [r[0] for r in df.select(labels.limit_pct(F.col("c"))).collect()] == [0.30, 0.20, 0.20, 0.10]


def test_snapshots_append_once_and_refuse_changes(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/snap"
    rows = spark.createDataFrame([("r", dt.date(2026, 1, 1), "600001.SH", 80.0), ("r", dt.date(2026, 1, 1), "600002.SH", 70.0)],
                                 "run_id string, signal_date date, ts_code string, alpha_rank_score double")
    a = snapshots.prepare(rows, "v1", "h", "2026-01-01T00:00:00Z")
    again = snapshots.prepare(rows, "v1", "h", "2026-01-02T00:00:00Z")
    assert snapshots.append_snapshots(spark, path, a) == 2
    assert snapshots.append_snapshots(spark, path, again) == 0
    changed = snapshots.prepare(rows.withColumn("alpha_rank_score", F.lit(1.0)), "v1", "h", "x")
    with pytest.raises(ValueError, match="conflicting"):
        snapshots.append_snapshots(spark, path, changed)
    with pytest.raises(ValueError, match="already exist"):
        snapshots.append_snapshots(spark, path, again, idempotent=False)
    with pytest.raises(ValueError, match="duplicate"):
        snapshots.append_snapshots(spark, path, a.union(a))


def _walk(n=160, seed=7):
    rng = np.random.default_rng(seed)
    close = 10 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
    open_ = close * np.exp(rng.normal(0, 0.01, n))
    return close, open_, np.maximum(open_, close) * 1.01, np.minimum(open_, close) * 0.99


def test_patterns_do_not_change_when_the_future_is_cut(spark):
    close, open_, high, low = _walk()
    vol = np.random.default_rng(1).uniform(50, 300, len(close))
    full = bars_frame(spark, close.tolist(), open=open_, high=high, low=low, vol=vol)
    cut = full.where(F.col("trade_date") < dt.date(2024, 1, 1) + dt.timedelta(days=110))
    cols = ["trade_date", *patterns.PATTERNS]
    a = patterns.add_patterns(full).select(cols).orderBy("trade_date").toPandas().head(110)
    b = patterns.add_patterns(cut).select(cols).orderBy("trade_date").toPandas()
    pd.testing.assert_frame_equal(a, b)
    assert a[list(patterns.PATTERNS)].sum().gt(0).sum() >= 5


def test_retest_against_brute_force(spark):
    close, open_, high, low = _walk(200, 11)
    df = patterns.add_patterns(bars_frame(spark, close.tolist(), open=open_, high=high, low=low)).orderBy("trade_date").toPandas()
    want = np.zeros(len(df))
    for i in range(len(df)):
        if df["bos"][i] != 1:
            continue
        lo, hi = df["last_swing"][i] - 0.3 * df["pattern_atr"][i], df["last_swing"][i] + 0.2 * df["pattern_atr"][i]
        for j in range(i + 1, min(len(df), i + 21)):
            if lo <= df["low"][j] <= hi and df["close"][j] > lo:
                want[j] = 1
                break
    assert (df["true_bos"].to_numpy() == want).all() and want.sum() > 0


def test_positive_run_and_trend(spark):
    df = spark.createDataFrame([([-5.0, -2.0, 1.0, 3.0, 5.0, 7.0, 8.0, 10.0],)], "a array<double>")
    r = df.select(fundamentals.positive_run(F.col("a")).alias("run"), fundamentals.trend_delta(F.col("a")).alias("d"), fundamentals.quarterly_cagr(F.col("a")).alias("g")).first()
    assert r["run"] == 6 and r["d"] == pytest.approx((7.5 - (-0.75)) / 7.5) and -0.5 <= r["g"] <= 2.0


def _quarters(spark, revenue, income):
    rows = [("600001.SH", dt.date(2022 + i // 4, 3 * (i % 4) + 3, 28), float(r), float(n), 40.0, float(n) * 1.2) for i, (r, n) in enumerate(zip(revenue, income))]
    return spark.createDataFrame(rows, "ts_code string, end_date date, revenue double, net_income double, gross_margin double, n_cashflow_act double")


@pytest.mark.parametrize("revenue,income,stages", [
    ([1e7 * 1.2**i for i in range(8)], [-5e6 + 4e5 * i for i in range(8)], {"growth"}),
    ([1e9 * 1.01**i for i in range(8)], [1e8] * 8, {"mature"}),
    ([1e9 * 0.9**i for i in range(8)], [1e8 - 3e7 * i for i in range(8)], {"declining", "cyclical"}),
])
def test_lifecycle_archetypes(spark, revenue, income, stages):
    basic = spark.createDataFrame([("600001.SH", "软件")], "ts_code string, industry string")
    r = fundamentals.fundamental_quality(_quarters(spark, revenue, income), basic).first()
    assert r["stage"] in stages and 0 <= r["fundamental_quality_score"] <= 100 and 1 <= len(r["bullets"]) <= 5


def test_single_quarter_is_unknown_and_neutral(spark):
    basic = spark.createDataFrame([("600001.SH", "银行")], "ts_code string, industry string")
    q = fundamentals.fundamental_quality(_quarters(spark, [1e8], [1e7]), basic)
    assert q.first()["stage"] == "unknown"
    got = fundamentals.quick_screen(basic.select("ts_code"), q).first()
    assert got["fundamental_quality_score"] == 50.0 and got["lifecycle_stage"] == "unknown"


def test_diversify_equals_plain_greedy(spark):
    rng = np.random.default_rng(9)
    n = 300
    rows = [("r", f"{i:04d}", f"t{rng.integers(0, 3)}", f"i{rng.integers(0, 4)}", i + 1) for i in range(n)]
    df = spark.createDataFrame(rows, "run_id string, ts_code string, primary_theme string, industry string, pos int")
    got = [r["ts_code"] for r in selection.diversify(df, "run_id", "pos").orderBy("pick_order").collect()]
    themes, inds, taken = {}, {}, []
    for _, code, t, i, _p in rows:
        if len(taken) < 10 and themes.get(t, 0) < 4 and inds.get(i, 0) < 4:
            taken.append(code)
            themes[t] = themes.get(t, 0) + 1
            inds[i] = inds.get(i, 0) + 1
    assert got == (taken + [r[1] for r in rows if r[1] not in taken])[:10]


def _hit(spark, title, snippet, date="2024-01-20", url="https://a.com/1"):
    return spark.createDataFrame([(1, "600001.SH", "华光股份", "600001", title, snippet, url, date)],
                                 "doc_id long, ts_code string, name string, symbol string, title string, snippet string, url string, date string")


@pytest.mark.parametrize("snippet,url,want", [
    ("华光股份 股东计划减持不超过1%股份", "https://a.com/1", None), ("华光股份 股东计划减持不超过5%股份", "https://a.com/1", "material_reduction"),
    ("华光股份 因涉嫌信披违规被立案调查", "https://a.com/1", "recent_investigation"), ("另一公司被立案调查。华光股份发布年报", "https://a.com/1", None),
    ("华光股份 因涉嫌信披违规被立案调查", "https://a.com/q?stockCode=600999", None), ("华光股份 重大诉讼 被告 已和解", "https://a.com/1", None),
])
def test_hard_veto_needs_identity_in_the_sentence(spark, snippet, url, want):
    got = evidence.hard_veto(_hit(spark, "公告", snippet, url=url), "2024-01-31", 60, 0.03).first()["veto"]
    assert got == want


def test_old_hits_are_no_veto(spark):
    h = _hit(spark, "公告", "华光股份 因涉嫌信披违规被立案调查", date="2022/01/01")
    assert evidence.hard_veto(h, "2024-01-31", 60, 0.03).first()["veto"] is None


def test_chunks_stay_in_budget(spark):
    items = ["x" * n for n in (60, 100, 80, 900, 20, 20, 190, 30)]
    ids = evidence.chunk_items(spark.createDataFrame([(items,)], "items array<string>"), "items", 100).first()["chunk"]
    cur, used, want = 0, 0, []
    for t in items:
        n = -(-len(t) // 2)
        if used and used + n > 100:
            cur, used = cur + 1, 0
        want.append(cur)
        if n > 100:
            cur, used = cur + 1, 0
        else:
            used += n
    assert ids == want


def test_flatten_hits_reads_aliases_and_drops_repeats(spark):
    body = '{"results":[{"title":"a","link":"u1","description":"d","published":"2024"},{"title":"b","url":"u1"},{"title":"c","href":"u2","content":"x"}]}'
    got = evidence.flatten_hits(spark.createDataFrame([("q", body)], "query string, body string"), "body", ["query"]).orderBy("pos").collect()
    assert [(r["url"], r["title"]) for r in got] == [("u1", "a"), ("u2", "c")]


def test_sql_guard():
    assert catalog.check_read_only("SELECT 1;") == "SELECT 1"
    for bad in ("DROP TABLE x", "SELECT 1; DELETE FROM x", "WITH a AS (SELECT 1) INSERT INTO b SELECT 1"):
        with pytest.raises(ValueError):
            catalog.check_read_only(bad)


def test_readers_normalise_and_upsert(spark):
    raw = spark.createDataFrame([("a", "20240102", "1.5", "2", "1", "1.8", 10), ("a", "20240103", "0", "2", "1", "1", 5), ("a", "bad", "1", "1", "1", "1", 1)],
                                "ts_code string, trade_date string, open string, high string, low string, close string, volume int")
    got = readers.normalise_bars(raw).collect()
    assert len(got) == 1 and got[0]["trade_date"] == dt.date(2024, 1, 2) and got[0]["vol"] == 10.0
    old = spark.createDataFrame([("a", dt.date(2023, 3, 31), 1.0)], "ts_code string, end_date date, eps double")
    new = spark.createDataFrame([("a", dt.date(2023, 3, 31), 2.0), ("a", dt.date(2023, 6, 30), 3.0)], "ts_code string, end_date date, eps double")
    assert sorted(r["eps"] for r in readers.upsert_quarters(old, new).collect()) == [2.0, 3.0]


def test_stream_bars_and_snapshot_sink(spark):
    from tickloom.sources import sinks
    from tickloom.streaming import streams

    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = spark.createDataFrame([("2024-01-01 10:00:00", "a", 1.0), ("2024-01-01 11:00:00", "a", 3.0), ("2024-01-05 10:00:00", "a", 2.0)], "t string, ts_code string, value double")
    sinks.write_parquet(rows.select(F.to_timestamp("t").alias("ts"), "ts_code", "value"), base + "/in")
    src = spark.readStream.schema("ts timestamp, ts_code string, value double").parquet(base + "/in")
    q = streams.bars_from_events(src).writeStream.outputMode("complete").format("memory").queryName("stream_bars").start()
    q.processAllAvailable()
    q.stop()
    got = {str(r["bar_start"])[:10]: (r["open"], r["close"]) for r in spark.table("stream_bars").collect()}
    assert got == {"2024-01-01": (1.0, 3.0), "2024-01-05": (2.0, 2.0)}
    snap = snapshots.prepare(spark.createDataFrame([("r", dt.date(2026, 1, 1), "a")], "run_id string, signal_date date, ts_code string"), "v", "h", "x")
    write = streams.snapshot_sink(spark, base + "/snap")
    write(snap, 0)
    write(snap, 0)
    assert spark.read.parquet(base + "/snap").count() == 1


def test_trace_skips_malformed_lines(spark):
    from tickloom.sources import sinks

    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    sinks.append_trace(spark, base + "/t", spark.createDataFrame([("2024", "start", "{}")], "ts string, event string, payload string"))
    with open(base + "/t/bad.json", "w") as f:
        f.write("{broken\n")
    assert [r["event"] for r in readers.read_trace(spark, base + "/t").collect()] == ["start"]


def test_technical_list_is_cut_by_pre_audit(spark):
    from tickloom.operators import selection

    rows = [(f"s{i:02d}", float(i), float(100 - i), 60.0) for i in range(25)]  # the two scores run against each other
    universe = spark.createDataFrame(rows, "ts_code string, pre_audit double, composite_score double, consolidation_score double")
    matched = spark.createDataFrame([("s24", ["policy"]), ("s00", [])], "ts_code string, matched_themes array<string>")
    themes = spark.createDataFrame([("policy", "weak", False)], "theme string, status string, capital_signal boolean")
    got = [(r.ts_code, r.list_type) for r in selection.dual_list(universe, matched, themes, 0).orderBy("position").collect()]
    assert got == [("s24", "both")] + [(f"s{i:02d}", "technical") for i in range(23, 13, -1)]
