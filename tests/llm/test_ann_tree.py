"""Nearest neighbours against brute force, and defined cases."""

from __future__ import annotations

import numpy as np

from tickloom.llm import ann_tree
from tickloom.llm.queries import op5_nearest


def brute(rows, k=20):
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for n in np.flatnonzero(ids % 20 == 0):
        s = (v[n] * v).sum(1)
        able = np.flatnonzero(ids != ids[n])
        out[ids[n]] = [(int(ids[j]), s[j]) for j in able[np.lexsort((ids[able], -s[able]))][:k]]
    return out


def test_recall_on_the_table(spark):
    sf = "/root/testdata/sf0.1"
    want = brute([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()])
    got = {}
    for r in sorted(op5_nearest(spark, sf).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(g) == 20 for g in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 20 * len(want)
    scores = {q: dict(w) for q, w in want.items()}
    assert all(abs(s - scores[q][i]) < 1e-12 for q in got for i, s in got[q] if i in scores[q])


def test_odd_vectors_ties_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (3, [1.0, 0.0]), (2, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]),
            (8, [float("inf"), 1.0]), (None, [1.0, 1.0]), (9, [1.0]), (40, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in sorted(ann_tree.search(df, lambda i: i % 20 == 0).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.id, r.score))
    assert got == {0: [(2, 1.0), (3, 1.0), (9, 1.0), (20, 0.0)], 20: [(0, 0.0), (2, 0.0), (3, 0.0), (9, 0.0)]}  # a shorter vector is filled up
    assert ann_tree.search(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_very_small_and_very_large_numbers(spark):
    """Nothing drops out for the size of its numbers; repeated ids and columns of other names are left alone."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.choice([-200, -3, 0, 150])).tolist()) for i in range(300)] + [(20, [1e-200, 0.0, 0.0, 0.0]), (40, [1e160, 1e160, -1e160, 0.0]), (301, [0.0, -0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, leaf int, score double")
    got = {}
    for r in ann_tree.search(df, lambda i: i % 20 == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r.id, r.score))
    rows = [r for r in rows if any(r[1])]
    ids, v = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    with np.errstate(all="ignore"):
        best = hits = 0
        for n in np.flatnonzero(ids % 20 == 0):
            s = (v[n] * v).sum(1)
            able = np.flatnonzero((ids != ids[n]) & ~np.isnan(s))
            want = able[np.lexsort((ids[able], -s[able]))][:5]
            best += len(want)
            hits += sum((ids[j], s[j]) in got[ids[n]] for j in want)
    assert set(got) == {i for i, _ in rows if i % 20 == 0} and all(len(g) == 5 * (2 if q in (20, 40) else 1) for q, g in got.items()) and hits >= 0.9 * best
