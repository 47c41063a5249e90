"""Stupid-backoff scores against a plain model of any order, and their defined cases."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import lm_score

SF = "/root/testdata/sf0.001"


def slow_scores(texts, order, alpha=lm_score.ALPHA):
    split = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split() for t in texts]
    grams = lambda ws: Counter(tuple(ws[i:i + n]) for n in range(1, order + 1) for i in range(len(ws) - n + 1))
    every = Counter()
    for ws in split:
        every.update(grams(ws))
    total, out = sum(map(len, split)), []
    for ws in split:
        own = grams(ws)
        c = lambda *g: every[g] - own[g]
        score, seen = 0.0, 0
        for i, w in enumerate(ws):
            context = ws[max(0, i - order + 1):i]
            whole = len(context) == order - 1
            while context and not c(*context, w):
                context, score, whole = context[1:], score + math.log(alpha), False
            if context:
                score += math.log(c(*context, w) / c(*context))
            else:
                score += math.log((c(w) or alpha) / max(total - len(ws), 1))
            seen += whole and c(*context, w) > 0
        out.append((len(ws), score if ws else None, seen))
    return out


def same(docs, texts, **more):
    got = {r.key: r for r in lm_score.scored(docs, **more).collect()}
    assert len(got) == len(texts)
    for i, (n, score, seen) in enumerate(slow_scores(texts, more.get("order", lm_score.ORDER))):
        assert (got[i].n_words, got[i].seen) == (n, seen)
        assert got[i].log_score == score if score is None else got[i].log_score == pytest.approx(score, rel=1e-9)


@pytest.mark.parametrize("more", [{}, {"order": 1}, {"order": 2, "words": 100}, {"words": 3_000, "entries_in_part": 500}, {"order": 4, "words": 20_000}])
def test_scores_match_plain_model(spark, more):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()][:60]
    texts += ["", None, "the", "The the THE", "of the of " * 2000, "zzz yyy xxx www", texts[0], texts[0] + " and more"]
    same(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), texts, **more)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    for values in (np.sort(rng.integers(0, 1 << 40, 50, dtype=np.uint64)), np.sort(rng.integers(0, 1 << 20, 500, dtype=np.uint64)), np.empty(0, np.uint64)):
        assert (lm_score._sums(lm_score._gaps(values)) == values).all() and (lm_score._unpack(lm_score._pack(values)) == values).all()


def test_many_words(spark):
    """70,000 words beyond those of the given texts: nothing is closed, and unseen words back off."""
    texts = [" ".join(f"w{i}" for i in range(k, 70_000, 7)) for k in range(7)] + ["w1 w8 w15 w1 w8", "w9999999 w1"]
    same(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), texts)


def test_repeated_ids_and_clashing_columns(spark):
    rows = [(1, "a b c"), (1, "a b d"), (1, "a b c"), (None, "a b"), (None, None)]
    df = spark.createDataFrame([(k, t, 1.0, "x", "y") for k, t in rows], "doc_id long, text string, n double, key string, block string")
    got = lm_score.scored(df)
    assert got.columns == ["key", "n_words", "log_score", "seen"]
    want = sorted(((k, *s) for (k, _), s in zip(rows, slow_scores([t for _, t in rows], 3))), key=repr)
    assert [tuple(r[:2]) for r in sorted(map(tuple, got.collect()), key=repr)] == [w[:2] for w in want]
    assert sorted(r.log_score for r in got.collect() if r.log_score is not None) == pytest.approx(sorted(w[2] for w in want if w[2] is not None))
    assert lm_score.scored(df.limit(0)).count() == 0
