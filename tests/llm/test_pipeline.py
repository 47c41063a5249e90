"""The pipeline's stages against brute force on their own inputs."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as cp
from tickloom.llm import mixing, pii, sentencepiece_codec

from .test_near_copies import slow_groups

SF = "/root/testdata/sf0.01"


def good(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    wins = Counter(tuple(words[i:i + 5]) for i in range(len(words) - 4))
    hit = {i + j for i in range(len(words) - 4) if wins[tuple(words[i:i + 5])] > 1 for j in range(5)}
    return len(words) >= 10 and 100 * len(hit) <= 20 * len(words) and 10 * len(re.findall(r"[#*$%&|<>]", text)) <= 3 * len(words)


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, frames[-1], SF).write.parquet(f"{tmp_path}/{k}")
        frames.append(spark.read.parquet(f"{tmp_path}/{k}"))
    raw, kept, single, private, mixed, tokens = ([r.asDict() for r in f.collect()] for f in frames)
    assert all(f.columns == docs.columns for f in frames[:-1])
    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for r in raw if good(r["text"]))
    group, links = slow_groups([(r["doc_id"], r["text"]) for r in kept])
    left, ids = {r["doc_id"] for r in single}, [r["doc_id"] for r in kept]
    assert len(left) == len(single) and {group[i] for i, d in enumerate(ids) if d in left} == set(group)  # one at least of each group, and none twice
    assert sum(not {ids[i], ids[j]} <= left for i, j in links) >= 0.95 * len(links) and links
    before = {r["doc_id"]: r["text"] for r in single}
    assert len(private) == len(single)
    for r in private:
        spans = pii.find_spans(before[r["doc_id"]])
        assert r["text"] == pii.masked(before[r["doc_id"]], spans) and r["n_chars"] == len(r["text"]) and (spans or r["text"] == before[r["doc_id"]])
        assert not [s for s in pii.find_spans(r["text"])]
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    times = Counter(r["doc_id"] for r in mixed)
    clean = [r.doc_id for r in labels if r.quality == 1 and r.toxic == 0 and r.doc_id in {p["doc_id"] for p in private}]
    toxic = [r.doc_id for r in labels if r.toxic == 1 and r.doc_id in {p["doc_id"] for p in private}]
    assert sum(times[d] > 0 for d in clean) >= 0.99 * len(clean) and sum(times[d] for d in toxic) < 0.3 * len(toxic)
    own = sentencepiece_codec.codec(sentencepiece_codec.model_bytes())
    texts = {r["doc_id"]: r["text"] for r in mixed}
    assert len(tokens) == len(mixed) and all(t["decodes"] and t["ids"] == own.reference.encode(texts[t["doc_id"]]) for t in tokens)


def shares(rows):
    whole = sum(r.rate * r.tokens for r in rows)
    return [sum(r.rate * r.tokens * r.posterior[k] for r in rows) / whole for k in range(3)]


def test_mix_of_all_documents(spark):
    """Every domain within a hundredth of its own weight in the output, no repeats, and rates as a plain projected gradient replays them."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    out = mixing.mixed(docs.select("doc_id", "text"), mixing.labelled_domains(labels))
    rows = out.collect()
    assert shares(rows) == pytest.approx([mixing.TARGETS[d] for d in mixing.DOMAINS], rel=1.5e-2)
    assert min(r.rate for r in rows) >= 0 and max(r.rate for r in rows) <= 1 and max(r.copies for r in rows) <= 1
    assert abs(sum(r.copies for r in rows) - sum(r.rate for r in rows)) < 0.05 * len(rows)
    said = {r.domain: r for r in mixing.summary(out, mixing.TARGETS).collect()}
    assert [said[d].share for d in mixing.DOMAINS] == pytest.approx(shares(rows)) and said["low"].repeated == 0


def test_mix_after_the_stages_before(spark):
    """On what the stage gets: quality rules leave little of the domain `low`, which then gives its weight to the others."""
    docs = cp.personal_data(spark, cp.near_duplicates(spark, cp.quality(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF), SF), SF)
    rows = mixing.mixed(docs.select("doc_id", "text"), mixing.labelled_domains(spark.read.parquet(f"{SF}/labels.parquet"))).collect()
    got, have = shares(rows), [sum(r.tokens * r.posterior[k] for r in rows) for k in range(3)]
    if have[1] > 0.05 * sum(have):
        assert got == pytest.approx([0.97, 0.02, 0.01], rel=1e-2)
    assert got[0] / got[2] == pytest.approx(97, rel=2e-2) and max(r.copies for r in rows) <= 1
    clean = [r.rate for r in rows if r.posterior[0] > 0.9]
    assert sum(clean) >= 0.9 * len(clean)


@pytest.mark.parametrize(("parts", "most"), [([(767, 0), (113, 1), (120, 2)], 1.0), ([(900, 0), (3, 1), (97, 2)], 1.0), ([(900, 0), (3, 1), (97, 2)], 20.0), ([(900, 0), (100, 2)], 1.0), ([(5, 1)], 1.0)])
def test_targets_of_sharp_posteriors(spark, parts, most):
    """Plentiful, scarce, repeated, absent and single domains: totals that a plain solver gives."""
    df = spark.createDataFrame([(t, [float(k == j) for j in range(3)]) for t, k in parts], "_tokens long, _posterior array<double>")
    fit = mixing.fit_rates(df, [0.97, 0.02, 0.01], most)
    have = [sum(t for t, k in parts if k == j) for j in range(3)]
    main = 0 if have[0] else 1
    want = [min(w / [0.97, 0.02, 0.01][main] * have[main], (1 if j == main else mixing.SCARCE) * have[j]) for j, w in enumerate([0.97, 0.02, 0.01])]
    assert fit.totals == pytest.approx(want, rel=1.1 * mixing.TOLERANCE) and max(fit.gaps()) <= mixing.TOLERANCE


def test_soft_posteriors_against_plain_gradient(spark):
    """The least-squares problem solved by many small projected steps in NumPy has the same totals."""
    rng = np.random.default_rng(5)
    p, t = rng.dirichlet([9, 0.3, 0.2], 400), rng.integers(1, 500, 400)
    fit = mixing.fit_rates(spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p)], "_tokens long, _posterior array<double>").repartition(3), [0.97, 0.02, 0.01])
    r, aim = np.ones(len(p)), np.array(fit.targets)
    for _ in range(60_000):
        r = np.clip(r - 0.9 * p @ (((r * t) @ p - aim) / t.sum()), 0, 1)
    gap = np.abs((r * t) @ p - aim) / aim
    assert max(fit.gaps()) <= mixing.TOLERANCE and max(gap) < 0.03
    assert (mixing.replayed(p, fit.steps, 1.0) * t) @ p == pytest.approx(np.array(fit.totals), rel=1e-6)


def test_gaps_that_remain_are_told(spark):
    """Blurred posteriors can't come to these weights without most of the corpus lost: totals are those of the rates, gaps are returned."""
    rng = np.random.default_rng(6)
    p, t = rng.dirichlet([4, 3, 3], 200), rng.integers(1, 500, 200)
    fit = mixing.fit_rates(spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(t, p)], "_tokens long, _posterior array<double>"), [0.97, 0.02, 0.01])
    assert (mixing.replayed(p, fit.steps, 1.0) * t) @ p == pytest.approx(np.array(fit.totals), rel=1e-6) and max(fit.gaps()) > 0.1


@pytest.fixture
def odd(spark):
    text = " ".join(f"word{i}" for i in range(40))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (None, text, None, None, None), (2, None, "en", "a", 0), (3, "", None, "b", 0),
            (4, "mail me x@y.com " + text, "fr", "b", 1), (5, " ".join(f"w{i}" for i in range(20_000)), "de", "c", 1)]
    return spark.createDataFrame([(*r, 7, "t") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept int, tokens string")


def test_odd_rows_and_clashing_columns(spark, odd):
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns
        got = out.collect()
        assert any(r.doc_id is None for r in got)
        empty = stage(spark, odd.limit(0), SF)
        assert empty.count() == 0 and empty.columns == odd.columns
    assert len(cp.tokens(spark, odd, SF).collect()) == 7


def test_labels_of_one_domain_or_none(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (4, None, None), (99, 0, 1)], "doc_id long, quality int, toxic int")
    one = mixing.mixed(odd.select("doc_id", "text"), mixing.labelled_domains(labels)).collect()
    none = mixing.mixed(odd.select("doc_id", "text"), mixing.labelled_domains(labels.limit(0))).collect()
    assert {tuple(r.posterior) for r in one} == {(1.0, 0.0, 0.0)} and len({tuple(r.posterior) for r in none}) == 1 and len(none) == 7
