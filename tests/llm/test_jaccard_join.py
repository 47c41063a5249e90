"""Jaccard join against all pairs, and its defined cases."""

from __future__ import annotations

import random
import re
import time

import pyarrow as pa
import pytest

from tickloom.llm import jaccard_join
from tickloom.llm.queries import op11_jaccard_join


def slow_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))) if words else frozenset()


def slow_components(sets):
    """Smallest position reachable over all linked pairs."""
    parent = list(range(len(sets)))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    for x, i in enumerate(order):
        for j in order[x + 1:]:
            if 100 * len(sets[i]) < 85 * len(sets[j]):
                break
            both = len(sets[i] & sets[j]) if sets[i] else 0
            if sets[i] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(sets))]


def check(rows, got):
    rows = sorted(rows)
    sets = [slow_set(t) for _, t in rows]
    want = {k: (len(s), rows[c][0]) for (k, _), s, c in zip(rows, sets, slow_components(sets))}
    assert got == want
    return want


def test_query_matches_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op11_jaccard_join(spark, sf)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    want = check(rows, {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()})
    assert len({c for _, c in want.values()}) < len(want)


@pytest.mark.parametrize("part", [2_000, 5])
def test_families_of_near_copies(spark, monkeypatch, part):
    """Families edited step by step and all from one text, near the threshold, with a passage that most texts share; lists dealt over tasks too."""
    monkeypatch.setattr(jaccard_join, "LIST", part)
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(40)]
    rows = []
    for family in range(14):
        base = [word() for _ in range(rng.choice([12, 60, 200]))] + (passage if family % 2 else [])
        for step in range(rng.choice([1, 5, 40])):
            text = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5])):
                text[rng.randrange(len(text))] = rng.choice([word(), "edit", "other"])
            if rng.random() < 0.3:
                text = text[:rng.randrange(len(text) * 8 // 10, len(text) + 1)]
            if rng.random() < 0.3:
                base = text
            rows.append((rng.randrange(1 << 40), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.key: (r.n_shingles, r.component) for r in jaccard_join.similar_documents(docs).collect()}
    want = check(rows, got)
    assert 14 < len({c for _, c in want.values()}) < len(rows)


def test_defined_cases(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (3, text.upper() + " "), (9, None), (8, ""), (None, text), (3, text), (3, "quite another text of its own"), (11, "one two"), (12, "One  TWO"), (13, "one"),
            (14, "word " * 30000 + "end of it all"), (15, " \t\n")]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, sid string, size int")
    got = sorted((r.key or -1, r.n_shingles, r.component) for r in jaccard_join.similar_documents(docs).collect())
    assert got == [(-1, 27, 3), (3, 3, 3), (3, 27, 3), (3, 27, 3), (5, 27, 3), (8, 0, 8), (9, 0, 9), (11, 1, 11), (12, 1, 11), (13, 1, 13), (14, 5, 14), (15, 0, 15)]
    assert jaccard_join.similar_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("at_once", [1, 60, 1 << 17])
def test_shingle_sets_of_odd_texts(monkeypatch, at_once):
    """Sizes, and what sets share, as of plain sets: all white space and near misses of it, words of any length, nulls, parts of arrays."""
    monkeypatch.setattr(jaccard_join, "BYTES", at_once)
    rng = random.Random(5)
    marks = ["a", "B", "b", "\xe9", "\u6f22", "\0", "\x1c", "\x85", "\xa0", *" \t\n\x0b\x0c\r"]
    texts = ["".join(rng.choice(marks) for _ in range(rng.choice([1, 3, 20, 200]))) for _ in range(150)]
    texts += [" ".join("x" * n for n in range(1, 140)), "y" * 3000, "y" * 3001, None, "", "\n"]
    for size in (1, 2, 4):
        plain = []
        for t in texts:
            words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
            plain.append({tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
        column = pa.array([None, "before", *texts], pa.string()).slice(2)
        sets = [set(s.tolist()) for s in jaccard_join.shingle_sets(column, size)]
        assert [len(s) for s in sets] == [len(p) for p in plain]
        assert all(len(s & t) == len(p & q) for s, p in zip(sets, plain) for t, q in zip(sets, plain))
    assert jaccard_join.shingle_sets(column.slice(0, 0), 4) == []


def test_shingles_cost_no_more_than_a_few_splits():
    """Of texts with more different words than a cache holds."""
    rng = random.Random(6)
    column = pa.array([" ".join(f"{rng.randrange(400_000):x}word" for _ in range(400)) for _ in range(2_000)])

    def seconds(f):
        def once():
            start = time.thread_time()
            f()
            return time.thread_time() - start

        return min(once() for _ in range(3))

    assert seconds(lambda: jaccard_join.shingle_sets(column, 4)) < 4 * seconds(lambda: [t.as_py().encode().split() for t in column])
