"""SimHash near-duplicates against all pairs, and its defined cases."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from tickloom.llm import near_copies, simhash
from tickloom.llm.queries import op2_simhash


def slow_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > len(hashes))


def slow_components(fps):
    """Smallest index reachable, by union-find over all pairs of distinct values."""
    values = sorted(set(fps))
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    arr = np.array(values, np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1:] ^ arr[i]) <= 3):
            parent[find(v)] = find(values[i + 1 + j])
    least = {}
    for k, v in enumerate(fps):
        least.setdefault(find(v), k)
    return [least[find(v)] for v in fps]


def test_query_matches_all_pairs(spark):
    sf = "/root/testdata/sf0.01"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    fps = [slow_fingerprint(t) for _, t in docs]
    want = {d: (f"{f:016x}", docs[c][0]) for (d, _), f, c in zip(docs, fps, slow_components(fps))}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op2_simhash(spark, sf).collect()} == want


def test_links_lose_nothing_in_crowded_neighbourhoods(spark):
    rng = random.Random(5)
    fps = []
    for _ in range(60):
        centre = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 20])):
            v = centre
            for _ in range(rng.randrange(7)):
                v ^= 1 << (rng.randrange(64) if rng.random() < 0.5 else rng.randrange(16))
            fps.append(v)
    fps = sorted(set(fps))
    signed = [v - 2**64 if v >= 2**63 else v for v in fps]
    got = simhash.components(simhash.edges(simhash.variants(spark.createDataFrame([(v,) for v in signed], "fp long")))).collect()
    root = {r.node: r.root for r in got}
    groups = {}
    for v, c in zip(signed, slow_components(fps)):
        groups.setdefault(c, set()).add(root.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) == len(groups)


def test_long_chain_is_one_component(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a long, b long")
    roots = {r.node: r.root for r in simhash.components(pairs).collect()}
    assert {roots[i] for i in range(201)} == {0} and roots[1001] == 1000


@pytest.fixture
def odd(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text), (3, text.upper()), (9, None), (8, ""), (None, text), (3, text.upper()), (11, "one"), (12, "word " * 30000 + "end")]
    return spark.createDataFrame([(k, t, "x", 1, 2) for k, t in rows], "doc_id long, text string, fp string, key int, component int")


def test_defined_cases(odd):
    got = sorted((r.key or -1, r.component) for r in simhash.near_duplicates(odd).collect())
    assert got == [(-1, 3), (3, 3), (3, 3), (5, 3), (8, 8), (9, 8), (11, 11), (12, 12)]
    kept = near_copies.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 8, 11, 12]


def test_empty_table(odd):
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
