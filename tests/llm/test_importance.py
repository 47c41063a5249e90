"""Importance resampling against a plain scan, and its defined cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tickloom.llm import importance
from tickloom.llm.queries import op12_importance


def slow_features(text, run):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [" ".join(words[i:i + k]) for k in range(1, run + 1) for i in range(len(words) - k + 1)]


def slow(docs, target, run, buckets, percent=10, least=20):
    number = lambda f: zlib.crc32(f.encode()) % buckets
    each = [(k, *slow_features(t, run)) for k, t in docs]
    s = Counter(number(f) for _, _, fs in each for f in fs)
    t = Counter(number(f) for x in target for f in slow_features(x, run)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for k, words, fs in each:
        weight = sum(gain(number(f)) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append([k, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    may = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(may[:percent * len(may) // 100], 1):
        r[4] = i
    return sorted([r[:5] for r in rows], key=repr)


def test_query_matches_plain_scan(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = op12_importance(spark, sf)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(list, got.collect()), key=repr) == slow(docs, target, 1, 10_000)


@pytest.mark.parametrize(("run", "head", "buckets"), [(1, 5, 64), (2, 40, 64), (2, 100_000, 70_000), (3, 40, 1_000), (3, 1, 64)])
def test_head_and_tail_agree(spark, run, head, buckets):
    rng = random.Random(run)
    word = lambda: rng.choice(["the", "of", "a", "é", f"W{rng.randrange(90)}"])
    docs = [(k, " ".join(word() for _ in range(rng.randrange(60)))) for k in range(200)]
    target = [" ".join(word() for _ in range(12)) for _ in range(9)]
    got = importance.resampled(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string"),
                               run=run, head=head, buckets=buckets).select("key", "n_features", "weight", "score", "rank")
    assert sorted(map(list, got.collect()), key=repr) == slow(docs, target, run, buckets)


def test_defined_cases(spark):
    long = " ".join(f"w{i % 50}" for i in range(60_000))
    docs = [(1, None), (2, ""), (3, " ?! "), (None, long), (None, None), (4, long), (4, long), (4, "other words here"), (5, "x " * 19), (6, "Äx " * 20)]
    df = spark.createDataFrame([(*r, 1, "b") for r in docs], "doc_id long, text string, rank int, buckets string")
    none = spark.createDataFrame([(None,)], "text string")
    got = [list(r)[:1] + list(r)[2:] for r in importance.resampled(df, none, percent=50).collect()]
    assert sorted(got, key=repr) == slow(docs, [None], 1, 10_000, 50)
    assert importance.resampled(df.limit(0), none.limit(0)).count() == 0
