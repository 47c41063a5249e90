"""Prefix trie against texts rebuilt in full, and its defined cases."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from tickloom.llm import conversation_trie
from tickloom.llm.queries import op13_prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def slow_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + own[c][h:])  # % as in SQL
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in members:
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
    out = []
    for node, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if built[c] == node)))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]), leaves[node], saved[node],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def same(df, rows):
    assert df.columns == COLUMNS
    got = sorted(map(tuple, df.collect()), key=repr)
    assert got == slow_trie(rows)
    return got


def test_query_matches_rebuilt_texts(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    got = same(op13_prefix_trie(spark, sf), rows)
    assert any(r[3] > 1 and r[1] > 0 for r in got)


@pytest.mark.parametrize("ids", [1_000, 3])
def test_shared_prefixes(spark, monkeypatch, ids):
    """Few texts, so that prefixes meet in many ways; a long conversation; absent bases; a prefix that most share."""
    monkeypatch.setattr(conversation_trie, "IDS", ids)
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "bot"]) if t > 1 else "user", rng.choice(["a", "b", "é"]) if t > 2 else "hi") for c in range(-7, 160) if c % 11 for t in range(rng.choice([1, 2, 5, 12]))]
    rows += [(1000, t, "user", "x" * (t % 3)) for t in range(300)] + [(1001, t, "user", "x" * (t % 3)) for t in range(300)]
    same(conversation_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)), rows)


def test_defined_cases(spark):
    rows = [(None, 0, "user", "lost"), (6, None, "user", None), (6, 0, None, ""), (6, 1, "user", "a" * 200_000), (7, None, "user", ""), (7, 1, "", None), (12, 0, "user", "alone"), (20, 3, "user", "b"),
            (21, 3, "user", "b")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, depth int, fp string")
    same(conversation_trie.prefix_trie(df), rows)
    twice = spark.createDataFrame([(5, 1, "user", "a"), (5, 1, "user", "a"), (8, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    same(conversation_trie.prefix_trie(twice), [tuple(r) for r in twice.collect()])
    assert conversation_trie.prefix_trie(df.limit(0)).count() == 0


def test_colliding_bases_are_replaced(spark, monkeypatch):
    """Bases of zero make all prefixes of a depth collide; the next pair is taken."""
    monkeypatch.setattr(conversation_trie, "BASES", ((0, 0), conversation_trie.BASES[1]))
    monkeypatch.setattr(conversation_trie, "pow", lambda b, e, p: pow(b, e, p) if b or e >= 0 else 0, raising=False)
    rows = [(c, t, "user", f"{c % 3} {t}") for c in range(12) for t in range(4)]
    same(conversation_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), rows)
