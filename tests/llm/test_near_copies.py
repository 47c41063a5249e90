"""Near copies against all pairs by exact Jaccard: no false group, recall, and defined cases."""

from __future__ import annotations

import random
import re

from tickloom.llm import near_copies


def slow_set(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def slow_groups(rows, similarity=0.8):
    """Rows' group numbers over all pairs, and the linked pairs."""
    sets, links, parent = [slow_set(t) for _, t in rows], [], list(range(len(rows)))

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    order = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    for x, i in enumerate(order):
        for j in order[x + 1:]:
            if len(sets[i]) < similarity * len(sets[j]):
                break
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                links.append((i, j))
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(rows))], links


def measure(spark, rows):
    kept = {tuple(r) for r in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    group, links = slow_groups(rows)
    assert {group[i] for i, r in enumerate(rows) if r in kept} == set(group)  # no group is lost
    gone = [r for r in rows if r not in kept]
    can_go = len(rows) - len(set(group))
    return len(gone) / max(can_go, 1)


def test_recall_on_given_texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert measure(spark, rows) >= 0.95


def test_recall_near_the_threshold(spark):
    """Single copies with a few words changed, of similarity 0.8 to 0.9, and a crowd around one text."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(5000)}"
    rows, k = [], 0
    for n in range(250):
        base = [word() for _ in range(rng.choice([60, 200]))]
        for copy in range(2 if n else 300):
            text = list(base)
            for _ in range(max(1, len(base) // 60) if copy else 0):
                text[rng.randrange(len(text))] = word()
            rows.append((k := k + 1, " ".join(text)))
    assert measure(spark, rows) >= 0.9


def test_rows_of_one_id(spark):
    """Rows (3, a), (7, a), (7, unrelated b): b stays."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(3, a), (7, a), (7, b), (7, b), (9, b + " more"), (1, "short"), (2, "Short"), (4, None), (5, ""), (None, a)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, addr string, node int")
    kept = near_copies.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, a), (1, "short"), (3, a), (4, None), (7, b)]
    assert near_copies.keep_one(df.limit(0)).count() == 0


def test_layout_grows_with_the_corpus():
    assert near_copies.layout(200_000)[0] == 24 and near_copies.layout(10**10)[0] == 40 and near_copies.layout(10**10)[1] < 100
