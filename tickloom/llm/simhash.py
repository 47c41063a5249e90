"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints link if they differ in at most 3 bits. The 64 bits are four blocks of 16. If one block is masked
out that holds exactly one of three differing bits, the other two bits lie in the remaining 48, so the half radius is 1:
every distinct fingerprint emits, for each masked block, its 48 remaining bits and all their one-bit changes (4 * 49
variants), and both sides of such a pair emit the variant in the middle. What else can happen is covered too: pairs that differ in at most two bits
agree in a block that can be masked, and three differences inside one block leave the same unmasked bits.

The variants are shuffled by (block, variant) and sorted; colliding fingerprints are verified by their Hamming distance. A
bucket holds at most 49 * 2^16 distinct fingerprints by construction, and links are emitted as chains and as edges between
neighbouring block values, never as all pairs; every two linked fingerprints stay connected. Groups are then joined by
rounds of large-star and small-star over the edges, each round written to the shared folder.

Defined cases: null and empty texts have fingerprint zero and link like any other; copies share a fingerprint and cost one
row; a repeated id gives a row each time; a null id keeps its row, and its component is the smallest id there is, or null;
an empty table gives an empty result; only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import discard, saved

RADIUS, BLOCK, SEED = 3, 16, 42
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
CHUNK = 1 << 16
#: Intermediate tables are cut into files by their rows, not by the number of shuffle partitions.
NODES_IN_FILE, EDGES_IN_FILE = 20_000, 500_000


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit fingerprint over word shingles, repeats included: a bit is set if it is in over half the hashes."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1:].tolist())]
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), CHUNK):
        part = np.array(hashes[k:k + CHUNK], np.uint64).astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, key: str, text: str, shingle: int = 3) -> DataFrame:
    """A row (key, fp) for every row of docs, from the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), fps], names=["key", "fp"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, "key long, fp long")


def variants(distinct: DataFrame) -> DataFrame:
    """(block, variant, fp): for each masked block the remaining bits and all their one-bit changes."""
    views = []
    for b in range(4):
        mask = ~(0xFFFF << (BLOCK * b)) & (2**64 - 1)
        flips = [0] + [1 << j for j in range(64) if j // BLOCK != b]
        views += [(b, *(v - 2**64 if v >= 2**63 else v for v in (mask, f))) for f in flips]
    each = F.explode(F.array(*[F.struct(F.lit(b).cast("byte").alias("b"), F.lit(m).cast("long").alias("m"), F.lit(f).cast("long").alias("f")) for b, m, f in views]))
    return distinct.select("fp", each.alias("v")).select(
        F.col("v.b").alias("block"), F.col("fp").bitwiseAND(F.col("v.m")).bitwiseXOR(F.col("v.f")).alias("variant"), "fp")


def _near(codes: np.ndarray, flips: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of sorted distinct codes whose values differ by one of the flips."""
    left, right = [], []
    for f in flips:
        target = codes ^ f
        up = np.flatnonzero(target > codes)
        at = np.searchsorted(codes, target[up])
        ok = at < len(codes)
        ok[ok] = codes[at[ok]] == target[up][ok]
        left.append(up[ok])
        right.append(at[ok])
    return np.concatenate(left), np.concatenate(right)


ONE = [1 << i for i in range(BLOCK)]
THREE = [1 << i | 1 << j | 1 << k for i in range(BLOCK) for j in range(i) for k in range(j)]


def links(block: np.ndarray, variant: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links between the fingerprints of whole buckets, sorted by (block, variant)."""
    none = np.empty(0, np.int64)
    if len(fp) < 2:
        return none, none
    new = np.concatenate(([True], (block[1:] != block[:-1]) | (variant[1:] != variant[:-1])))
    crowd = ~(new & np.concatenate((new[1:], [True])))  # not alone in its bucket
    if not crowd.any():
        return none, none
    bucket, block, variant, fp = (np.cumsum(new) - 1)[crowd], block[crowd].astype(np.uint64), variant[crowd], fp[crowd]
    value = ((fp.view(np.uint64) >> (block * np.uint64(BLOCK))) & np.uint64(0xFFFF)).astype(np.int64)
    code = bucket << BLOCK | value
    order = np.argsort(code, kind="stable")
    code, fp, block, variant = code[order], fp[order], block[order], variant[order]
    same = np.flatnonzero(code[1:] == code[:-1])  # equal in the masked block, two bits apart at most outside: a chain
    first = np.concatenate(([True], code[1:] != code[:-1]))
    codes, head = code[first], fp[first]
    i, j = _near(codes, ONE)
    pairs = [(fp[same], fp[same + 1]), (head[i], head[j])]
    whole = (fp.view(np.uint64) & ~(np.uint64(0xFFFF) << (block * np.uint64(BLOCK)))).view(np.int64) == variant
    own, own_fp = code[whole], fp[whole]  # unchanged outside the masked block, so distinct inside it
    several = np.flatnonzero(np.diff(own >> BLOCK) == 0)
    if len(several):
        keep = np.unique(np.concatenate((several, several + 1)))
        i, j = _near(own[keep], THREE)
        pairs.append((own_fp[keep][i], own_fp[keep][j]))
    a, b = (np.concatenate(x) for x in zip(*pairs))
    true = np.bitwise_count((a ^ b).view(np.uint64)) <= RADIUS
    both = np.unique(np.stack((np.minimum(a, b)[true], np.maximum(a, b)[true])), axis=1)
    return both[0], both[1]


def edges(spread: DataFrame) -> DataFrame:
    """Links (a, b), a < b, between distinct fingerprints from their variants. Buckets stream through, one batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int8), np.empty(0, np.int64), np.empty(0, np.int64)]
        for batch in batches:
            rows = [np.concatenate((k, c.to_numpy())) for k, c in zip(kept, batch.columns)]
            if not len(rows[0]):
                continue
            last = np.flatnonzero((rows[0] != rows[0][-1]) | (rows[1] != rows[1][-1]))
            cut = last[-1] + 1 if len(last) else 0  # the last bucket may go on in the next batch
            kept = [r[cut:] for r in rows]
            a, b = links(*(r[:cut] for r in rows))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        a, b = links(*kept)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    sorted_ = spread.repartition("block", "variant").sortWithinPartitions("block", "variant")
    return sorted_.mapInArrow(run, "a long, b long")


def components(pairs: DataFrame, files: int | None = None) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of the edges (a, b).

    Large-star and small-star in turn until nothing changes. A node's smallest neighbour is found with partial
    aggregation and written, so that the join back to a crowded node can be split by adaptive execution."""
    now, before = saved(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges", files), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        files = 1 + state[0] // EDGES_IN_FILE
        if state == before:
            return now.selectExpr("a AS node", "b AS root").union(now.selectExpr("b AS node", "b AS root").distinct())
        before = state
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "stars", files)
        large = both.where("b > a").join(least, "a").selectExpr("b AS a", "m AS b").where("a <> b").distinct()
        mid = saved(large, "edges", files)
        least2 = saved(mid.groupBy("a").agg(F.min("b").alias("m")), "stars", files)
        joined = mid.join(least2, "a")
        small = joined.selectExpr("b AS a", "m AS b").union(least2.selectExpr("a", "m AS b")).where("a <> b").distinct()
        after = saved(small, "edges", files)
        for old in (now, least, mid, least2):
            discard(old)
        now = after


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fp, component): one row per row of docs; component is the smallest key reachable over links."""
    own = saved(fingerprints(docs, key, text, shingle), "fingerprints")
    files = 1 + own.count() // NODES_IN_FILE
    nodes = saved(own.groupBy("fp").agg(F.min("key").alias("least")), "nodes", files)
    roots = saved(components(edges(variants(nodes.select("fp"))), files), "roots", files)
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = placed.groupBy("root").agg(F.min("least").alias("component"))
    of_fp = saved(placed.join(best, "root").select("fp", "component"), "classes", files)
    return own.join(of_fp, "fp").select("key", "fp", "component")
