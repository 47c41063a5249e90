"""Near copies by similarity: SimHash ball hashing on several short fingerprints, verified by the exact Jaccard index.

Two texts of similarity s, as the Jaccard index of their 5-word shingles, have fingerprints whose bits differ with a probability of about
p = acos(2s / (1 + s)) / pi, 0.15 at s = 0.8: some ten of 64 bits, too many for one ball. So a text has `tables` short fingerprints of
`bits` bits, from hashes of their own. In each of them every fingerprint emits itself and all its one-bit changes, half the
radius of 2; both sides of a pair within the radius emit the variant in the middle. A pair is met in one table with
P = P(Binomial(bits, p) <= 2), and in one of all with 1 - (1 - P) ** tables. `bits` follows the number of texts, so that a bucket
holds few strangers, and `tables` follows so that RECALL is reached at the least similarity; nearer copies are met more surely.

Variants are shuffled by bucket and sorted by text; each is paired with the first text of its bucket that differs in at most FAR bits of another
64-bit fingerprint, so a crowd of copies costs a row each, not pairs, and strangers are no pairs. Of the rest, each text is
verified with its nearest partner first, by exact Jaccard on whole texts; then the pairs between groups found so far are.

Defined cases: texts of equal fingerprints in all tables are one; null and empty texts are copies of each other; a repeated id is a row of its own text; rows without an
id group others but stay themselves, as they can't be ordered; an empty table stays empty; columns of docs are kept, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.jaccard_join import shingle_sets
from tickloom.llm.shared import WordHashes, mixed_runs, saved
from tickloom.llm.simhash import CHUNK, components

SHINGLE, SIMILARITY, RECALL, LEAST_BITS, FAR = 5, 0.8, 0.92, 24, 20
STEP = 0x9E3779B97F4A7C15


def layout(texts: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """Bits of a fingerprint and number of tables for so many texts."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(texts, 1))) + 6)
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    met = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(3))
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - met))


def fingerprints(docs: DataFrame, words_of_bits: int, shingle: int) -> DataFrame:
    """(key, addr, node, fps): 64-bit fingerprints over the whole text's shingles, each from its own hash; node stands for all of them."""
    seeds = [np.uint64((k * STEP | 1) & (2**64 - 1)) for k in range(1, words_of_bits + 1)]

    def whole(hashes: np.ndarray, n: int) -> np.ndarray:
        if not n:
            return np.zeros(words_of_bits, np.int64)
        runs = mixed_runs(hashes, min(n, shingle))
        out = np.zeros((words_of_bits, 64), np.int64)
        for a in range(0, len(runs), CHUNK):
            part = runs[a:a + CHUNK]
            for k, seed in enumerate(seeds):
                x = part * seed
                x = (x ^ (x >> np.uint64(31))) * np.uint64(STEP)
                out[k] += np.unpackbits((x ^ (x >> np.uint64(29))).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        return np.packbits(2 * out > len(runs), axis=1, bitorder="little").view("<i8").ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = WordHashes()
        for batch in batches:
            fps = []
            for t in batch.column(2):
                words = made.words(t.as_py())
                fps.append(whole(made.of(words), len(words)))
            nodes = np.array([xxhash.xxh64_intdigest(f.tobytes()) for f in fps], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(fps, pa.list_(pa.int64()))], names=["key", "addr", "node", "fps"])

    return docs.mapInArrow(run, "key long, addr long, node long, fps array<long>")


def variants(nodes: DataFrame, bits: int, tables: int) -> DataFrame:
    """(bucket, node, fp): each short fingerprint and its one-bit changes."""
    flips = np.array([0] + [1 << k for k in range(bits)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            fps = np.array(batch.column(1).flatten()).reshape(n, -1).astype(np.int64)
            spread = np.unpackbits(np.ascontiguousarray(fps[:, 1:]).view(np.uint8), axis=1, bitorder="little")[:, :bits * tables].reshape(n, tables, bits)
            short = (spread.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(2, dtype=np.uint64)
            bucket = (short[:, :, None] ^ flips) * np.uint64(tables) + np.arange(tables, dtype=np.uint64)[None, :, None]
            each = tables * len(flips)
            for a in range(0, n, 500):
                m = min(500, n - a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[a:a + m].ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy()[a:a + m], each)), pa.array(np.repeat(fps[a:a + m, 0], each))],
                    names=["bucket", "node", "fp"])

    return nodes.select("node", "fps").mapInArrow(run, "bucket long, node long, fp long")


def partners(spread: DataFrame, far: int) -> DataFrame:
    """(a, b, apart): each text of a bucket with the first text before it that it is near to and that is near to none before, and their distance.

    Such firsts are few: one for each group of near texts and each stranger in a bucket. A group is paired with its first, so it costs its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = None  # of the bucket at hand, in order
        for batch in batches:
            if not len(batch):
                continue
            bucket, node, fp = (c.to_numpy() for c in batch.columns)
            if heads is not None:
                bucket, node, fp = (np.concatenate((h, c)) for h, c in zip(heads, (bucket, node, fp)))
            last, found, rows = bucket[-1], [], np.arange(len(bucket))
            firsts = []
            while len(rows):
                new = np.concatenate(([True], bucket[rows][1:] != bucket[rows][:-1]))
                head = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
                apart = np.bitwise_count((fp[rows] ^ fp[head]).view(np.uint64)).astype(np.int64)
                near = ~new & (apart <= far)
                found.append(np.stack((node[head[near]], node[rows[near]], apart[near])))
                firsts.append(rows[new & (bucket[rows] == last)])
                rows = rows[~near & ~new]
            keep = np.concatenate(firsts)
            heads = bucket[keep], node[keep], fp[keep]
            a, b, apart = np.concatenate(found, axis=1)
            ok = a != b
            rows = np.unique(np.stack((np.minimum(a, b)[ok], np.maximum(a, b)[ok], apart[ok])), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=["a", "b", "apart"])

    rows = spread.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(run, "a long, b long, apart long")
    return rows.groupBy("a", "b").agg(F.min("apart").alias("apart"))


def similar(docs: DataFrame, address: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Pairs (a, b) whose shingle sets have the similarity, exactly."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in shingle_sets(batch.column(1), shingle)], pa.list_(pa.int64()))], names=["node", "tokens"])

    asked = address.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node")
    texts = docs.join(asked, "addr").select("node", "text").mapInArrow(tokens, "node long, tokens array<long>").dropDuplicates(["node"])
    sets = saved(texts, "shingles")
    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b").join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a")
    held = both.select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("n"), (F.size("ta") + F.size("tb")).alias("all"))
    return saved(held.where((F.col("all") > 0) & (F.col("n") >= similarity * (F.col("all") - F.col("n")) - 1e-9)).select("a", "b"), "similar")


def groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """docs: key, addr, text. (key, addr, node) of all rows, and (node, root) of texts that have a near copy."""
    bits, tables = layout(docs.count(), similarity, recall)
    own = saved(fingerprints(docs, 1 + math.ceil(bits * tables / 64), shingle), "prints")
    nodes = saved(own.groupBy("node").agg(F.min("addr").alias("addr"), F.first("fps").alias("fps")), "nodes")
    pairs = saved(partners(variants(nodes, bits, tables), FAR), "pairs")
    address = nodes.select("node", "addr")
    nearest, other = (pairs.groupBy(x).agg(F.min(F.struct("apart", "a", "b")).alias("p")).select("p.a", "p.b") for x in "ab")
    nearest = saved(nearest.union(other).distinct(), "nearest")
    found = similar(docs, address, nearest, shingle, similarity)
    roots = components(found)
    a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    open_ = pairs.join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b").join(nearest, ["a", "b"], "left_anti")
    more = similar(docs, address, saved(open_, "open"), shingle, similarity)
    if more.isEmpty():
        return own, roots
    return own, components(roots.selectExpr("node AS a", "root AS b").union(more))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest key, and of those the smallest text hash.

    Rows of one key and text are one row, whichever of them stays; rows without a key stay."""
    key_, text_ = F.col(key).cast("long"), F.col(text).cast("string")
    # names that no column of docs has, and its columns as one value
    rows = docs.select(F.struct("*").alias("row"), key_.alias("key"), F.xxhash64(key_, text_).alias("addr"))
    own, roots = groups(docs.select(key_.alias("key"), F.xxhash64(key_, text_).alias("addr"), text_.alias("text")), shingle, similarity)
    placed = own.where("key IS NOT NULL").select("key", "addr", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = placed.groupBy("root").agg(F.min(F.struct("key", "addr")).alias("best")).select("best.addr")
    kept = rows.where("key IS NOT NULL").join(best, "addr", "left_semi").dropDuplicates(["addr"])
    return kept.select("row.*").union(rows.where("key IS NULL").select("row.*"))
