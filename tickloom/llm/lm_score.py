"""Stupid-backoff scores of documents, computed by joins of n-gram counts.

The model is of order 3 over all words of the corpus. All counts leave out the document's own occurrences, so that a document doesn't
vouch for itself. With c such counts and N such words,

    S(w | u v) = c(uvw) / c(uv) if c(uvw) > 0, else ALPHA * S(w | v);  S(w | v) likewise;
    S(w) = c(w) / N if c(w) > 0, else ALPHA / N,

and a document's first words have as much context as there is.

Count table. Texts become blocks of about WORDS words: the hashes of the block's distinct words, and their numbers in order. A block's
distinct n-grams of all orders are counted first, then dealt by hash into parts, as sorted differences of hashes with their counts.
A part sums the counts of its n-grams over all blocks, and its table is joined back to the n-grams of each block, whose documents add up their
logarithms. A part holds about ENTRIES n-grams, so there are as many parts as the corpus needs; a frequent n-gram is one
entry a block, wherever it stands, so none is hot. Nothing of the table is collected or broadcast. N-grams are told apart by their part and
40 more bits of a hash: about 3 lookups in ten million meet another n-gram's count, at any size of the corpus.

Defined cases: texts are split at ASCII white space and A-Z is lower-cased; null and empty texts have no words and a null
score; every row is a document of its own, also where ids repeat or are null; an empty table gives an empty result; other columns are
ignored. A text is never split between blocks, so memory grows with the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import WordHashes, fresh_path, mixed_runs, saved

ORDER, ALPHA = 3, 0.4
#: Words of a block, n-grams of a part, and bits of a hash beside the part's.
WORDS, ENTRIES, BITS = 1 << 19, 1 << 20, 40


def blocks(docs: DataFrame, words: int) -> DataFrame:
    """(block, keys, lengths, known, low, high, n): known has the hashes of the block's words, low and high their numbers in order."""

    def row(block: int, keys: list, texts: list[np.ndarray]) -> pa.RecordBatch:
        hashes = np.concatenate(texts) if texts else np.empty(0, np.uint64)
        known, at, n = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        number = place[at]
        return pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([[len(t) for t in texts]], pa.list_(pa.int32())), pa.array([known[order].tobytes()]),
             pa.array([(number & 0xFFFF).astype("<u2").tobytes()]), pa.array([(number >> 16).astype("<u2").tobytes()]), pa.array([len(hashes)], pa.int64())],
            names=["block", "keys", "lengths", "known", "low", "high", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, keys, texts, held, block = WordHashes(), [], [], 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys.append(k)
                texts.append(made.of(made.words(t.as_py())))
                held += len(texts[-1])
                if held >= words or len(keys) >= words:
                    yield row(block, keys, texts)
                    keys, texts, held, block = [], [], 0, block + 1
        if keys:
            yield row(block, keys, texts)

    return docs.mapInArrow(run, "block long, keys array<long>, lengths array<int>, known binary, low binary, high binary, n long")


def codes(block: dict, order: int, bits: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each n up to order: hashes of the block's n-grams, and where in the block they start; and the document of each word."""
    number = np.frombuffer(block["high"], "<u2").astype(np.uint32) << 16 | np.frombuffer(block["low"], "<u2")
    hashes = np.frombuffer(block["known"], np.uint64)[number]
    doc = np.repeat(np.arange(len(block["lengths"])), block["lengths"])
    out, starts = [], []
    for n in range(1, order + 1):
        at = np.flatnonzero(doc[n - 1:] == doc[:len(doc) - n + 1])
        out.append(mixed_runs(hashes, n)[at] >> np.uint64(64 - bits))
        starts.append(at)
    return out, starts, doc


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers as byte planes, so that the high bytes, mostly zero, cost nothing once compressed."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _gaps(values: np.ndarray) -> bytes:
    """Ascending numbers as differences of four bytes; the few that need more have their place and high half in front."""
    d = np.diff(values, prepend=np.uint64(0))
    high = np.flatnonzero(d >> np.uint64(32))
    return b"".join(x.astype("<u4").tobytes() for x in (np.array([len(high)]), high, d[high] >> np.uint64(32), d & np.uint64(0xFFFFFFFF)))


def _sums(data: bytes) -> np.ndarray:
    words = np.frombuffer(data, "<u4")
    n = int(words[0])
    d = words[1 + 2 * n:].astype(np.uint64)
    d[words[1:1 + n]] |= words[1 + n:1 + 2 * n].astype(np.uint64) << np.uint64(32)
    return np.cumsum(d, dtype=np.uint64)


def entries(table: DataFrame, order: int, part_bits: int) -> DataFrame:
    """(part, block, grams, n): the distinct n-grams of each block in each part, with the block's counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                grams, n = np.unique(np.concatenate(codes(block, order, part_bits + BITS)[0]), return_counts=True)
                part = (grams >> np.uint64(BITS)).astype(np.int64)
                cut = np.flatnonzero(np.diff(part, prepend=-1))
                ends = np.append(cut[1:], len(grams))
                low = grams & np.uint64((1 << BITS) - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[cut], pa.int64()), pa.array(np.full(len(cut), block["block"]), pa.int64()), pa.array([_gaps(low[a:b]) for a, b in zip(cut, ends)], pa.binary()),
                     pa.array([_pack(n[a:b]) for a, b in zip(cut, ends)], pa.binary())], names=["part", "block", "grams", "n"])

    return table.select("block", "lengths", "known", "low", "high").mapInArrow(run, "part long, block long, grams binary, n binary")


def joined(rows: DataFrame) -> DataFrame:
    """(part, block, n): for the n-grams of each block their counts over all blocks."""

    def run(group: pa.Table) -> pa.Table:
        grams = [_sums(g.as_py()) for g in group.column("grams")]
        own = np.concatenate([_unpack(n.as_py()) for n in group.column("n")])
        distinct, at = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.zeros(len(distinct), np.uint64)
        np.add.at(total, at, own)
        cut = np.cumsum([len(g) for g in grams])[:-1]
        return pa.table({"part": group.column("part"), "block": group.column("block"), "n": pa.array([_pack(x) for x in np.split(total[at], cut)], pa.binary())})

    return rows.groupBy("part").applyInArrow(run, "part long, block long, n binary")


def summed(table: DataFrame, found: DataFrame, order: int, part_bits: int, whole: int, alpha: float) -> DataFrame:
    """(key, n_words, log_score, seen) of every document."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        block = left.to_pylist()[0]
        each, starts, doc = codes(block, order, part_bits + BITS)
        grams, at = np.unique(np.concatenate(each), return_inverse=True)
        parts = sorted(zip(right.column("part").to_pylist(), right.column("n")), key=lambda p: p[0])
        total = np.concatenate([_unpack(n.as_py()) for _, n in parts]).astype(np.int64) if parts else np.empty(0, np.int64)
        lengths = np.array(block["lengths"], np.int64)
        _, pair, n = np.unique(doc[np.concatenate(starts)] * max(len(grams), 1) + at, return_inverse=True, return_counts=True)
        others = total[at] - n[pair]
        size, words = np.cumsum([len(x) for x in each]), len(doc)
        count = np.zeros((order, words), np.int64)  # of the n-gram that ends at a word
        for k, (e, s) in enumerate(zip(np.split(others, size[:-1]), starts)):
            count[k, s + k] = e
        rest = np.maximum(whole - lengths[doc], 1)
        back, log_alpha = np.zeros(words), np.log(alpha)
        score, done = np.zeros(words), np.zeros(words, bool)
        first = np.arange(words) - np.repeat(np.cumsum(lengths) - lengths, lengths)  # place in the document
        for k in range(order - 1, 0, -1):
            has = first >= k
            seen = has & ~done & (count[k] > 0)
            score[seen] = back[seen] + np.log(count[k][seen]) - np.log(np.roll(count[k - 1], 1)[seen])
            done |= seen
            back[has & ~done] += log_alpha
            if k == order - 1:
                full = seen.copy()
        alone = ~done
        score[alone] = back[alone] + np.where(count[0][alone] > 0, np.log(np.maximum(count[0][alone], 1)), log_alpha) - np.log(rest[alone])
        full = full if order > 1 else count[0] > 0
        sums, seen = (np.bincount(doc, x, len(lengths)).astype(float) for x in (score, full))
        return pa.table({"key": pa.array(block["keys"], pa.int64()), "n_words": pa.array(lengths), "log_score": pa.array(sums, pa.float64(), mask=lengths == 0, from_pandas=False), "seen": pa.array(seen.astype(np.int64))})

    return table.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, "key long, n_words long, log_score double, seen long")


def scored(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, alpha: float = ALPHA, words: int = WORDS, entries_in_part: int = ENTRIES) -> DataFrame:
    """(key, n_words, log_score, seen): the sum of log scores over all words, and how many words follow their whole context elsewhere."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    made, path = blocks(docs, words), fresh_path(spark, "blocks")
    made.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(made.schema).parquet(path)
    whole = table.agg(F.sum("n")).first()[0] or 0
    part_bits = max(4, (order * whole // entries_in_part).bit_length())
    found = saved(joined(entries(table, order, part_bits)), "counts")
    return summed(table.drop("n"), found, order, part_bits, whole, alpha)
