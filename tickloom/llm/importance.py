"""Importance resampling towards a target corpus on hashed n-gram features.

A feature is a run of 1 to n words; its bucket is the CRC-32 of its UTF-8 bytes modulo BUCKETS. Bucket totals of the raw and of the
target corpus give each bucket a gain, floor(1000 * ln of the ratio of its smoothed shares), and a document weighs the floored mean of
the gains of its features. With a Gumbel number from the id's hash added, the highest scores are a draw without replacement
in proportion to exp(weight / 1000).

Head and tail. Words that make up at least 1/HEAD of all words of both corpora are at most HEAD by arithmetic. Their exact counts are
taken over all texts, and their CRC states are broadcast: a state is the bucket of the word alone, and goes on as that of a longer
run. Pairs of such words that make up 1/HEAD of all words are at most HEAD too; their buckets are broadcast (a frequent pair has frequent words,
so none is missed). Every other feature takes its CRC from its bytes, or from the state of its first words. Both ways give the
same bucket, so totals are exact whatever the head holds.

Each text is split once: its buckets are written as two bytes each, from which the totals and then the weights are read. The draw
is a global order by score, cut into ranges (operators/running.py).

Defined cases: A-Z is lower-cased and words are runs of ASCII letters, digits and all non-ASCII characters; null, empty and wordless texts
have no features and weight 0; a repeated id gives a row each time, with one Gumbel number; rows without an id get that of
an empty id, and lose ties; an empty table gives an empty result, and an empty target has zero totals; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import saved
from tickloom.operators.running import numbered

BUCKETS, RUN, HEAD, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 20_000, 2024, 20, 10
#: Lower-cases A-Z and makes spaces of all ASCII but letters and digits.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def counted(texts: DataFrame, keys) -> DataFrame:
    """(item, n): how often each item that keys(words) yields occurs in all texts, combined per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n: Counter = Counter()
            for t in batch.column(0):
                n.update(keys(split(t.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["item", "n"])

    return texts.mapInArrow(run, "item binary, n long").groupBy("item").agg(F.sum("n").alias("n"))


def head_vocabulary(texts: DataFrame, buckets: int = BUCKETS, run: int = RUN, head: int = HEAD) -> tuple[dict[bytes, int], dict[bytes, int]]:
    """CRC states of frequent words, and buckets of frequent pairs, at most `head` of each."""
    words = saved(counted(texts, lambda ws: ws), "words")
    least = max((words.agg(F.sum("n")).first()[0] or 0) / head, 1)
    states = {bytes(r.item): zlib.crc32(r.item) for r in words.where(F.col("n") >= least).select("item").collect()}
    if run < 2:
        return states, {}
    known = texts.sparkSession.sparkContext.broadcast(set(states))
    pairs = counted(texts, lambda ws: (u + b" " + v for u, v in pairwise(ws) if u in known.value and v in known.value))
    return states, {bytes(r.item): zlib.crc32(r.item) % buckets for r in pairs.where(F.col("n") >= least).select("item").collect()}


class Features:
    """Buckets of all runs of a text's words."""

    def __init__(self, states: dict[bytes, int], pairs: dict[bytes, int], buckets: int, run: int):
        self.states, self.pairs, self.buckets, self.run = states, pairs, buckets, run

    def of(self, words: list[bytes]) -> np.ndarray:
        get, crc, n = self.states.get, zlib.crc32, len(words)
        state = [s if (s := get(w)) is not None else crc(w) for w in words]
        out = [np.array(state, np.int64) % self.buckets]
        for k in range(1, min(self.run, n)):
            longer = []
            made = []
            for i in range(n - k):
                pair = self.pairs.get(words[i] + b" " + words[i + 1]) if k == 1 and self.pairs else None
                following = crc(words[i + k], crc(b" ", state[i])) if pair is None or self.run > 2 else None
                longer.append(following)
                made.append(pair if pair is not None else following % self.buckets)
            out.append(np.array(made, np.int64))
            state = longer
        return np.concatenate(out)


def bucketed(docs: DataFrame, features, kind: str) -> DataFrame:
    """(key, n_words, n_features, buckets): a row for each document, its buckets as little-endian numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Features(*features.value)
        for batch in batches:
            n_words, n_features, each = [], [], []
            for t in batch.column(1):  # one text's words at a time
                words = split(t.as_py())
                found = made.of(words)
                n_words.append(len(words))
                n_features.append(len(found))
                each.append(found.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(each, pa.binary())],
                                             names=["key", "n_words", "n_features", "buckets"])

    return docs.mapInArrow(run, "key long, n_words long, n_features long, buckets binary")


def totals(rows: DataFrame, buckets: int, kind: str) -> np.ndarray:
    """Features in each bucket: a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for b in batch.column(0):
                total += np.bincount(np.frombuffer(b.as_buffer(), kind), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # `buckets` rows at most
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    buckets, s_all, t_all = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weighed(rows: DataFrame, gain, kind: str) -> DataFrame:
    """(key, n_words, n_features, weight)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(gain.value[np.frombuffer(b.as_buffer(), kind)].sum()) for b in batch.column(3)]
            weight = [s // n if n else 0 for s, n in zip(sums, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], names=["key", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "key long, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", run: int = RUN, buckets: int = BUCKETS,
              head: int = HEAD, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(key, n_words, n_features, weight, score, rank): every document; rank counts the drawn ones from the highest score and is null for others."""
    context, kind = docs.sparkSession.sparkContext, "<u2" if buckets <= 1 << 16 else "<u4"
    raw = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    aim = target.select(F.lit(None).cast("long").alias("key"), F.col(target_text).cast("string").alias("text"))
    features = context.broadcast((*head_vocabulary(raw.select("text").union(aim.select("text")), buckets, run, head), buckets, run))
    rows = saved(bucketed(raw, features, kind), "buckets")
    gain = context.broadcast(gains(totals(rows, buckets, kind), totals(bucketed(aim, features, kind), buckets, kind)))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    gumbel = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = saved(weighed(rows, gain, kind).withColumn("score", F.col("weight") + gumbel), "scores")
    may = F.col("n_words") >= least_words
    drawn = percent * scored.where(may).count() // 100
    ranked = numbered(scored.where(may), [], [F.desc("score"), F.asc_nulls_last("key")], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.union(scored.where(~may).withColumn("rank", F.lit(None).cast("long")))
