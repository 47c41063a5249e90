"""Which of many patterns stand in which of many texts, without trying all pairs.

Each pattern is anchored at its rarest run of characters, of Q characters or of the whole pattern if shorter. The anchors are also marked in a table of
2^SLOT_BITS bits, of one size whatever their number, which every task gets. A text is read once: of its runs only those whose bit is set go on, each with
the characters around it, meet the anchors in a join by the run and are searched there. So what is shuffled grows with the places that look like an
anchor, not with the text. Nothing else is broadcast by hand, and a run that many texts share meets no more patterns than are anchored there."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources.workspace import saved

Q = 6
SLOT_BITS = 24
#: Longer patterns are searched in the whole text, which a second join brings, and not in the characters around a run.
NEAR = 64


def _hashing():
    """The function (text, ascending lengths) to (q, slots of the runs of q characters) of each; made here, so that it travels to the tasks by value."""
    mix, bits = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - SLOT_BITS)

    def slots(text: str, lengths: list[int]):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        h = np.zeros(len(codes) + 1, np.uint64)
        for q in range(1, min(lengths[-1], len(codes)) + 1):
            h = (h[:-1] + codes[q - 1:]) * mix
            h ^= h >> np.uint64(29)
            if q in lengths:
                yield q, (h * mix) >> bits

    return slots


def _marks(spark: SparkSession, anchors: DataFrame):
    """The slots of the anchors as bits, low bits of a byte first; 2^SLOT_BITS of them at most come to the driver."""
    slots = _hashing()

    @F.pandas_udf("long")
    def slot_of(runs: pd.Series) -> pd.Series:
        return pd.Series([int(s[0]) for run in runs for _, s in slots(run, [len(run)])], dtype="int64")

    slot = F.col("_slot") + 1  # Spark counts buckets and positions of bits from 1
    bits = anchors.select("run").distinct().select(slot_of("run").alias("_slot")).groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits")).collect()
    table = np.zeros(2**SLOT_BITS // 8, np.uint8)
    for r in bits:
        part = np.frombuffer(r.bits, np.uint8)
        table[(r.b - 1) * len(part):r.b * len(part)] = part
    return spark.sparkContext.broadcast(table)


def _places(marks, lengths: list[int], longest: int):
    """Text to the runs whose bit is set, each with as many characters around it as a pattern can have there."""

    slots = _hashing()

    def of(text: str) -> list[tuple[str, str]]:
        out, table = set(), marks.value
        for q, s in slots(text, lengths):
            at = np.flatnonzero((table[s >> np.uint64(3)] >> (s & np.uint64(7)).astype(np.uint8)) & 1)
            out.update((text[i:i + q], text[max(i - longest + q, 0):i + longest]) for i in at.tolist())
        return list(out)

    @F.pandas_udf("array<struct<run:string,near:string>>")
    def places(texts: pd.Series) -> pd.Series:
        return pd.Series([of(t) for t in texts])

    return places


def _runs(text: Column, q: Column) -> Column:
    """Distinct runs of q characters of a text of at least as many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - q + 1), lambda i: F.substring(text, i, q)))


def contained(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """patterns: pattern; texts: tid, text. (pattern, tid) of every pattern that its text contains, once each; null and empty ones never do."""
    spark = patterns.sparkSession
    own = patterns.where("length(pattern) > 0").select("pattern").distinct().withColumn("q", F.least(F.length("pattern"), F.lit(Q)))
    runs = own.select("pattern", "q", F.explode(_runs(F.col("pattern"), F.col("q"))).alias("run"))
    common = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    anchors = saved(runs.join(common, "run").groupBy("pattern").agg(F.min(F.struct("n", "run")).alias("a")).select("pattern", F.col("a.run").alias("run")), "anchors")
    sizes = anchors.groupBy(F.length("run").alias("q")).agg(F.max(F.length("pattern")).alias("longest")).collect()  # Q rows at most
    if not sizes:
        return texts.select(F.lit("").alias("pattern"), "tid").limit(0)
    longest = max(r.longest for r in sizes)
    places = _places(_marks(spark, anchors), sorted(r.q for r in sizes), min(longest, NEAR))
    # the length is asked here, as a null text has none
    every = texts.where("length(text) > 0").select("tid", places("text").alias("_p")).select("tid", F.explode("_p").alias("_p")).select("tid", "_p.run", "_p.near")
    met = every.join(anchors, "run")
    found = met.where((F.length("pattern") <= NEAR) & F.col("near").contains(F.col("pattern"))).select("pattern", "tid")
    if longest > NEAR:
        long = met.where(F.length("pattern") > NEAR).select("pattern", "tid").distinct()
        found = found.union(long.join(texts, "tid").where(F.col("text").contains(F.col("pattern"))).select("pattern", "tid"))
    return found.distinct()
