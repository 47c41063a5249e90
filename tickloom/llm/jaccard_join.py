"""Similarity join of shingle sets by Jaccard index, with index lists cut into blocks and answers derived from answers.

A document's set holds its distinct 4-word shingles as 64-bit hashes; equal sets are one set. Two sets x, y link if
100 * |x & y| >= PERCENT * |x | y|.

Index. Shingles have one order for the whole corpus, rare ones first; a set posts its first |x| - ceil(PERCENT |x| / 100) + 1
shingles with their positions, and linked sets share a posted one. Rareness is read from a table of SLOTS counts over all
documents (a shingle counts in the slot of its hash); any order is exact, this one keeps lists short.

Set relations. Sets of a list are answered from each other, so that a group of near copies costs links, not pairs:

1. The first set of a list by position has fewest shingles of its own before the shared one, so it stands for the list: it is
   paired with every other set that the length and position bounds leave, and those pairs are verified exactly. Sets linked to
   it need no answer among themselves, as they are reachable from each other.
2. Sets of a list that are in different components then are collected into blocks of equal (position, size, component). Bounds
   are tried on pairs of blocks, so whole blocks are skipped by position. Of the rest, a set's answers follow from those
   of the list's first set x: |y & z| <= min(|y & x|, |z & x|) + min(|y - x|, |z - x|). What that leaves is verified exactly.

Each link lies in the list of its first common shingle, where both bounds hold, so none is lost. Lists of shingles that are far
more frequent than the average are dealt over several tasks by the set's hash, and their first sets are paired once more.
Work beyond the links is that of pairs which are close to linked and in different components.

Defined cases: A-Z is lower-cased, words are parted by ASCII white space; fewer than four words are one shingle; without words, as null
and empty texts are, a document has no set and is its own component; a repeated id gives a row each time, by its own
text; rows without an id link like others and have the component of the smallest id there is, or null; an empty table gives an
empty result; only the id and the text are read, so other columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.shared import saved
from tickloom.llm.simhash import LOWER, components

SHINGLE, PERCENT = 4, 85
#: Counts in the table of rareness, and in a row of it; sets of a frequent shingle's list in one task.
SLOTS, IN_ROW, LIST = 1 << 20, 1 << 10, 2_000
#: Bytes of texts whose words are hashed at once (they stay in a core's cache); bytes of a word that is hashed on its own.
BYTES, LONG_WORD = 1 << 17, 64
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
IN_WORD = bytes(c != 32 and not 9 <= c <= 13 for c in range(256))
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def hashed_words(text: bytes, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words text[start:start + length], eight bytes at a time for all words at once; text has 16 bytes more at its end."""
    eights, out = np.frombuffer(text, "<u8", len(text) // 8), length.astype(np.uint64) * MIX[0]
    live = np.arange(len(start))
    for k in range(0, LONG_WORD, 8):
        at, left = start[live] + k, np.minimum(length[live] - k, 8)
        place, shift = at >> 3, ((at & 7) << 3).astype(np.uint64)
        eight = (eights[place] >> shift | eights[place + 1] << np.uint64(1) << (np.uint64(63) - shift)) & FIRST_BYTES[left]
        x = (out[live] ^ eight) * MIX[1]
        out[live] = x ^ (x >> np.uint64(32))
        live = live[length[live] > k + 8]
        if not len(live):
            break
    for i in live:  # longer ones
        out[i] = xxhash.xxh64_intdigest(text[start[i]:start[i] + length[i]], 1)
    out *= MIX[0]
    return out ^ (out >> np.uint64(29))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Each text's distinct shingles as ascending uint64, made for BYTES of texts at once."""
    texts, sets = texts.cast(pa.large_binary()).fill_null(b""), []
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(edges, edges[a] + BYTES, "right")) - 1)
        cut = edges[a:b + 1] - edges[a]
        n = int(cut[-1])
        text = (texts.buffers()[2][edges[a]:edges[b]].to_pybytes() if n else b"").translate(LOWER) + bytes(16)
        inner = np.frombuffer(text.translate(IN_WORD), bool, n)
        first, last, inside = inner.copy(), inner.copy(), cut[(cut > 0) & (cut < n)]
        first[1:] &= ~inner[:-1]
        last[:-1] &= ~inner[1:]
        first[inside], last[inside - 1] = inner[inside], inner[inside - 1]  # words end with their text
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        h = hashed_words(text, start, end - start)
        x = h[:max(len(h) - size + 1, 0)].copy()
        for k in range(1, size):
            x = (x ^ (x >> np.uint64(29))) * MIX[0] + h[k:len(x) + k]
        x = (x ^ (x >> np.uint64(32))) * MIX[1]
        x ^= x >> np.uint64(29)
        word = np.searchsorted(start, cut).tolist()
        for i, j in zip(word, word[1:]):
            if j - i >= size:
                tokens = x[i:j - size + 1]
                tokens.sort()
                sets.append(tokens[np.concatenate(([True], tokens[1:] != tokens[:-1]))])
            else:
                words = [text[p:q] for p, q in zip(start[i:j], end[i:j])]
                sets.append(np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)] if words else [], np.uint64))
        a = b
    return sets


def identity(tokens: np.ndarray) -> int:
    """Signed 64-bit hash of a set; 0 for the empty set."""
    return int(np.uint64(xxhash.xxh64_intdigest(tokens.tobytes(), len(tokens) & 0xFFFF)).astype(np.int64)) if len(tokens) else 0


def rareness(texts: DataFrame, size: int) -> np.ndarray:
    """64 * log2 of the count of each slot over all documents: a table of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            sets = shingle_sets(batch.column(0), size)
            if sets:
                total += np.bincount((np.concatenate(sets) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        if total.any():
            rows = total.reshape(-1, IN_ROW)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows), dtype=np.int32)), pa.array([r.astype("<i8").tobytes() for r in rows])], names=["part", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = None, None
        for batch in batches:
            for p, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if p != part and part is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()])], names=["part", "n"])
                    total = None
                part, total = p, np.frombuffer(n, "<i8") + (0 if total is None else total)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()])], names=["part", "n"])

    rows = texts.mapInArrow(count, "part int, n binary").repartition("part").sortWithinPartitions("part").mapInArrow(add, "part int, n binary").collect()
    out = np.zeros(SLOTS, np.int64)
    for r in rows:  # SLOTS / IN_ROW rows
        out[r.part * IN_ROW:(r.part + 1) * IN_ROW] = np.frombuffer(r.n, "<i8")
    return (64 * np.log2(out + 1.0)).astype(np.uint16)


def index(docs: DataFrame, levels, spread: float, size: int, percent: int) -> DataFrame:
    """(key, addr, sid, size, posted, parts): a row for each document; posted shingles in order, once for each set of a task.

    parts: over how many tasks the list of a posted shingle is dealt, by what its slot counts beyond twice the average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, level = set(), levels.value
        for batch in batches:
            sids, sizes, posted, parts = [], [], [], []
            for tokens in shingle_sets(batch.column(2), size):
                sid, n = identity(tokens), len(tokens)
                sids.append(sid)
                sizes.append(n)
                if not n or sid in seen:
                    posted.append(None)
                    parts.append(None)
                    continue
                seen.add(sid)
                own, most = level[(tokens & np.uint64(SLOTS - 1)).astype(np.int64)], n - (percent * n + 99) // 100 + 1
                first = np.lexsort((tokens, own))[:most]
                posted.append(tokens[first].view(np.int64))
                parts.append((1 + np.maximum(np.exp2(own[first] / 64) - spread, 0) // LIST).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(posted, pa.list_(pa.int64())),
                 pa.array(parts, pa.list_(pa.int32()))], names=["key", "addr", "sid", "size", "posted", "parts"])

    return docs.mapInArrow(run, "key long, addr long, sid long, size long, posted array<long>, parts array<int>")


def tokens_of(docs: DataFrame, asked: DataFrame, size: int) -> DataFrame:
    """(sid, tokens) of the sets asked for (addr, sid), read from the texts again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingle_sets(batch.column(1), size)
            ok = [identity(s) == sid for s, sid in zip(sets, batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["sid", "tokens"]).filter(pa.array(ok, pa.bool_()))

    return docs.join(asked, "addr").select("sid", "text").mapInArrow(run, "sid long, tokens array<long>").dropDuplicates(["sid"])


def needed(a: Column, b: Column, percent: int) -> Column:
    """The least intersection of linked sets of sizes a and b."""
    return F.ceil(percent * (a + b) / F.lit(100 + percent) - F.lit(1e-9))


def may_link(size: Column, pos: Column, size2: Column, pos2: Column, percent: int) -> Column:
    """Length and position bounds of two sets whose first common shingle has these positions."""
    most = 1 + F.least(size - pos - 1, size2 - pos2 - 1)
    return (100 * F.least(size, size2) >= percent * F.greatest(size, size2)) & (most >= needed(size, size2, percent))


def verified(docs: DataFrame, own: DataFrame, pairs: DataFrame, size: int, name: str) -> DataFrame:
    """(a, b, both): the exact intersection sizes of pairs of sets."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
    asked = own.where("posted IS NOT NULL").join(ids, "sid").groupBy("sid").agg(F.min("addr").alias("addr"))
    sets = saved(tokens_of(docs, asked, size), f"{name}-sets")
    left = pairs.join(sets.withColumnsRenamed({"sid": "b", "tokens": "tokens_b"}), "b")
    both = left.join(sets.withColumnsRenamed({"sid": "a", "tokens": "tokens_a"}), "a")
    return saved(both.select("a", "b", F.size(F.array_intersect("tokens_a", "tokens_b")).cast("long").alias("both")), name)


def stars(lists: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each list's first set with the others, and of the first sets of a list that is dealt over tasks."""
    near = lists.where(F.col("sid") != F.col("lead.sid")).where(may_link(F.col("size"), F.col("pos"), F.col("lead.size"), F.col("lead.pos"), percent))
    dealt = lists.where("parts > 1").select("token", "lead").distinct()
    first = F.min("lead").over(Window.partitionBy("token"))
    leads = dealt.withColumn("first", first).where("lead.sid <> first.sid").where(
        may_link(F.col("lead.size"), F.col("lead.pos"), F.col("first.size"), F.col("first.pos"), percent)).select(F.col("first.sid").alias("x"), F.col("lead.sid").alias("y"))
    return near.select(F.col("lead.sid").alias("x"), F.col("sid").alias("y")).union(leads).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def residue(lists: DataFrame, roots: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets of one list that are in different components, not decided by bounds, blocks or answers."""
    placed = lists.select("token", "pos", "size", "sid", F.col("lead.sid").alias("lead")).distinct().join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    placed = placed.withColumn("root", F.coalesce("root", "sid"))
    mixed = placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("token")
    answers = known.select(F.col("a").alias("lead"), F.col("b").alias("sid"), "both").union(known.select("b", "a", "both"))
    open_ = saved(placed.join(mixed, "token").join(answers, ["lead", "sid"], "left"), "open")
    open_ = open_.withColumn("both", F.when(F.col("sid") == F.col("lead"), F.col("size")).otherwise(F.col("both")))
    block = ["token", "pos", "size", "root"]
    blocks = open_.select(*block).distinct()
    twin = blocks.select("token", *[F.col(c).alias(f"{c}2") for c in block[1:]])
    order = F.struct("pos", "size", "root") < F.struct("pos2", "size2", "root2")
    left = blocks.join(twin, "token").where(order & (F.col("root") != F.col("root2")) & may_link(F.col("size"), F.col("pos"), F.col("size2"), F.col("pos2"), percent))
    sets = open_.select(*block, "sid", "lead", "both")
    second = sets.select("token", *[F.col(c).alias(f"{c}2") for c in (*block[1:], "sid", "lead", "both")])
    pairs = left.join(sets, block).join(second, ["token", "pos2", "size2", "root2"])
    most = F.least("both", "both2") + F.least(F.col("size") - F.col("both"), F.col("size2") - F.col("both2"))
    hopeless = (F.col("lead") == F.col("lead2")) & (most < needed(F.col("size"), F.col("size2"), percent))
    pairs = pairs.where(~F.coalesce(hopeless, F.lit(False))).select(F.least("sid", "sid2").alias("a"), F.greatest("sid", "sid2").alias("b")).distinct()
    return pairs.join(known.select("a", "b"), ["a", "b"], "left_anti")


def linked_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, addr, sid, size, ...) of all rows; links (a, b, both) that were verified; (node, root) of sets that have a link."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("key"), F.xxhash64(F.col(key).cast("long"), F.col(text).cast("string")).alias("addr"), F.col(text).cast("string").alias("text"))
    levels = rareness(docs.select("text"), size)
    spread = 2 * float(np.exp2(levels / 64.0).mean())
    own = saved(index(docs, spark.sparkContext.broadcast(levels), spread, size, percent), "sets")
    each = own.where("posted IS NOT NULL").select("sid", "size", F.posexplode(F.arrays_zip("posted", "parts")).alias("pos", "p"))
    posted = each.select(F.col("p.posted").alias("token"), F.col("p.parts").alias("parts"), F.pmod(F.xxhash64("sid"), F.col("p.parts")).alias("part"),
                         "size", F.col("pos").cast("long").alias("pos"), "sid")
    whole = Window.partitionBy("token", "part").orderBy("pos", "size", "sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lists = posted.withColumn("lead", F.first(F.struct("pos", "size", "sid")).over(whole)).withColumn("last", F.last("sid").over(whole))
    lists = saved(lists.where("last <> lead.sid OR parts > 1").drop("last"), "lists")
    first = verified(docs, own, saved(stars(lists, percent), "pairs"), size, "answers")
    size_of = own.where("posted IS NOT NULL").select("sid", "size").distinct()

    def links(answers: DataFrame) -> DataFrame:
        sized = answers.join(size_of.withColumnsRenamed({"sid": "a", "size": "na"}), "a").join(size_of.withColumnsRenamed({"sid": "b", "size": "nb"}), "b")
        return sized.where((100 + percent) * F.col("both") >= percent * (F.col("na") + F.col("nb"))).select("a", "b", "both")

    found = saved(links(first), "links")
    roots = components(found.select("a", "b"))
    more = verified(docs, own, saved(residue(lists, roots, first, percent), "pairs"), size, "answers")
    more = saved(links(more), "links")
    if more.isEmpty():
        return own, found, roots
    # components are joined by what was found between them
    joined = components(roots.selectExpr("node AS a", "root AS b").union(more.select("a", "b")))
    return own, found.union(more), joined


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component): one row per row of docs."""
    own, _, roots = linked_sets(docs, key, text, size, percent)
    sets = own.where("size > 0").groupBy("sid").agg(F.min("key").alias("least"))
    placed = sets.join(roots, sets.sid == roots.node, "left").select("sid", "least", F.coalesce("root", "sid").alias("root"))
    best = placed.groupBy("root").agg(F.min("least").alias("component"))
    of_set = saved(placed.join(best, "root").select("sid", "component"), "classes")
    found = own.select("key", "sid", "size").join(of_set, "sid", "left")
    return found.select("key", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component")).otherwise(F.col("key")).alias("component"))
