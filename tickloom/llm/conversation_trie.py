"""Prefix trie of rebuilt conversations by composable fingerprints, without building their texts.

A rebuilt conversation is the head of its group's base conversation followed by its own later turns. The fingerprint of turns is an
element (hash, length) of a monoid: hash = sum of e_i * B^i modulo a prime, for two primes at once, where e_i comes from the
role and text of turn i; (a, m) * (b, n) = (a + B^m * b, m + n). Products over all prefixes of the original
conversations are running totals, computed once. The product over a range of own turns is a difference of two of them, so

    prefix of a rebuilt conversation = base head * own turns after the cut

is a formula over four numbers; a rebuilt turn is a row (conversation, depth, fingerprint, reference to the original turn), without text.

A node is a depth and a fingerprint. Equality isn't taken from the fingerprint: for each node, the turns that its
members refer to are looked up, and their role and text must agree, as must the members' parents; by induction over the depth the whole
prefixes agree then. Where two prefixes collide, all is computed again with other bases.

Sums over subtrees need no walk: a node is owned by its smallest member, and what a conversation owns is an end of its path. A sum
over the nodes below is a sum over members and the rest of their paths, so that running totals of each
conversation from its end, summed by node, give leaves and saved tokens at once. Totals run in groups of any size
(operators/running.py), node sums are combined before the shuffle, and the ids that end in a node are hashed as a stream of
sorted pieces, so neither a long conversation nor a prefix that many share meets in one task's memory.

Defined cases: null roles and texts are empty; null turns come first, and turns that tie follow by their content's hash; rows without a
conversation id take no part; the base of a negative id is that of SQL's %, the next multiple towards zero; repeated rows are turns of their own; an absent base gives no head, and a conversation with no turns
left is a member of the root alone; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import saved
from tickloom.operators.running import running

#: Two primes, and pairs of bases; the next pair is taken where fingerprints collide.
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = ((1_103_515_245, 1_442_695_041), (1_664_525_001, 1_013_904_223), (1_540_483_477, 1_597_334_677), (1_812_433_253, 1_566_083_941))
GROUP, CUTS, STEPS, IDS = 5, 9, 31, 1_000


def power(base: int, prime: int, exponent: Column) -> Column:
    """base ** exponent modulo prime, for exponents from 0 up to 2**STEPS - 1."""
    out = F.lit(1).cast("long")
    for j in range(STEPS):
        factor = F.when(F.shiftright(exponent, j).bitwiseAND(1) == 1, F.lit(pow(base, 1 << j, prime)).cast("long")).otherwise(F.lit(1).cast("long"))
        out = (out * factor) % prime
    return out


def turns_of(rows: DataFrame, bases: tuple[int, int]) -> DataFrame:
    """(conv, pos, h0, h1, bytes, same): original turns with the products of all prefixes; `same` stands for role and text."""
    empty = F.lit("")
    named = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"),
        F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    hashed = named.select("conv", "turn", F.xxhash64("role", "text").alias("e0"), F.xxhash64("text", "role", F.lit(7)).alias("e1"), F.octet_length("text").cast("long").alias("bytes"),
                          F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("same"))
    placed = saved(running(hashed, ["conv"], [F.asc_nulls_first("turn"), "e0", "e1"], {"pos": F.lit(1).cast("long")}), "turns")
    terms = {f"h{k}": (F.pmod(F.col(f"e{k}"), F.lit(p - 1)) + 1) * power(b, p, F.col("pos")) % p for k, (b, p) in enumerate(zip(bases, PRIMES))}
    summed = running(placed, ["conv"], ["pos"], terms)
    return saved(summed.select("conv", "pos", *[(F.col(f"h{k}") % p).alias(f"h{k}") for k, p in enumerate(PRIMES)], "bytes", "same"), "products")


def fingerprint(h0: Column, h1: Column) -> Column:
    return h0 * F.lit(1 << 31) + h1


def paths(turns: DataFrame, bases: tuple[int, int], group: int = GROUP, cuts: int = CUTS) -> DataFrame:
    """(conv, depth, fp, up, ends, ref_conv, ref_pos, bytes): every prefix of every rebuilt conversation, the empty one included."""
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    convs = convs.withColumns({"base": F.col("conv") - F.col("conv") % group, "cut": F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")) % cuts})
    convs = convs.join(convs.select(F.col("conv").alias("base"), F.col("own").alias("n_base")), "base", "left")
    convs = convs.withColumn("head", F.least("cut", F.coalesce("n_base", F.lit(0))))
    at = turns.where(F.col("pos") < cuts).select("conv", "pos", "h0", "h1", "bytes")
    at_base = at.select(F.col("conv").alias("base"), F.col("pos").alias("head"), F.col("h0").alias("b0"), F.col("h1").alias("b1"))
    at_cut = at.select("conv", F.col("pos").alias("cut"), F.col("h0").alias("c0"), F.col("h1").alias("c1"))
    convs = convs.join(at_base, ["base", "head"], "left").join(at_cut, ["conv", "cut"], "left").na.fill(0, ["b0", "b1", "c0", "c1"])
    convs = saved(convs.withColumn("ends", F.col("head") + F.greatest(F.col("own") - F.col("cut"), F.lit(0))), "conversations")
    root = convs.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("fp"), "ends", F.lit(None).cast("long").alias("ref_conv"),
                        F.lit(None).cast("long").alias("ref_pos"), F.lit(0).cast("long").alias("bytes"))
    heads = convs.select("conv", "base", "head", "ends").join(at.withColumnRenamed("conv", "base"), "base").where("pos <= head").select(
        "conv", F.col("pos").alias("depth"), fingerprint(F.col("h0"), F.col("h1")).alias("fp"), "ends", F.col("base").alias("ref_conv"), F.col("pos").alias("ref_pos"), "bytes")

    def composed(k: int) -> Column:
        """The base head's hash with that of own turns from the cut on, moved from behind the cut to behind the head."""
        back = F.element_at(F.array(*[F.lit(pow(bases[k], -j, PRIMES[k])).cast("long") for j in range(cuts)]), (F.col("cut") - F.col("head") + 1).cast("int"))
        return (F.col(f"b{k}") + F.pmod(F.col(f"h{k}") - F.col(f"c{k}"), F.lit(PRIMES[k])) * back) % PRIMES[k]

    tails = turns.join(convs.select("conv", "cut", "head", "ends", "b0", "b1", "c0", "c1"), "conv").where("pos > cut").select(
        "conv", (F.col("pos") - F.col("cut") + F.col("head")).alias("depth"), fingerprint(composed(0), composed(1)).alias("fp"), "ends", F.col("conv").alias("ref_conv"), F.col("pos").alias("ref_pos"), "bytes")
    return root.union(heads).union(tails)


def collide(rows: DataFrame, turns: DataFrame, nodes: DataFrame) -> bool:
    """Whether a node's members refer to turns of other role or text, or have several parents."""
    if not nodes.where("up <> up2").isEmpty():
        return True
    refs = rows.where("depth > 0").select("depth", "fp", "ref_conv", "ref_pos").distinct().join(
        turns.select(F.col("conv").alias("ref_conv"), F.col("pos").alias("ref_pos"), "same"), ["ref_conv", "ref_pos"])
    return not refs.groupBy("depth", "fp").agg(F.min("same").alias("low"), F.max("same").alias("high")).where("low <> high").isEmpty()


def ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, fp, ends_sha256): SHA-256 of ascending comma-joined ids of each node, streamed through sorted pieces."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = []
            for d, f, c in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if out and (out[-1][0], out[-1][1]) == (d, f) and len(out[-1][3]) < IDS:
                    out[-1][3].append(str(c))
                else:
                    out.append([d, f, c, [str(c)]])
            if out:
                d, f, c, ids = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(f, pa.int64()), pa.array(c, pa.int64()), pa.array([",".join(x) for x in ids])],
                                                 names=["depth", "fp", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done = []
            for d, f, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                if (d, f) == node:
                    state.update(b",")
                else:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (d, f), hashlib.sha256()
                state.update(ids.as_buffer())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=["depth", "fp", "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([state.hexdigest()])], names=["depth", "fp", "ends_sha256"])

    key = ["depth", "fp", "conv"]
    cut = saved(ends.select(*key).repartitionByRange(*key).sortWithinPartitions(*key).mapInArrow(pieces, "depth long, fp long, first long, ids string"), "ends")
    ordered = cut.repartition("depth", "fp").sortWithinPartitions("depth", "fp", "first")
    return ordered.mapInArrow(digest, "depth long, fp long, ends_sha256 string")


def prefix_trie(rows: DataFrame, group: int = GROUP, cuts: int = CUTS) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    for bases in BASES:
        turns = turns_of(rows, bases)
        every = paths(turns, bases, group, cuts)
        every = saved(every, "paths")
        above = every.select("conv", (F.col("depth") + 1).alias("depth"), F.col("fp").alias("up"))
        every = saved(every.join(above, ["conv", "depth"], "left"), "paths")
        nodes = saved(every.groupBy("depth", "fp").agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), F.min("up").alias("up"), F.max("up").alias("up2")), "nodes")
        if not collide(every, turns, nodes):
            break
    else:
        raise ValueError("prefixes collide under every pair of bases")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("fp")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = saved(nodes.join(children, ["depth", "fp"], "left").na.fill(0, ["n_children"]), "nodes")
    owned = F.col("conv") == F.col("conv_id")
    marked = every.join(nodes.select("depth", "fp", "conv_id", "n_children"), ["depth", "fp"]).select(
        "conv", "depth", "fp", F.when(owned, 0).otherwise(F.col("bytes")).cast("long").alias("spared"), (owned & (F.col("n_children") == 0)).cast("long").alias("leaf"))
    below = running(marked, ["conv"], [F.desc("depth")], {"saved_tokens": F.col("spared"), "n_leaves": F.col("leaf")})
    sums = below.groupBy("depth", "fp").agg(F.sum("saved_tokens").alias("saved_tokens"), F.sum("n_leaves").alias("n_leaves"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, ["depth", "fp"]).join(ends_digest(every.where("depth = ends")), ["depth", "fp"], "left").join(parents, ["depth", "up"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
