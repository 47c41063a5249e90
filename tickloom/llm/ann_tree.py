"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

Largest inner product is turned into smallest distance by one more coordinate, sqrt(M^2 - |v|^2) with M the largest norm of
all vectors, and 0 for queries. The tree is fitted on at most SAMPLE vectors, those of smallest id hash; every vector is
then put into a leaf. A query descends with a priority queue of branches by distance to their centres and visits the
nearest leaves; how many is calibrated: visits are doubled until the recall of CALIBRATION queries, against the exact
neighbours among all vectors, reaches the target, in the end with all leaves, which is exact.

Leaves are cut into blocks of about BLOCK rows by the id's hash, so that a leaf of copies is spread over tasks, and a
block meets its queries in batches of bounded size. Candidates are scored again on the original vectors in double precision, by
the same sum for equal vectors, so that ties go to the smaller id.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id; shorter vectors
are filled up with zeros; very small and very large ones are scaled for the tree, and scores beyond the range of doubles are infinite or not a number, which come last; repeated ids are rows of their own, but none of a query's own id is its candidate; fewer candidates
than asked for are all returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import hash_sample, saved

#: Bound of the sample the tree is fitted on; branches of a node; sampled vectors a leaf has; rows of a block; queries beside it.
SAMPLE, BRANCHES, LEAF, BLOCK, QUERIES = 20_000, 8, 150, 2_000, 2_000
#: Queries to calibrate with, the recall they must reach, and the seed of the tree.
CALIBRATION, TARGET, SEED = 128, 0.96, 11


def sound(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): the rows that take part, in double precision and of one length, shorter ones filled up with zeros."""
    v = F.col(vector).cast("array<double>")
    own = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    own = own.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    width = own.agg(F.max(F.size("v"))).first()[0] or 0
    return own.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))))


def scaled(rows: np.ndarray, largest: float) -> np.ndarray:
    """Rows in units of the largest component of all vectors, so that no square overflows; for the tree only, never for scores."""
    return np.ldexp(rows, -int(np.frexp(largest)[1]))


def pointed(rows: np.ndarray, norm: float) -> np.ndarray:
    """Queries of one norm, as only their direction tells which vectors are nearest; however small or large they are."""
    unit = rows / np.abs(rows).max(1, keepdims=True)
    return unit * (norm / np.sqrt((unit**2).sum(1, keepdims=True)))


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(12):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        centres = np.stack([x[near == j].mean(0) if (near == j).any() else centres[j] for j in range(k)])
    return centres, np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)


def build_tree(x: np.ndarray) -> dict:
    """Nodes as (centres, children); a child is a node's number, or -1 - leaf."""
    rng, nodes, leaves = np.random.default_rng(SEED), [], 0

    def grow(part: np.ndarray) -> int:
        nonlocal leaves
        if len(part) <= LEAF or (part == part[0]).all():
            leaves += 1
            return -leaves
        centres, near = kmeans(part, BRANCHES, rng)
        used = [j for j in range(BRANCHES) if (near == j).any()]
        if len(used) < 2:
            leaves += 1
            return -leaves
        me = len(nodes)
        nodes.append(None)
        nodes[me] = (centres[used], [grow(part[near == j]) for j in used])
        return me

    root = grow(x) if len(x) else -1
    return {"nodes": nodes, "root": root, "leaves": max(leaves, 1)}


def leaf_of(tree: dict, x: np.ndarray) -> np.ndarray:
    """The leaf of each row: the nearest centre at each node."""
    out, todo = np.zeros(len(x), np.int32), [(tree["root"], np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if node < 0:
            out[rows] = -1 - node
            continue
        centres, children = tree["nodes"][node]
        near = np.argmin((centres**2).sum(1) - 2 * x[rows] @ centres.T, axis=1)
        todo += [(c, rows[near == j]) for j, c in enumerate(children) if (near == j).any()]
    return out


def best_bins(tree: dict, q: np.ndarray, most: int) -> list[int]:
    """The first leaves off a priority queue of branches, nearest centre first."""
    queue, found = [(0.0, 0, tree["root"])], []
    n = 0
    while queue and len(found) < most:
        _, _, node = heapq.heappop(queue)
        if node < 0:
            found.append(-1 - node)
            continue
        centres, children = tree["nodes"][node]
        for d, c in zip((((centres - q) ** 2).sum(1)).tolist(), children):
            n += 1
            heapq.heappush(queue, (d, n, c))
    return found


def raised(rows: np.ndarray, most2: float) -> np.ndarray:
    return np.column_stack((rows, np.sqrt(np.maximum(0.0, most2 - (rows**2).sum(1)))))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, row position, score): the k best of rows for each query, scored exactly, ties to smaller ids."""
    with np.errstate(over="ignore", invalid="ignore"):
        rough = queries @ rows.T
    slack = 1e-9 * np.abs(queries).max(1) * np.abs(rows).max() * rows.shape[1] if rough.size else np.zeros(len(queries))
    out = []
    for i in range(len(queries)):
        r, able = rough[i], np.flatnonzero(ids != query_ids[i])
        if len(able) > k and np.isfinite(r).all() and np.isfinite(slack[i]):  # sums beyond the range of numbers are all scored
            able = able[r[able] >= np.partition(r[able], -k)[-k] - slack[i]]
        with np.errstate(over="ignore", invalid="ignore"):
            exact = (queries[i] * rows[able]).sum(1)
        first = np.lexsort((ids[able], -exact))[:k]
        out.append((np.full(len(first), i), able[first], exact[first]))
    return tuple(np.concatenate(x) if out else np.empty(0, np.int64) for x in (zip(*out) if out else ((), (), ())))


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; partial results are cut before the window by Spark's own group limit."""
    rank = F.expr("row_number() OVER (PARTITION BY query_id, query_row ORDER BY isnan(score), score DESC, id)")
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding", target: float = TARGET) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest found for every row for which is_query holds of its id."""
    spark = vectors.sparkSession
    own = saved(sound(vectors, key, vector), "vectors")
    largest = own.agg(F.max(F.array_max(F.transform("v", F.abs)))).first()[0]
    if largest is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")


    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float((scaled(_matrix(b.column(0)), largest) ** 2).sum(1).max()) if len(b) else 0.0])], names=["norm2"])

    most2 = own.select("v").mapInArrow(norms, "norm2 double").agg(F.max("norm2")).first()[0]
    sample = hash_sample(own, "id", SAMPLE).select("v").toPandas()
    tree = build_tree(raised(scaled(np.stack(sample["v"].to_numpy()).astype(float), largest), most2))
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf = leaf_of(shared.value, raised(scaled(_matrix(b.column(1)), largest), most2)) if len(b) else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf)], names=["id", "v", "leaf"])

    placed = saved(own.select("id", "v").mapInArrow(place, "id long, v array<double>, leaf int"), "leaves")
    blocks = {r.leaf: 1 + r["count"] // BLOCK for r in placed.groupBy("leaf").count().collect()}  # one number a leaf, bounded by the sample
    index = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.get(F.from_json(F.lit(str([blocks.get(i, 1) for i in range(tree["leaves"])])), "array<int>"), F.col("leaf"))).cast("int"))
    queries = saved(own.where(is_query(F.col("id"))).select("id", "v").withColumn("row", F.monotonically_increasing_id()), "queries")
    trial = hash_sample(queries, "id", CALIBRATION).toPandas()
    if not len(trial):
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    visits = _calibrated(placed, trial, tree, most2**0.5, k, target)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q = _matrix(b.column(1))
            bins = [best_bins(shared.value, x, visits) for x in np.column_stack((pointed(q, most2**0.5), np.zeros(len(q))))] if len(b) else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bins, pa.list_(pa.int32()))], names=["id", "v", "row", "bins"])

    # a visit stands for all blocks of a leaf; its queries are dealt into batches, and a block is repeated for each batch
    routed = saved(queries.mapInArrow(route, "id long, v array<double>, row long, bins array<int>").select("id", "v", "row", F.explode("bins").alias("leaf")), "visits")
    batches = {r.leaf: 1 + r["count"] // QUERIES for r in routed.groupBy("leaf").count().collect()}

    def times(numbers: dict[int, int]):
        return F.get(F.from_json(F.lit(str([numbers.get(i, 0) for i in range(tree["leaves"])])), "array<int>"), F.col("leaf"))

    def upto(n):
        return F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))

    left = index.withColumn("batch", upto(times(batches)))
    right = routed.withColumn("batch", F.pmod(F.xxhash64("row"), times(batches)).cast("int")).withColumn("block", upto(times({i: blocks.get(i, 0) for i in range(tree["leaves"])})))

    def meet(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "query_row": [], "id": [], "score": []})
        q, v = np.stack(asked["v"].to_numpy()), np.stack(rows["v"].to_numpy())
        i, j, s = nearest(q, asked["id"].to_numpy(), v, rows["id"].to_numpy(), k)
        return pd.DataFrame({"query_id": asked["id"].to_numpy()[i], "query_row": asked["row"].to_numpy()[i], "id": rows["id"].to_numpy()[j], "score": s})

    keys = ["leaf", "block", "batch"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(meet, "query_id long, query_row long, id long, score double")
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


def _calibrated(placed: DataFrame, trial: pd.DataFrame, tree: dict, norm: float, k: int, target: float) -> int:
    """Leaf visits whose recall over the trial queries reaches the target: the exact neighbours of a bounded set of queries are
    found over all vectors, each with its leaf, and visits are doubled, then narrowed, until enough of them are met."""
    q, qid = np.stack(trial["v"].to_numpy()), trial["id"].to_numpy()
    sent = placed.sparkSession.sparkContext.broadcast((q, qid))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, own = sent.value
        for b in batches:
            if len(b):
                ids = b.column(0).to_numpy()
                i, j, s = nearest(asked, own, _matrix(b.column(1)), ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(own[i]), pa.array(ids[j]), pa.array(s), pa.array(b.column(2).to_numpy()[j])],
                                                 names=["query_row", "query_id", "id", "score", "leaf"])

    found = placed.mapInArrow(exact, "query_row long, query_id long, id long, score double, leaf int")
    truth = _ranked(found, k).select("query_row", "leaf").toPandas()  # at most CALIBRATION * k rows
    order = [best_bins(tree, np.append(x, 0.0), tree["leaves"]) for x in pointed(q, norm)]
    turn = [{leaf: n for n, leaf in enumerate(o)} for o in order]
    needed = np.sort([turn[r][leaf] + 1 for r, leaf in zip(truth["query_row"], truth["leaf"])])
    visits = 1
    while visits < tree["leaves"] and len(needed) and np.searchsorted(needed, visits, side="right") < target * len(needed):
        visits = min(visits * 2, tree["leaves"])
    low = visits // 2
    while low + 1 < visits:  # the last doubling may have been too much
        mid = (low + visits) // 2
        low, visits = (low, mid) if np.searchsorted(needed, mid, side="right") >= target * len(needed) else (mid, visits)
    return visits
