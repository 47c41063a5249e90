"""Mixing by soft membership: document rates whose expected domain token totals meet target weights.

A classifier trained on a labelled table gives each document a posterior over domains. A document of t tokens and posterior
p, kept at rate r, is expected to add r * t * p[k] tokens to domain k. Target weights are shares of the output. The domain of the largest weight
is to be kept whole, which gives the output's size; a domain that has less than its share of it gives SCARCE of what it has, and
the others' shares grow in proportion, so a domain without documents gives its weight to the others.

Rates lie in [0, MOST_RATE] and start at 1. They are fitted by projected gradient on the squared gaps of the domain totals, relative to the targets.
Rates at a bound that the gradient pushes outward stay; to the others a step adds the same combination of their document's posterior and cuts them to the range.
The combination is the gaps divided by the domain curvature, the sums of t * p[k] * p[l] over these documents, so that a step would close the gaps if no
rate met a bound; a step that doesn't lessen the squared gaps enough is halved. A step needs from the documents only sums over domains and pairs of
domains: aggregations over (tokens, posterior), with rates replayed from the steps so far, a few numbers each. Where bounds leave a gap, the output is
made SMALLER, down to LEAST_OUTPUT, and the fit goes on. It ends when every domain is within TOLERANCE of its target, as a share of it. Gaps that remain are
returned, and `summary` has the totals, gaps and repeats as rows.

The classifier is multinomial logistic regression on hashed words (Spark's own), fitted on at most MOST_LABELLED
labelled documents, those of smallest id hash. All else, totals included, covers every document.

Defined cases: a null or empty text has no tokens and the posterior of no words; a label row without a document, with a
null, or repeated is left out or counted once; labels of one domain or none give that domain, or equal shares, to all; a
repeated id gives a row each time with one draw for all of them; rows with null ids are kept; an empty table gives an
empty result; columns with the names of added ones are replaced.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.shared import SPACE, hash_sample, saved

#: Bound of the labelled sample; columns of the hashed words.
MOST_LABELLED, BUCKETS = 20_000, 1 << 14
#: Relative gap of a domain; aggregations at most, three times what given tables take; rates at most, 1 for no repeats.
TOLERANCE, MOST_STEPS, MOST_RATE = 1e-2, 100, 1.0
#: Share of its tokens that a scarce domain gives; factor of the output's size where bounds leave a gap, and the least size it comes to.
SCARCE, SMALLER, LEAST_OUTPUT = 0.7, 0.95, 0.5
DOMAINS = ("clean", "low", "toxic")
#: Target weights as shares of the output's tokens.
TARGETS = {"clean": 0.97, "low": 0.02, "toxic": 0.01}


def labelled_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from quality and toxicity labels."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain")).where("doc_id IS NOT NULL AND domain IS NOT NULL").groupBy("doc_id").agg(F.max("domain").alias("domain"))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), "")


def counted(docs: DataFrame, text: str) -> DataFrame:
    """Adds _tokens and _features: which hashed words occur."""
    with_words = docs.withColumn("_words", words(F.col(text)))
    with_words = with_words.withColumn("_tokens", F.size("_words").cast("long"))
    return HashingTF(numFeatures=BUCKETS, inputCol="_words", outputCol="_features", binary=True).transform(with_words).drop("_words")


def posteriors(docs: DataFrame, labelled: DataFrame, text: str = "text", key: str = "doc_id", domains: tuple[str, ...] = DOMAINS) -> DataFrame:
    """docs with _tokens and _posterior, an array in the order of domains."""
    number = F.element_at(F.create_map(*[x for k, d in enumerate(domains) for x in (F.lit(d), F.lit(float(k)))]), F.col("domain"))
    sample = hash_sample(labelled.where(F.col("domain").isin(*domains)), "doc_id", MOST_LABELLED)
    sample = saved(sample.select(F.col("doc_id").alias("_key"), number.alias("_label")), "labelled")
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).dropna("any", subset=["_key"])
    chosen = saved(texts.join(F.broadcast(sample), "_key").dropDuplicates(["_key"]), "sample")
    seen = sorted(int(r._label) for r in chosen.select("_label").distinct().collect())
    df = counted(docs, text)
    if len(seen) < 2:
        even = [float(k == seen[0]) if seen else 1 / len(domains) for k in range(len(domains))]
        return df.drop("_features").withColumn("_posterior", F.array(*map(F.lit, even)))
    compact = F.element_at(F.create_map(*[x for i, k in enumerate(seen) for x in (F.lit(float(k)), F.lit(float(i)))]), F.col("_label"))
    model = LogisticRegression(featuresCol="_features", labelCol="_label", probabilityCol="_p", predictionCol="_best", rawPredictionCol="_raw",
                               maxIter=30, regParam=0.003, family="multinomial").fit(counted(chosen, "_text").withColumn("_label", compact))
    p = vector_to_array("_p")
    full = F.array(*[F.get(F.col("_p"), seen.index(k)) if k in seen else F.lit(0.0) for k in range(len(domains))])
    scored = model.transform(df).withColumn("_p", p)
    return scored.withColumn("_posterior", full).drop("_features", "_p", "_best", "_raw")


def held(r: np.ndarray, push: np.ndarray, most: float) -> np.ndarray:
    """Rates at a bound that are pushed outward."""
    return ((r <= 0) & (push < 0)) | ((r >= most) & (push > 0))


def replayed(posterior: np.ndarray, steps: list[tuple[list[float], list[float]]], most: float) -> np.ndarray:
    """Rates after the steps, each the gradient's combination of the posterior and that which is added."""
    r = np.ones(len(posterior))
    for way, step in steps:
        r = np.where(held(r, posterior @ np.array(way), most), r, np.clip(r + posterior @ np.array(step), 0.0, most))
    return r


@dataclass(frozen=True)
class Fit:
    """steps: two numbers a domain each; targets and totals in tokens."""

    steps: list[tuple[list[float], list[float]]]
    targets: list[float]
    totals: list[float]

    def gaps(self) -> list[float]:
        return [abs(a - b) / b if b else 0.0 for a, b in zip(self.totals, self.targets)]


def fit_rates(members: DataFrame, weights: list[float], most: float = MOST_RATE) -> Fit:
    """Steps of rates whose domain totals meet the weights. members: _tokens and _posterior."""
    n = len(weights)
    over = [(i, j) for i in range(n) for j in range(i + 1)]

    def sums(steps: list, way: list[float] | None) -> tuple[np.ndarray, np.ndarray]:
        """Domain totals, and the curvature over documents that `way` doesn't push against a bound."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(n + len(over))
            for batch in batches:
                if len(batch):
                    t, p = batch.column(0).to_numpy(zero_copy_only=False).astype(float), np.array(batch.column(1).flatten()).reshape(len(batch), n)
                    r = replayed(p, steps, most)
                    out[:n] += (r * t) @ p
                    if way is not None:
                        free = t * ~held(r, p @ np.array(way), most)
                        out[n:] += [(free * p[:, i]) @ p[:, j] for i, j in over]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], names=[f"s{k}" for k in range(len(out))])

        names = [f"s{k}" for k in range(n + len(over))]
        rows = members.select("_tokens", "_posterior").mapInArrow(run, ", ".join(f"{c} double" for c in names))
        got = np.array([x or 0.0 for x in rows.agg(*[F.sum(c).alias(c) for c in names]).first()])
        curve = np.zeros((n, n))
        for (i, j), x in zip(over, got[n:]):
            curve[i, j] = curve[j, i] = x
        return got[:n], curve

    have, _ = sums([], None)
    if not have.sum():
        return Fit([], [0.0] * n, [0.0] * n)
    share = np.array(weights, float) / sum(weights)
    main = int(np.argmax(np.where(have > 0, share, -1)))
    aim = np.minimum(share * have[main] / share[main], np.where(np.arange(n) == main, 1.0, SCARCE) * have)
    least = 1e-9 * have.sum()  # of a target in a quotient: domains that there aren't have no gap
    steps, totals, used, size = [], have, 1, 1.0

    def short(x: np.ndarray) -> list[float]:
        return [float(f"{v:.12g}") for v in x]

    def squared(x: np.ndarray) -> float:
        return float((((x - aim) / np.maximum(aim, least)) ** 2).sum())

    while np.max(np.abs(totals - aim) / np.maximum(aim, least)) > TOLERANCE and used < MOST_STEPS:
        way = short((aim - totals) / np.maximum(aim, least) ** 2)
        _, curve = sums(steps, way)
        used += 1
        whole, length, before = np.linalg.lstsq(curve + 1e-9 * np.trace(curve) * np.eye(n), aim - totals, rcond=None)[0], 1.0, squared(totals)
        while True:
            step = (way, short(length * whole))
            after, _ = sums([*steps, step], None)
            used += 1
            if squared(after) <= (1 - 0.1 * length) * before or length < 0.1 or used >= MOST_STEPS:
                break
            length /= 2
        gain = squared(after) / before
        if gain < 1:
            steps, totals = [*steps, step], after
        if gain > 0.8:  # bounds are in the way
            if size <= LEAST_OUTPUT:
                break
            aim, size = aim * SMALLER, size * SMALLER
    fit = Fit(steps, aim.tolist(), totals.tolist())
    if max(fit.gaps()) > TOLERANCE:
        logging.getLogger(__name__).warning("weights %s are not met: totals %s of %s after %d aggregations", weights, fit.totals, fit.targets, used)
    return fit


def with_rate(members: DataFrame, fit: Fit, most: float = MOST_RATE) -> DataFrame:
    """members with `rate`."""
    steps = fit.steps

    @F.pandas_udf("double")
    def rate(posterior: pd.Series) -> pd.Series:
        return pd.Series(replayed(np.stack(posterior.to_numpy()), steps, most) if len(posterior) else np.empty(0))

    return members.withColumn("rate", rate("_posterior"))


def summary(mixed_docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(domain, weight, share, tokens_before, tokens_after, repeated): what a mix came to; repeated counts documents taken twice or more."""
    sums = [F.sum(x).alias(n) for k in range(len(weights)) for n, x in (
        (f"b{k}", F.col("tokens") * F.get("posterior", k)), (f"a{k}", F.col("tokens") * F.col("rate") * F.get("posterior", k)))]
    one = mixed_docs.agg(F.sum(F.col("tokens") * F.col("rate")).alias("whole"), F.count_if(F.col("copies") > 1).alias("repeated"), *sums)
    rows = F.explode(F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(float(w)).alias("weight"), F.try_divide(F.col(f"a{k}"), F.col("whole")).alias("share"),
                                        F.col(f"b{k}").alias("tokens_before"), F.col(f"a{k}").alias("tokens_after"), F.col("repeated")) for k, (d, w) in enumerate(weights.items())]))
    return one.select(rows.alias("r")).select("r.*")


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] = TARGETS, key: str = "doc_id", text: str = "text", keep_text: bool = True,
          most_rate: float = MOST_RATE) -> DataFrame:
    """docs with tokens, posterior, rate and copies, the number of times a document is to be taken.

    copies is the rate rounded up or down by a draw from the id's hash, so that its expectation is the rate and a rerun
    gives the same. The rows are written once, so that the classifier reads every text once."""
    docs = docs.drop(*[c for c in ("tokens", "posterior", "rate", "copies") if c not in (key, text)])
    df = posteriors(docs, labelled, text, key)
    df = saved(df if keep_text else df.drop(text), "members")
    fit = fit_rates(df, [targets[d] for d in DOMAINS], most_rate)
    draw = (F.pmod(F.xxhash64(F.lit("mixing"), F.col(key)), F.lit(1 << 30)) + F.lit(0.5)) / F.lit(float(1 << 30))
    return with_rate(df, fit, most_rate).withColumn("copies", F.floor(F.col("rate") + draw).cast("int")).withColumnsRenamed(
        {"_tokens": "tokens", "_posterior": "posterior"})


def taken(docs: DataFrame, labelled: DataFrame, **more) -> DataFrame:
    """The mixed corpus: every row as often as its copies say, with the columns of docs; rows without a key once at least."""
    own = docs.select(F.struct("*").alias("_row"), F.col(more.get("key", "doc_id")).alias("doc_id"), F.col(more.get("text", "text")).alias("text"))
    df = mixed(own, labelled, more.get("targets", TARGETS))
    times = F.when(F.col("doc_id").isNull(), F.greatest("copies", F.lit(1))).otherwise(F.col("copies"))
    return df.withColumn("_n", F.explode(F.array_repeat(F.lit(1), times))).select("_row.*")

