"""From raw documents to token ids: quality rules, near-duplicates, personal data, mixing, SentencePiece.

Defined cases, for every stage: null and empty texts fail the quality rules and go there; later stages keep them as they
are described by their operators; repeated rows stay repeated until near-duplicates leave one; rows without an id stay in each
stage that can't address them; an empty table passes through; extra columns pass through, whatever their names, because a
stage works on the row as one struct beside the id and the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import mixing, near_copies, pii, quality_ledger, sentencepiece_codec
from tickloom.llm.shared import saved, table

POLICY = "v1"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy rejects go."""
    rows = docs.select(F.struct("*").alias("_row"), "text")
    return quality_ledger.apply_policy(quality_ledger.ledger(rows), POLICY).where("kept").select("_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest id: five-word shingles, similarity 0.8."""
    return near_copies.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans found in the texts are masked by their kind."""
    return pii.mask_pii(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the fitted rates say; labels are those of the documents that are left."""
    return mixing.taken(docs, mixing.labelled_domains(table(spark, sf_dir, "labels")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    both = sentencepiece_codec.round_trip(docs.select("doc_id", "source", "lang", "text"), sentencepiece_codec.model_bytes())
    return both.select("doc_id", "source", "lang", F.size("ids").alias("n_tokens"), "ids", F.col("same").alias("decodes"))


STAGES = [("quality rules", quality), ("SimHash near-dedup", near_duplicates), ("personal data", personal_data),
          ("mixing to target weights", mix), ("SentencePiece", tokens)]

#: A trained model and tokenizer ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
