"""The corpus pipeline: toxicity, near-dedup, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes to
the shared folder and rereads as the next stage's documents. Stages work on all their
predecessor kept; all but the last return the columns of ``documents``.

Scratch tables that a stage's frame reads are deleted once the next stage begins, since its
rows have been written by then; those of the last go when the driver's JVM ends.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import common, decontamination, near_copies, packing, secrets, toxicity


def _stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that owns its scratch tables and lets go of those of stages before it."""

    @wraps(work)
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        common.release(spark, docs, work.__name__)
        with common.scope(spark, work.__name__) as returned:
            return returned(work(spark, docs, sf_dir))

    return stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores 0.7 or more go."""
    return toxicity.reject(docs, common.table(spark, sf_dir, "labels").select("doc_id", "toxic"))


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard of 5-word shingles 0.8 or more, as
    SimHash and min-hash propose and whole sets decide) stays: that of the smallest id."""
    return near_copies.deduplicate(docs)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of two benchmark items or more go; from the others, the
    words of a passage are cut."""
    return decontamination.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


@_stage
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text becomes a mark; no document goes."""
    return secrets.redact(docs)


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All texts that are left, in sequences of at most 2048 ids."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scan", redact_secrets),
    ("packing", pack_sequences),
]

#: Learnt scores, fingerprints and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; rows of the last. What a stage wrote goes once the
    next has been written."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with common.scope(spark) as returned:
            docs, path = common.materialize(stage(spark, docs, sf_dir), name)
            returned(docs)
        if before:
            common.drop(spark, before)
        before = path
    with common.scope(spark) as returned:
        return returned(STAGES[-1][1](spark, docs, sf_dir))
