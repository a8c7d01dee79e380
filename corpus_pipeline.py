"""A training corpus from `documents`: quality, near-duplicates, benchmark leaks, personal data, token ids.

Each stage works on all rows that the one before it kept, as read again from a table in the shared folder.

Null text counts as empty and stays null; empty texts are near-duplicates of each other, so one of them stays if its score
keeps it. A row without doc_id is judged by its own text and is no near-duplicate of others. Rows of one doc_id are judged
each by its own text; equal rows are near-duplicates. Columns besides those of documents go at the first stage. Empty tables give none.

Each stage bounds the session's Arrow batches by bytes (shared.small_batches), unless the session has a bound of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import bagminhash, bpe, crf, pii, simhash
from millrace.llm.shared import small_batches, stored

#: The columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def batched(stage: Stage) -> Stage:
    """The stage, its rows sent to Python in small batches."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@batched
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF, fitted on the labelled ones outside the held-out third, scores 0.5 or more."""
    model = crf.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return crf.score(docs, model, keep=COLUMNS).where("score >= 0.5").drop("score")


@batched
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least doc_id; documents without doc_id stay."""
    return bagminhash.kept(docs).select(*COLUMNS)


@batched
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; each row is judged by its own text."""
    return simhash.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


@batched
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redacted(docs).select(*COLUMNS)


@batched
def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the bytes decoded from them."""
    return bpe.encode(docs, finish=bpe.digest_rows, schema=bpe.DIGESTS)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("token_ids", token_ids),
]

#: SQL can express none of these stages over whole tables; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
