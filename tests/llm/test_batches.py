"""Stages of the pipeline send rows to Python in batches that are bounded by bytes, not only by rows."""

from __future__ import annotations

import pyarrow as pa
import pytest

import corpus_pipeline

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
ROW = 8192


def largest_batch(docs):
    """Bytes of text in the largest batch that reaches Python, and all rows."""

    def run(batches):
        for batch in batches:
            yield pa.record_batch({"n": pa.array([batch.num_rows], pa.int64()), "size": pa.array([sum(len(x) for x in batch.column("text").to_pylist())], pa.int64())})

    rows = docs.select("doc_id", "text").mapInArrow(run, "n long, size long").collect()
    return max(r["size"] for r in rows), sum(r["n"] for r in rows)


@pytest.fixture
def no_bound(spark):
    before = spark.conf.get(SETTING, None)
    spark.conf.unset(SETTING)
    yield
    spark.conf.unset(SETTING)
    if before is not None:
        spark.conf.set(SETTING, before)


@pytest.fixture
def long_docs(spark):
    """24 MB of texts in one partition."""
    return spark.range(3072, numPartitions=1).selectExpr("id AS doc_id", f"repeat('abcdefg ', {ROW // 8}) AS text", "'en' AS lang", "'s' AS source", f"CAST({ROW} AS bigint) AS n_chars")


def test_batches_of_a_stage_are_bounded(spark, no_bound, long_docs):
    corpus_pipeline.personal_data(spark, long_docs, "")
    size, rows = largest_batch(long_docs)
    assert rows == 3072
    assert size <= (4 << 20) + ROW


def test_a_bound_of_the_session_stays(spark, no_bound, long_docs):
    spark.conf.set(SETTING, str(1 << 20))
    corpus_pipeline.personal_data(spark, long_docs, "")
    size, rows = largest_batch(long_docs)
    assert rows == 3072
    assert size <= (1 << 20) + ROW
