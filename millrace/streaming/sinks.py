"""A sink for foreachBatch that gives each batch's rows once, whatever is repeated or broken off.

A batch's new rows are written to a folder of their own; then a row in the ledger, written last, makes them count. Readers see only
rows of batches in the ledger. A batch that comes again is compared with the ledger by a digest of its rows: the same rows are
nothing, other rows are an error. A batch that broke off before its ledger row is written again over what it left.

A row whose key is known with the same content is nothing; with other content the batch is refused as a whole. Null keys: as
one key. Rows repeated within a batch: one row.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import column
from millrace.operators.ledger import inserted
from millrace.sources.snapshots import content_id


class ConflictError(ValueError):
    """A key came with other content than before."""


class LedgerSink:
    """insert-if-absent by `key`, all other columns being the content; call it as foreachBatch's function."""

    def __init__(self, folder: str, key: str, schema: str):
        self.folder, self.key, self.schema = folder.rstrip("/"), key, schema

    def ledger(self, spark: SparkSession) -> DataFrame:
        """(batch, digest, rows), a row for each batch that counts."""
        try:
            return spark.read.schema("digest string, rows long, batch long").parquet(f"{self.folder}/ledger")
        except AnalysisException:  # nothing written yet
            return spark.createDataFrame([], "digest string, rows long, batch long")

    def read(self, spark: SparkSession) -> DataFrame:
        """The rows that count."""
        rows = spark.read.schema(f"{self.schema}, batch long")
        try:
            found = rows.parquet(f"{self.folder}/rows")
        except AnalysisException:
            return spark.createDataFrame([], self.schema)
        return found.join(self.ledger(spark).select("batch"), "batch", "left_semi").drop("batch")

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        digest = content_id(batch)
        past = self.ledger(spark).where(F.col("batch") == number).first()
        if past:
            if past.digest != digest:
                raise ConflictError(f"batch {number} came again with other rows")
            return
        content = F.sha2(F.to_json(F.struct(*sorted(c for c in batch.columns if c != self.key)), {"ignoreNullFields": "false"}), 256)
        told = lambda df: df.withColumns({"__key": column(self.key), "__content": content})
        new, conflicts = inserted(told(self.read(spark)), told(batch), "__key", "__content")
        first = conflicts.first()
        if first:
            raise ConflictError(f"batch {number}: other content for key {first[0]}")
        new = new.select(batch.columns)
        new.write.mode("overwrite").parquet(f"{self.folder}/rows/batch={number}")
        self.commit(spark, number, digest, spark.read.schema(batch.schema).parquet(f"{self.folder}/rows/batch={number}").count())

    def commit(self, spark: SparkSession, number: int, digest: str, rows: int) -> None:
        spark.createDataFrame([(digest, rows)], "digest string, rows long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={number}")
