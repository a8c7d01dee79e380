"""Running sums and byte-bounded segments."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offsets(df: DataFrame, keys: list[str], order: list[Column], size: Column, name: str = "offset") -> DataFrame:
    """The sum of the sizes before each row; a missing size counts as given by the caller's column."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(size).over(w), F.lit(0)))


def fit_segments(df: DataFrame, bucket: str, order: list[str], size: str, most: int) -> DataFrame:
    """Rows of each bucket dealt in order to segments of at most `most` bytes: a row that does not fit opens the next.

    A row beyond the bound by itself is an error. Where a segment ends depends on all rows before it, so a bucket passes
    through one task, as a stream: deal the rows to buckets by a hash of their identity, as many as the data need.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, segment, used = None, 0, 0
        for batch in batches:
            out = []
            for b, n in zip(batch.column(bucket).to_pylist(), batch.column(size).to_pylist(), strict=True):
                if n > most:
                    raise ValueError(f"a row of {n} bytes is larger than a segment of {most}")
                if (b,) != last:
                    last, segment, used = (b,), 0, 0
                if used + n > most:
                    segment, used = segment + 1, 0
                used += n
                out.append(segment)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names=[*names, "segment"])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", segment int"
    return df.repartition(bucket).sortWithinPartitions(bucket, *order).mapInArrow(run, schema)
