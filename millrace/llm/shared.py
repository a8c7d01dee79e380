"""Shared folders, Arrow batches and vectorised word hashing for the operators of this subpackage.

Texts are handled as the flat UTF-8 buffer of an Arrow string column, cut into slices of bounded size, so that a
task's memory follows the slice (or the longest single text) and not the partition.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer single text is a step of its own.
SLICE_BYTES = 1 << 20

#: Bytes of an Arrow batch on its way to Python, where the session sets none: Spark's own bound (64 MB, 10,000 rows) lets
#: a batch hold a whole partition of texts, twice in the worker and once or twice outside the heap of the executor.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

U64 = np.uint64
MULT = U64(0x9E3779B97F4A7C15)
PRIME = U64(0xD6E8FEB86659FD93)
PRIME_INV = U64(pow(0xD6E8FEB86659FD93, -1, 1 << 64))


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder below the checkpoint folder that all executors share.

    The folder is read from the session; only in local mode, where none is set, one is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """From now on this session sends rows to Python in batches of BATCH_BYTES; a bound that it has been given stays."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def stored(df: DataFrame, purpose: str, **options: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there, so lost executors cost no rerun."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Write df as a table bucketed by key and read it again: a later join or grouping on the key moves no rows of it."""
    name = f"millrace_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).format("parquet").option("compression", "zstd").saveAsTable(name)
    return df.sparkSession.table(name)


def text_bytes(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows, and bytes of their texts."""
    n, size = docs.agg(F.count("*"), F.sum(F.octet_length(text_of(column)))).first()
    return n, size or 0


def tasks_for(spark: SparkSession, size: int, each: int = 48 << 20) -> int:
    """How many tasks to deal `size` bytes to: no fewer than the session's, and more where these would get too large."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def text_of(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def utf8(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One contiguous array of 64-bit offsets, null as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1, from 0) of a large_string array."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row slices whose texts hold at most `most` bytes, or one row."""
    texts = utf8(batch.column(column))
    batch = batch.set_column(batch.schema.get_field_index(column), column, texts)
    _, offsets = flat(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def binary_slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """As slices, by the bytes of a binary column."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        yield batch.slice(at, to - at)
        at = to


_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PRIME ** i and PRIME ** -i modulo 2 ** 64, for i up to n."""
    if len(_powers.get("up", ())) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        for name, base in (("up", PRIME), ("down", PRIME_INV)):
            x = np.full(size, base, U64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
        if size > 4 * SLICE_BYTES:  # not kept for one very long text
            return _powers.pop("up"), _powers.pop("down")
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def salted(x: np.ndarray, salt: int) -> np.ndarray:
    return mix(x + U64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1)))


_BYTE = mix(np.arange(1, 257, dtype=U64) * MULT)


def span_hashes(units: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of units[start:end] for all spans at once, by a prefix sum of unit * PRIME ** position.

    units are bytes or code points. Equal spans have equal hashes; different spans of a corpus of n distinct spans
    collide with probability n ** 2 / 2 ** 65.
    """
    up, down = powers(len(units))
    values = _BYTE[units] if units.dtype == np.uint8 else mix((units.astype(U64) + U64(1)) * MULT)
    if seed:
        values = salted(values, seed)
    prefix = np.zeros(len(units) + 1, U64)
    np.cumsum(values * up[: len(units)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(U64) * MULT)


#: Word separators: space and \x09-\x0D.
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True


def words(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all words [^\\x20\\x09-\\x0D]+ and, for each text, where its words begin (n + 1).

    Another table of separating bytes gives other words.
    """
    inside = ~separator[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words of one text and the place of each run's first word, in order."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.zeros(n, U64)
    for j in range(size):
        total = total * PRIME + hashes[j : j + n]
    left = np.repeat(bounds[1:], np.diff(bounds))[:n] if len(bounds) > 1 else np.zeros(0, np.int64)
    at = np.flatnonzero(np.arange(n) + size <= left)
    return mix(total[at]), at
