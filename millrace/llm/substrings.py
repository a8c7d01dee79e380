"""Operator 9: substring deduplication with a log-structured fingerprint index.

Every run of WINDOW words (a window) that already began in a document of smaller doc_id is a repetition, and all words
that it covers are removed. Windows are judged on the input.

Documents are dealt into blocks of rising doc_id and kept in a table bucketed by block. The index holds one fingerprint
a window, that of its least run of SEED words, which equal windows share and neighbouring windows mostly share too, so
that it is a sixth of the windows. It consists of sorted immutable runs: a new batch of blocks writes its fingerprints
as a run and is merge-joined with the runs before it, bucket by bucket of the fingerprint; fingerprints of two documents
are candidates. Runs are compacted into one when there are more than FAN_OUT. Candidates are verified on all windows
under them, by 128 bits of hash a window; a block then learns which of its windows began in a block before it, and finds
those that began in an earlier document of its own.

A passage shared by any number of documents is one entry a block at each step, so no step gathers all its documents.

Null or empty text: no words. Fewer words than a window: nothing is removed. Ties: rows of one doc_id are parts of one
document, which is read in one task like any other, and do not repeat each other. Null doc_id: neither repeats nor is repeated. Repeated rows: each gives its row. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import U64, bucketed, flat, salted, shingles, slices, span_hashes, stored, tasks_for, text_bytes, words

WINDOW = 13
SEED = 5
BLOCK_BYTES = 16 << 20
#: Batches that op9 deals the documents into, and runs that are left side by side before they are compacted.
BATCHES = 4
FAN_OUT = 2
#: Fingerprints that one bucket of the index is meant to hold.
BUCKET_ROWS = 2 << 20


def to_bytes(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, low bytes apart from high ones; the table's compression does the rest."""
    return np.diff(values, prepend=values[:1] * 0).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=U64)


def windows(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of all windows of the slice: two hashes, fingerprint, row and first word; and the rows' word bounds."""
    data, offsets = flat(part.column("text"))
    starts, ends, bounds = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    w1, at = shingles(hashes, bounds, WINDOW)
    w2, _ = shingles(salted(hashes, 7), bounds, WINDOW)
    seeds, places = shingles(hashes, bounds, SEED)
    full = np.full(len(hashes) + WINDOW, ~U64(0))
    full[places] = seeds
    print_ = full[at]
    for j in range(1, WINDOW - SEED + 1):
        print_ = np.minimum(print_, full[at + j])
    row = np.searchsorted(bounds, at, "right") - 1
    known = np.flatnonzero(part.column("doc_id").is_valid().to_numpy(zero_copy_only=False)[row]) if part.column("doc_id").null_count else slice(None)
    return w1[known], w2[known], print_[known], row[known], at[known], bounds


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    return ((values >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def deal(docs: DataFrame) -> tuple[DataFrame, int]:
    """A table (block, doc_id, text) bucketed by block, and in how many buckets; blocks are ranges of doc_id, in order.

    Rows without doc_id take no part and are spread.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spark, size = docs.sparkSession, text_bytes(docs)[1]
    docs = docs.withColumn("place", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    ranged = docs.repartitionByRange(tasks_for(spark, size, BLOCK_BYTES), "doc_id", "place").select("doc_id", "text", F.spark_partition_id().alias("block"))
    n = tasks_for(spark, size)
    return bucketed(ranged, "block", n), n


def dealt(df: DataFrame, n: int, key: str) -> GroupedData:
    """df by key, in n tasks where the session's number is less."""
    return (df.repartition(n, key) if n > tasks_for(df.sparkSession, 0) else df).groupBy(key)


def run_of(blocks: DataFrame, buckets: int) -> DataFrame:
    """The fingerprints of these blocks as a new immutable run: (bucket, prints, blocks, several) sorted by print.

    several marks prints of two or more documents of a block.
    """

    def emit(block: int, prints: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((docs, prints))
        prints, docs = prints[order], docs[order]
        new = np.ones(len(prints), bool)
        new[1:] = prints[1:] != prints[:-1]
        first = np.flatnonzero(new)
        several = np.maximum.reduceat(docs, first) > docs[first] if len(first) else np.zeros(0, bool)
        prints = prints[first]
        edges = np.searchsorted(bucket_of(prints, buckets), np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(edges)).tolist()
        cut = [(int(edges[b]), int(edges[b + 1])) for b in full]
        return pa.record_batch({
            "bucket": pa.array(full, pa.int32()), "prints": pa.array([to_bytes(prints[x:y]) for x, y in cut], pa.binary()),
            "blocks": pa.array([np.full(y - x, block, "<i4").tobytes() for x, y in cut], pa.binary()), "several": pa.array([np.packbits(several[x:y]).tobytes() for x, y in cut], pa.binary()),
        })

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, seen = None, [], 0
        for batch in batches:
            own = batch.column("block").to_numpy()
            for a, b in zip(*_runs(own), strict=True):
                if own[a] != block and held:
                    yield emit(block, *map(np.concatenate, zip(*held, strict=True)))
                    held = []
                block = int(own[a])
                for part in slices(batch.slice(a, b - a), "text"):
                    _, _, prints, row, _, _ = windows(part)
                    change = np.ones(len(prints), bool)
                    change[1:] = (prints[1:] != prints[:-1]) | (row[1:] != row[:-1])
                    held.append((prints[change], row[change] + seen))
                    seen += len(part)
        if held:
            yield emit(block, *map(np.concatenate, zip(*held, strict=True)))

    return stored(blocks.mapInArrow(scan, "bucket int, prints binary, blocks binary, several binary"), "run", compression="zstd")


def _runs(values: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of stretches of equal values."""
    if not len(values):
        return [], []
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return [0, *cut.tolist()], [*cut.tolist(), len(values)]


def _merged(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries of a bucket by print, then block."""
    prints = [from_bytes(x) for x in rows.column("prints").to_pylist()]
    blocks = [np.frombuffer(x, "<i4") for x in rows.column("blocks").to_pylist()]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(rows.column("several").to_pylist(), prints, strict=True)]
    prints, blocks, several = np.concatenate(prints), np.concatenate(blocks), np.concatenate(several).astype(bool)
    order = np.lexsort((blocks, prints))
    return prints[order], blocks[order], several[order]


def candidates(runs: list[DataFrame], n: int) -> DataFrame:
    """(block, prints): prints of each block that belong to two documents of these runs. The last run is the new batch.

    What lies in earlier runs only was found when they were new.
    """
    rows = None
    for i, run in enumerate(runs):
        run = run.withColumn("new", F.lit(i == len(runs) - 1))
        rows = run if rows is None else rows.unionByName(run)

    def join(table: pa.Table) -> pa.Table:
        prints, blocks, several = _merged(table)
        new = np.unique(np.concatenate([from_bytes(x) for x, n in zip(table.column("prints").to_pylist(), table.column("new").to_pylist(), strict=True) if n] or [np.zeros(0, U64)]))
        same = np.zeros(len(prints), bool)
        same[1:] = prints[1:] == prints[:-1]
        twice = same | several
        twice[:-1] |= same[1:]
        if len(new):
            at = np.minimum(np.searchsorted(new, prints), len(new) - 1)
            twice &= new[at] == prints
        else:
            twice[:] = False
        prints, blocks = prints[twice], blocks[twice]
        order = np.lexsort((prints, blocks))
        prints, blocks = prints[order], blocks[order]
        cut = list(zip(*_runs(blocks), strict=True))
        return pa.table({"block": pa.array([int(blocks[a]) for a, _ in cut], pa.int32()), "values": pa.array([to_bytes(np.unique(prints[a:b])) for a, b in cut], pa.binary())})

    return dealt(rows, n, "bucket").applyInArrow(join, "block int, values binary")


def compact(runs: list[DataFrame], n: int) -> DataFrame:
    """One run of all entries of these runs."""
    rows = runs[0]
    for run in runs[1:]:
        rows = rows.unionByName(run)

    def merge(table: pa.Table) -> pa.Table:
        prints, blocks, several = _merged(table)
        return pa.table({"bucket": table.column("bucket").slice(0, 1), "prints": pa.array([to_bytes(prints)], pa.binary()), "blocks": pa.array([blocks.astype("<i4").tobytes()], pa.binary()), "several": pa.array([np.packbits(several).tobytes()], pa.binary())})

    return stored(dealt(rows, n, "bucket").applyInArrow(merge, "bucket int, prints binary, blocks binary, several binary"), "compacted", compression="zstd")


def _lists(table: pa.Table) -> np.ndarray:
    """All values of a block's lists, sorted."""
    lists = [from_bytes(x) for x in table.column("values").to_pylist()]
    return np.unique(np.concatenate(lists)) if lists else np.zeros(0, U64)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _parts(table: pa.Table) -> Iterator[pa.RecordBatch]:
    for batch in table.to_batches():
        yield from slices(batch, "text")


def verify(blocks: DataFrame, found: DataFrame, buckets: int, n: int) -> DataFrame:
    """(block, values): first hashes of a block's windows that also begin in an earlier block, equal in both hashes."""

    def under(texts: pa.Table, lists: pa.Table) -> pa.Table:
        """The windows of one block under its candidate prints, each once."""
        known, w1s, w2s = _lists(lists), [np.zeros(0, U64)], [np.zeros(0, U64)]
        for part in _parts(texts) if len(known) else ():
            w1, w2, prints, _, _, _ = windows(part)
            hit = _among(prints, known)
            w1s.append(w1[hit])
            w2s.append(w2[hit])
        w1, first = np.unique(np.concatenate(w1s), return_index=True)
        w2 = np.concatenate(w2s)[first]
        edges = np.searchsorted(bucket_of(w1, buckets), np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(edges)).tolist()
        block = texts.column("block")[0].as_py() if len(texts) else 0
        return pa.table({
            "bucket": pa.array(full, pa.int32()), "block": pa.array([block] * len(full), pa.int32()),
            "w1": pa.array([to_bytes(w1[edges[b] : edges[b + 1]]) for b in full], pa.binary()), "w2": pa.array([w2[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()),
        })

    def later(table: pa.Table) -> pa.Table:
        """Of one bucket: windows that are in a block before this one."""
        w1 = [from_bytes(x) for x in table.column("w1").to_pylist()]
        own = np.repeat(table.column("block").to_numpy(), [len(x) for x in w1])
        w1, w2 = np.concatenate(w1), np.concatenate([np.frombuffer(x, U64) for x in table.column("w2").to_pylist()])
        order = np.lexsort((own, w2, w1))
        w1, w2, own = w1[order], w2[order], own[order]
        again = np.zeros(len(w1), bool)
        again[1:] = (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])
        w1, own = w1[again], own[again]
        order = np.lexsort((w1, own))
        w1, own = w1[order], own[order]
        cut = list(zip(*_runs(own), strict=True))
        return pa.table({"block": pa.array([int(own[a]) for a, _ in cut], pa.int32()), "values": pa.array([to_bytes(w1[a:b]) for a, b in cut], pa.binary())})

    asked = blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(under, "bucket int, block int, w1 binary, w2 binary")
    return dealt(asked, n, "bucket").applyInArrow(later, "block int, values binary")


def removed(blocks: DataFrame, repeated: DataFrame, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text."""

    def cut(table: pa.Table, lists: pa.Table) -> pa.Table:
        known = _lists(lists)
        parts = list(_parts(table))
        w1s, ids, places, counts, before = [], [], [], [], 0
        for part in parts:
            w1, _, _, row, at, bounds = windows(part)
            w1s.append(w1)
            ids.append(part.column("doc_id").fill_null(0).to_numpy()[row])
            places.append(at + before)
            counts.append(np.diff(bounds))
            before += int(bounds[-1])
        w1, ids, places = np.concatenate(w1s or [np.zeros(0, U64)]), np.concatenate(ids or [np.zeros(0, np.int64)]), np.concatenate(places or [np.zeros(0, np.int64)])
        codes, unique = pd.factorize(w1)
        first = np.full(len(unique), np.iinfo(np.int64).max)
        np.minimum.at(first, codes, ids)
        begun = (ids > first[codes]) | _among(unique, known)[codes] if len(w1) else np.zeros(0, bool)
        steps = np.zeros(before + WINDOW + 1, np.int64)
        np.add.at(steps, places[begun], 1)
        np.add.at(steps, places[begun] + WINDOW, -1)
        gone = np.cumsum(steps)[:before] > 0
        out: dict[str, list] = {"doc_id": [], "n_words": [], "n_removed": [], "kept_sha256": []} | ({"text": []} if texts else {})
        at = 0
        for part, n in zip(parts, counts, strict=True):
            data, offsets = flat(part.column("text"))
            raw, edges = data.tobytes(), offsets.tolist()
            out["doc_id"] += part.column("doc_id").to_pylist()
            for i, k in enumerate(n.tolist()):
                own, lost = raw[edges[i] : edges[i + 1]].split(), gone[at : at + k]
                at += k
                if lost.any():
                    own = [own[j] for j in np.flatnonzero(~lost).tolist()]
                kept = b" ".join(own)
                out["n_words"].append(k)
                out["n_removed"].append(k - len(own))
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if texts:
                    out["text"].append(kept.decode())
        types = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "text": pa.string()}
        return pa.table({k: pa.array(v, types[k]) for k, v in out.items()})

    return blocks.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * texts)


def deduplicate(docs: DataFrame, batches: int = BATCHES, texts: bool = False) -> DataFrame:
    """Index the documents batch by batch in order of doc_id, and cut repeated windows."""
    blocks, n = deal(docs)
    last = blocks.agg(F.max("block")).first()[0]
    buckets = max(n, ((last or 0) + 1) * (BLOCK_BYTES // 36) // BUCKET_ROWS)
    runs: list[DataFrame] = []
    found = None
    step = -(-((last or 0) + 1) // batches)
    for low in range(0, (last or 0) + 1, step):
        runs.append(run_of(blocks.where((F.col("block") >= low) & (F.col("block") < low + step)), buckets))
        new = stored(candidates(runs, n), "candidates", compression="zstd")
        found = new if found is None else found.unionByName(new)
        if len(runs) > FAN_OUT and low + step <= last:
            runs = [compact(runs, n)]
    repeated = stored(verify(blocks, found, buckets, n), "repeated", compression="zstd")
    return removed(blocks, repeated, texts)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
