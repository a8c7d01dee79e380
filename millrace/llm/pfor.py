"""Operator 6: token ids as patched frame-of-reference blocks, in files of ascending doc_id order.

Ids are cut into blocks of 128. A block stores its minimum, packs the differences at a width that covers a chosen share
of them, and lists the rest as exceptions; an index holds where each block starts, so that one document's ids can be
read without the file's other blocks.

A file row holds the ids of whole documents: their doc_ids and lengths, the place of its first id in the file, the block
index and the blocks. Files are Parquet, written by Spark to the shared folder and read from there; a file's number is
its range of doc_ids.

Null text: as empty. Empty text: the end id alone. Repeated rows and ties of doc_id: each row is written, in order of
doc_id, then text (of texts that begin with the same 64 characters, as they lie in files); null doc_ids come first. So a
doc_id that many rows share, null too, is spread over many files. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import pretokens
from millrace.llm.bpe import distinct, gather
from millrace.llm.shared import flat, slices, span_hashes, stored, tasks_for, text_bytes, text_of

BLOCK = 128
#: The share of a block's values that its width covers.
SHARE = 0.9
#: Ids in a file row; a longer document has a row of its own.
ROW_IDS = 1 << 18
END_ID = 1
#: Words whose ids a process keeps.
KEPT_WORDS = 1 << 20

_cache: dict = {}


# -- blocks -----------------------------------------------------------------------------------------------------------


def pack(ids: np.ndarray, share: float = SHARE) -> tuple[bytes, bytes]:
    """(blocks, index) of unsigned 32-bit ids. A block: minimum u32, width u8, exceptions u8, packed bits, places, values."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return b"", b""
    x = np.empty(n * BLOCK, np.uint32)
    x[: len(ids)], x[len(ids) :] = ids, ids[-1]
    x = x.reshape(n, BLOCK)
    least = x.min(1)
    d = x - least[:, None]
    at = max(0, int(np.ceil(share * BLOCK)) - 1)
    covered = np.partition(d, at, 1)[:, at]
    width = np.ceil(np.log2(covered.astype(np.float64) + 1)).astype(np.int64)
    odd = (d >> np.minimum(width, 31)[:, None].astype(np.uint32) > 0) & (width < 32)[:, None]
    count = odd.sum(1)
    while (many := count > 255).any():  # BLOCK is below 256, so none by default
        width[many] += 1
        odd[many] = d[many] >> width[many, None].astype(np.uint32) > 0
        count = odd.sum(1)
    sizes = 6 + BLOCK // 8 * width + 5 * count
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    head = np.concatenate([least.astype("<u4").view(np.uint8).reshape(n, 4), width.astype(np.uint8)[:, None], count.astype(np.uint8)[:, None]], 1)
    out[starts[:, None] + np.arange(6)] = head
    for w in np.unique(width).tolist():
        if w:
            of = np.flatnonzero(width == w)
            bits = np.unpackbits(d[of].astype(">u4").view(np.uint8)).reshape(len(of), BLOCK, 32)[:, :, 32 - w :]
            out[starts[of, None] + 6 + np.arange(BLOCK // 8 * w)] = np.packbits(bits.reshape(len(of), -1), axis=1)
    row, place = np.nonzero(odd)
    if len(row):
        rank = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        base = (starts + 6 + BLOCK // 8 * width)[row]
        out[base + rank] = place
        values = d[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(base + count[row] + 4 * rank)[:, None] + np.arange(4)] = values
    return out.tobytes(), starts.astype("<u4").tobytes()


def unpack(blocks: bytes, index: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of blocks first to last (all by default), padding included."""
    data, starts = np.frombuffer(blocks, np.uint8), np.frombuffer(index, "<u4").astype(np.int64)[first:last]
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint32)
    least = np.ascontiguousarray(data[starts[:, None] + np.arange(4)]).view("<u4")[:, 0]
    width, count = data[starts + 4].astype(np.int64), data[starts + 5].astype(np.int64)
    d = np.zeros((n, BLOCK), np.uint32)
    for w in np.unique(width).tolist():
        if w:
            of = np.flatnonzero(width == w)
            bits = np.unpackbits(data[starts[of, None] + 6 + np.arange(BLOCK // 8 * w)], axis=1).reshape(len(of), BLOCK, w)
            unit = 16 if w <= 16 else 32
            padded = np.zeros((len(of), BLOCK, unit), np.uint8)
            padded[:, :, unit - w :] = bits
            d[of] = np.packbits(padded.reshape(len(of), -1), axis=1).view(f">u{unit // 8}")
    row = np.repeat(np.arange(n), count)
    if len(row):
        rank = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        base = (starts + 6 + BLOCK // 8 * width)[row]
        place = data[base + rank]
        d[row, place] = np.ascontiguousarray(data[(base + count[row] + 4 * rank)[:, None] + np.arange(4)]).view("<u4")[:, 0]
    return (d + least[:, None]).ravel()


def document(blocks: bytes, index: bytes, start: int, n: int) -> np.ndarray:
    """n ids from place `start` of a row, read from the blocks that hold them."""
    first, last = start // BLOCK, -(-(start + n) // BLOCK)
    return unpack(blocks, index, first, last)[start - first * BLOCK :][:n]


# -- ids --------------------------------------------------------------------------------------------------------------


def tokenizer(path: str | None):
    """(whole tokenizer, the same model for split words, which ids end a word), made once in a process."""
    if ("tokenizer", path) not in _cache:
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        whole = Tokenizer.from_file(path or public_tokenizers.path("word_bpe_49k.json"))
        whole.encode_special_tokens = True  # their strings in a text are ordinary text
        bare = Tokenizer(whole.model)
        bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        vocabulary = whole.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            ends[i] = token.endswith("</w>")
        _cache["tokenizer", path] = whole, bare, ends
    return _cache["tokenizer", path]


def _plain(text: str, points: np.ndarray) -> bool:
    """Whether lower() works character by character and composition (NFC) changes nothing."""
    return text.isascii() or bool(((points < 0x250) & (points != 0x130) | (points >= 0x2010) & (points < 0x205F) & (points != 0x2028) & (points != 0x2029)).all())


def ids_of(part: pa.RecordBatch, path: str | None) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the slice's texts, each text's ids ended by END_ID, and the texts' bounds (n + 1).

    Lower-cased words are split off in numpy and each distinct word is given to the tokenizer once in a process, as
    words do not affect each other. Slices with characters beyond simple lower-casing and composition go to the
    tokenizer as whole texts.
    """
    whole, bare, ends = tokenizer(path)
    data, offsets = flat(part.column("text"))
    text, points, bounds = pretokens.code_points(data.tobytes(), offsets)
    if not _plain(text, points):
        if len(part) > 1:
            parts = [ids_of(part.slice(i, 1), path) for i in range(len(part))]
            return np.concatenate([x[0] for x in parts]), np.concatenate([[0], np.cumsum([len(x[0]) for x in parts])])
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, END_ID], np.uint32)
        return ids, np.array([0, len(ids)])
    text = text.lower()
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    starts, stops = pretokens.spans(points, bounds, "words")
    of_word, first = distinct(span_hashes(points, starts, stops))
    words = [text[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)]
    known = _cache.setdefault(("known", path), {})
    missing = [w for w in words if w not in known]
    if missing:
        if len(known) > KEPT_WORDS:
            known.clear()
            missing = words
        found = np.array(bare.encode(missing, is_pretokenized=True, add_special_tokens=False).ids, np.uint16)
        edges = np.flatnonzero(ends[found]) + 1
        if len(edges) != len(missing):
            raise ValueError("a word's ids are not all there")
        raw, edges = found.tobytes(), [0, *(2 * edges).tolist()]
        known.update(zip(missing, (raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)), strict=True))
    pieces = [known[w] for w in words]
    lengths = np.array([len(x) // 2 for x in pieces] + [1], np.int64)
    table = np.append(np.frombuffer(b"".join(pieces), np.uint16).astype(np.uint32), np.uint32(END_ID))
    at = np.searchsorted(starts, bounds[1:])
    codes = np.insert(of_word, at, len(words)) if len(of_word) else np.full(len(at), len(words))
    ids = gather(codes, lengths, np.cumsum(lengths) - lengths, table)
    last = np.cumsum(lengths[codes])[at + np.arange(len(at))]
    return ids, np.concatenate([[0], last])


# -- files ------------------------------------------------------------------------------------------------------------

ROWS = "file int, first long, n_ids long, doc_ids array<long>, lengths array<long>, index binary, blocks binary"


def write(docs: DataFrame, path: str | None = None, share: float = SHARE) -> DataFrame:
    """Write the ids of all texts in files of ascending doc_id and return the files' rows, as read from there."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, first = TaskContext.get().partitionId(), 0

        def row(waiting: list) -> pa.RecordBatch:
            nonlocal first
            ids = np.concatenate([x[2] for x in waiting])
            blocks, index = pack(ids, share)
            out = pa.record_batch({"file": pa.array([file], pa.int32()), "first": pa.array([first], pa.int64()), "n_ids": pa.array([len(ids)], pa.int64()), "doc_ids": pa.array([sum((x[0] for x in waiting), [])], pa.list_(pa.int64())), "lengths": pa.array([sum((x[1] for x in waiting), [])], pa.list_(pa.int64())), "index": pa.array([index], pa.binary()), "blocks": pa.array([blocks], pa.binary())})
            first += len(ids)
            return out

        waiting, size = [], 0
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids, bounds = ids_of(part, path)
                if waiting and size + len(ids) > ROW_IDS:
                    yield row(waiting)
                    waiting, size = [], 0
                waiting.append((part.column("doc_id").to_pylist(), np.diff(bounds).tolist(), ids))
                size += len(ids)
        if waiting:
            yield row(waiting)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    n = tasks_for(docs.sparkSession, text_bytes(docs)[1])
    docs = docs.withColumn("start", F.substring("text", 1, 64)).withColumn("place", F.monotonically_increasing_id())
    ranged = docs.repartitionByRange(n, "doc_id", "start", "place").drop("start", "place").sortWithinPartitions("doc_id", "text")
    return stored(ranged.mapInArrow(encode, ROWS), "token-files", compression="zstd")


def read(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files, decoded from their blocks."""
    totals = files.groupBy("file").agg(F.sum("n_ids").alias("n"))  # a row a file
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, lengths = unpack(r["blocks"], r["index"])[: r["n_ids"]].astype("<u4"), np.array(r["lengths"], np.int64)
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                yield pa.record_batch({"doc_id": pa.array(r["doc_ids"], pa.int64()), "start": pa.array(r["base"] + r["first"] + ends - lengths, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return files.join(totals.select("file", before.alias("base")), "file").select("base", "first", "n_ids", "doc_ids", "lengths", "index", "blocks").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(write(spark.read.parquet(f"{sf_dir}/documents.parquet")))
