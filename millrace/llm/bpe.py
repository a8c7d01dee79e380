"""Operator 3: byte-level BPE encoding and decoding by a global shuffle of distinct words.

Pre-tokens are taken with their positions. Those of a frequent-word table of bounded size are replaced in place by the
word's rank; all others are exploded once a block of texts and shuffled by word, so that each distinct word meets in one
place and is encoded once there. Its ids then go back by a shuffle on the block and are put in by position. The
frequent-word table only decides which way a word takes, never its ids; so it may come from a bounded sample, and it is
what keeps a word that makes up a third of a corpus out of the shuffle.

Decoding joins ids with the token-byte table (one row per id, so its size is that of the vocabulary).

Null text: as empty. Empty text: no ids. Repeated rows, also of one doc_id: each row is encoded. Columns besides doc_id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import pretokens
from millrace.llm.shared import bucketed, flat, slices, span_hashes, tasks_for, text_bytes, text_of

#: Largest frequent-word table, and the documents of the sample that it is counted on.
FREQUENT_WORDS = 1 << 17
SAMPLE_DOCUMENTS = 20_000
#: Bytes of the texts of a block.
BLOCK_BYTES = 32 << 20

_cache: dict = {}


def read_ranks(path: str | None = None) -> dict[bytes, int]:
    """The ranks file's byte strings and ids, read once in a process."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    if ("ranks", path) not in _cache:
        with open(path, "rb") as file:
            _cache["ranks", path] = {base64.b64decode(a): int(b) for a, b in (x.split() for x in file if x.strip())}
    return _cache["ranks", path]


def encoder(path: str | None):
    """tiktoken's encoding by these ranks, made once in a process."""
    if ("encoder", path) not in _cache:
        import public_tokenizers
        import tiktoken

        _cache["encoder", path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    return _cache["encoder", path]


def token_table(path: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table by id: lengths, offsets and all bytes."""
    if ("table", path) not in _cache:
        ranks = read_ranks(path)
        by_id = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            by_id[i] = token
        lengths = np.array([len(x) for x in by_id])
        _cache["table", path] = lengths, np.cumsum(lengths) - lengths, np.frombuffer(b"".join(by_id), np.uint8)
    return _cache["table", path]


def gather(ids: np.ndarray, lengths: np.ndarray, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The entries of all ids, one after another."""
    n = lengths[ids]
    total = int(n.sum())
    ends = np.cumsum(n)
    return data[np.repeat(offsets[ids] - (ends - n), n) + np.arange(total)]


def decode_ids(ids: np.ndarray, path: str | None = None) -> bytes:
    """The bytes that ids stand for: a join with the token-byte table."""
    lengths, offsets, data = token_table(path)
    return gather(ids, lengths, offsets, data).tobytes()


def once(what: str, token: str, make):
    """What make() gives, kept in this process until another token asks."""
    if _cache.get(what, ("",))[0] != token:
        _cache[what] = token, make()
    return _cache[what][1]


def ids_of(words: list[str], path: str | None) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word has, and all ids."""
    ids = [encoder(path).encode_ordinary(w) for w in words]
    return np.array([len(x) for x in ids], np.int64), np.array([i for x in ids for i in x], np.uint16)


def frequent_words(docs: DataFrame, rows: int, most: int = FREQUENT_WORDS, sample: int = SAMPLE_DOCUMENTS) -> list[str]:
    """The most frequent pre-tokens of a bounded sample of the documents, at most `most`, in order of frequency."""
    picked = docs.where(F.col("text").isNotNull()).select(text_of().alias("text"))
    if rows > sample:
        picked = picked.sample(fraction=sample / rows, seed=11)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = flat(part.column("text"))
                text, points, ends = pretokens.code_points(data.tobytes(), offsets)
                starts, ends = pretokens.spans(points, ends, "bytes")
                seen.update(text[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True) if b - a <= 64)
        yield pa.record_batch({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

    counted = picked.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counted.where("n > 1").orderBy(F.desc("n"), "word").limit(most)
    return [r.word for r in top.collect()]


def _varints(values: np.ndarray) -> bytes:
    """7 bits a byte, low bits first, as many bytes as a value needs."""
    if len(values) and values.min() < 0:
        raise ValueError("only numbers from 0 have a code")
    values = values.astype(np.uint64)
    n, most = np.ones(len(values), np.int64), int(values.max()) if len(values) else 0
    width = max(1, -(-most.bit_length() // 7))
    for j in range(1, width):
        n += values >= np.uint64(1 << (7 * j))
    ends = np.cumsum(n)
    out = np.zeros(int(ends[-1]) if len(n) else 0, np.uint8)
    at = ends - n
    for j in range(width):
        more = n > j
        out[at[more] + j] = ((values[more] >> np.uint64(7 * j)) & np.uint64(0x7F)).astype(np.uint8) | np.where(n[more] > j + 1, 0x80, 0).astype(np.uint8)
    return out.tobytes()


def _from_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 0x80)
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(ends)]
    out = (raw[starts] & 0x7F).astype(np.int64)
    for j in range(1, int((ends - starts).max()) + 1 if len(ends) else 1):
        more = ends - starts >= j
        out[more] |= (raw[starts[more] + j] & 0x7F).astype(np.int64) << (7 * j)
    return out


def id_rows(doc_ids: list, ids: list[np.ndarray], _: str | None) -> pa.Table:
    return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())})


def encode(docs: DataFrame, ranks_path: str | None = None, most: int = FREQUENT_WORDS, sample: int = SAMPLE_DOCUMENTS, finish=id_rows, schema: str = "doc_id long, ids binary") -> DataFrame:
    """Rows (doc_id, ids) with ids as little-endian unsigned 32-bit integers, of all rows (doc_id, text).

    The texts of one task make blocks of at most BLOCK_BYTES. A block's rows hold the word codes of a slice of texts, by
    position; its rare words are numbered, and go to the shuffle once a block. finish gets doc_ids, id arrays and the
    ranks' path and makes other columns of them.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows, size = text_bytes(docs)
    frequent = frequent_words(docs, rows, most, sample)
    shared = spark.sparkContext.broadcast(frequent)  # at most `most` words of at most 64 characters
    token = uuid.uuid4().hex
    rare = len(frequent)  # rare word i of a block has the code rare + i

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = once("frequent", token, lambda: {w: i for i, w in enumerate(shared.value)})
        task, block, size, own = TaskContext.get().partitionId(), 0, 0, {}
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = flat(part.column("text"))
                if size and size + len(data) > BLOCK_BYTES:
                    block, size, own = block + 1, 0, {}
                size += len(data)
                text, points, bounds = pretokens.code_points(data.tobytes(), offsets)
                starts, ends = pretokens.spans(points, bounds, "bytes")
                of_word, first = distinct(span_hashes(points, starts, ends))
                words = [text[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
                before = len(own)
                codes = [known[w] if w in known else rare + own.setdefault(w, len(own)) for w in words]
                new = list(islice(own, before, None)) if before else list(own)
                codes = np.array(codes, np.int64)[of_word] if words else np.zeros(0, np.int64)
                yield pa.record_batch({
                    "block": pa.array([task << 32 | block], pa.int64()),
                    "first_word": pa.array([before], pa.int32()),
                    "doc_ids": pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "counts": pa.array([_varints(np.diff(np.searchsorted(starts, bounds)))], pa.binary()),
                    "codes": pa.array([_varints(codes)], pa.binary()),
                    "words": pa.array([new], pa.list_(pa.string())),
                })

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by word: each distinct word is encoded when it is first met."""
        piece, word, ids = encoder(ranks_path), None, b""
        for batch in batches:
            found = []
            for w in batch.column("word").to_pylist():
                if w != word:
                    word, ids = w, np.array(piece.encode_ordinary(w), np.uint16).tobytes()
                found.append(ids)
            yield pa.record_batch({"block": batch.column("block"), "number": batch.column("number"), "ids": pa.array(found, pa.binary())})

    def put_together(rows: pa.Table, words: pa.Table) -> pa.Table:
        """The rows of one block, and the ids of its rare words."""
        lengths, table = once("ids", token, lambda: ids_of(shared.value, ranks_path))
        words = words.sort_by("number")
        if len(words) and words.column("number")[-1].as_py() != len(words) - 1:
            raise ValueError("a block's rare words are not all there")
        own = words.column("ids").to_pylist()
        lengths = np.concatenate([lengths, np.array([len(x) // 2 for x in own], np.int64)])
        table = np.concatenate([table, np.frombuffer(b"".join(own), np.uint16)])
        offsets, done = np.cumsum(lengths) - lengths, []
        for row in rows.select(["doc_ids", "counts", "codes"]).to_pylist():
            codes = _from_varints(row["codes"])
            ids, ends = gather(codes, lengths, offsets, table), np.concatenate([[0], np.cumsum(lengths[codes])])
            bounds = np.concatenate([[0], np.cumsum(_from_varints(row["counts"]))]).astype(np.int64)
            if bounds[-1] != len(codes):
                raise ValueError("the texts' numbers of words do not add up to the words")
            edges = ends[bounds].tolist()
            done.append(finish(row["doc_ids"], [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)], ranks_path))
        return pa.concat_tables(done)

    n = tasks_for(spark, size)
    blocks = bucketed(docs.mapInArrow(split, "block long, first_word int, doc_ids array<long>, counts binary, codes binary, words array<string>"), "block", n)
    rare_words = blocks.select("block", "first_word", F.posexplode("words").alias("place", "word")).select("block", (F.col("first_word") + F.col("place")).alias("number"), "word")
    found = rare_words.repartition(n, "word").sortWithinPartitions("word").mapInArrow(look_up, "block long, number int, ids binary")
    return blocks.select("block", "doc_ids", "counts", "codes").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(put_together, schema)


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each hash its code in order of first appearance, and where each code first appears."""
    import pandas as pd

    codes, _ = pd.factorize(hashes)
    if not len(codes):
        return codes, codes
    top = np.maximum.accumulate(codes)
    return codes, np.flatnonzero(np.diff(top, prepend=-1) > 0)


def decode(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """Rows (doc_id, data): the bytes of each row's ids."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "data": pa.array([decode_ids(np.frombuffer(x.as_py(), "<u4"), ranks_path) for x in batch.column("ids")], pa.binary())})

    return encoded.select("doc_id", "ids").mapInArrow(join, "doc_id long, data binary")


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digest_rows(doc_ids: list, ids: list[np.ndarray], path: str | None) -> pa.Table:
    """doc_id, n_tokens, ids_sha256 and, of the bytes decoded from the ids, decoded_sha256."""
    lengths, offsets, digits = once("digits", str(path), lambda: decimal_table(len(token_table(path)[0])))
    return pa.table({
        "doc_id": pa.array(doc_ids, pa.int64()),
        "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
        "ids_sha256": pa.array([hashlib.sha256(gather(x, lengths, offsets, digits)[:-1]).hexdigest() for x in ids], pa.string()),
        "decoded_sha256": pa.array([hashlib.sha256(decode_ids(x, path)).hexdigest() for x in ids], pa.string()),
    })


def decimal_table(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each id's decimal digits and a space: lengths, offsets and all bytes."""
    names = [b"%d " % i for i in range(size)]
    lengths = np.array([len(x) for x in names])
    return lengths, np.cumsum(lengths) - lengths, np.frombuffer(b"".join(names), np.uint8)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), finish=digest_rows, schema=DIGESTS)
