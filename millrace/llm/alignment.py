"""Operator 13: tokens of two tokenizers aligned by the bytes that they cover.

A is a byte-level BPE over space + text, B a piece BPE over the text, to which it adds that space itself. A label string
has a byte for each byte of space + text: nothing ends here, an A token, a B token or both. A regular expression takes the
spans up to each label of both, and the labels in a span say how many tokens of each side its group has. The last two
tokens of a group end together: they are its link. How often a link stands in all texts together, and whether it is the
commonest of its B token, comes from a count over the corpus.

A text falls into pieces that neither tokenizer ever joins: it is cut before each blank or line feed that follows something
that is no white space. So all that a piece gives (ids, labels, groups, links) is worked out once in a block of at
most BLOCK_BYTES of text and looked up after that. A block's texts keep their links as numbers of the block, and the
block's distinct links go to the count, and come back with it, once a block: what is shuffled by link is one row a block, so
a link that makes up a third of the corpus is no hot key. The commonest link of a B token is taken among at most as
many rows as A has ids.

Null or empty text, and a text whose joined A or B bytes differ from space + text (as where it holds U+2581): no tokens,
so zeros and an empty groups_sha256. Repeated rows, also of one doc_id or without one: each is a row of the result and each
counts in the corpus. Ties of the commonest link: all of them count. Very long texts are a block each. Columns besides doc_id and
text are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.bpe import _from_varints, _varints, gather
from millrace.llm.shared import flat, slices, stored, tasks_for, text_bytes, text_of

#: Bytes of the texts of a block, and pieces whose results a task keeps at once.
BLOCK_BYTES = 32 << 20
KEPT_PIECES = 300_000

NEITHER, A_END, B_END, BOTH = 0, 1, 2, 3
_GROUP = re.compile(rb"[^\x03]*\x03")

_cache: dict = {}


def _byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 characters for themselves, the
    others' stand-ins follow one another from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """The bytes of each id as flat tables, and the id in digits."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.names = [str(i) for i in range(len(tokens))]
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def same(self, ids: list[list[int]], raw: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each piece, whether its ids' bytes are its own; raw holds all pieces, of these sizes, one after another."""
        flat_ids, bounds = _flat(ids), np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(self.lengths[flat_ids])])
        own, starts = np.diff(upto[bounds]), np.cumsum(sizes) - sizes
        good = own == sizes
        # Pieces of the right size are compared byte by byte, all at once.
        at, n = upto[bounds[:-1]][good], sizes[good]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        data = gather(flat_ids, self.lengths, self.offsets, self.data)
        differs = data[np.repeat(at, n) + step] != raw[np.repeat(starts[good], n) + step]
        good[np.flatnonzero(good)[np.searchsorted(np.cumsum(n), np.flatnonzero(differs), "right")]] = False
        return good


def tokenizers_of(a_path: str | None, b_path: str | None) -> tuple:
    """Both tokenizers with their vocabularies, read once in a process."""
    if (a_path, b_path) not in _cache:
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        a = Tokenizer.from_file(a_path or public_tokenizers.path("byte_bpe_50k.json"))
        a.encode_special_tokens = True
        b = sentencepiece.SentencePieceProcessor(model_file=b_path or public_tokenizers.path("piece_bpe_32k.model"))
        level = _byte_level()
        a_tokens = [b""] * a.get_vocab_size()
        for token, i in a.get_vocab().items():
            a_tokens[i] = bytes(level[c] for c in token) if all(c in level for c in token) else token.encode()
        b_tokens = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in range(len(b)))]
        _cache[a_path, b_path] = a, Vocabulary(a_tokens), b, Vocabulary(b_tokens)
    return _cache[a_path, b_path]


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces begin: at each text, and before each blank or line feed whose left neighbour is no white space.

    A left neighbour that may be the last byte of a white-space character beyond ASCII is taken for one: there is one
    cut less, and the piece is longer.
    """
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    blank = (data == 32) | (data == 10)
    left = data[:-1]
    solid = (left > 32) & (left != 127)
    wide = left >= 0x80
    before = np.concatenate([[np.uint8(0)], left[:-1]]) if len(left) else left
    solid &= ~(wide & np.isin(before, [0xC2, 0x9A, 0x80, 0x81]))
    first[1 : len(data)] |= blank[1:] & solid
    return np.flatnonzero(first[: len(data)])


def encode_pieces(pieces: list[str], a_path: str | None, b_path: str | None) -> tuple[list[list[int]], list[list[int]]]:
    """Ids of A and of B for each piece as it stands in its text."""
    a, _, b, _ = tokenizers_of(a_path, b_path)
    of_a = [x.ids for x in a.encode_batch_fast(pieces, add_special_tokens=False)]
    # B puts its blank in front; a line feed after it is a token by itself, so both can go again.
    of_b = [x[2:] for x in b.encode(["\n" + p for p in pieces], num_threads=1)]
    return of_a, of_b


def _flat(ids: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids), np.int64)


def align(pieces: list[str], a_path: str | None = None, b_path: str | None = None) -> tuple[np.ndarray, list[str], np.ndarray]:
    """For each piece its features (whether both sides' bytes are its own, tokens of A and of B, links; zeros if they are
    not) and its groups as text; and the links a << 32 | b of all pieces."""
    _, a_words, _, b_words = tokenizers_of(a_path, b_path)
    of_a, of_b = encode_pieces(pieces, a_path, b_path)
    data, offsets = flat(pa.array(pieces, pa.large_string()))
    sizes = np.diff(offsets)
    good = a_words.same(of_a, data, sizes) & b_words.same(of_b, data, sizes)
    if not good.all():
        of_a, of_b = [x if g else [] for x, g in zip(of_a, good, strict=True)], [y if g else [] for y, g in zip(of_b, good, strict=True)]
    sizes = np.where(good, sizes, 0)
    a_ids, b_ids = _flat(of_a), _flat(of_b)
    labels = np.zeros(int(sizes.sum()), np.uint8)
    labels[np.cumsum(a_words.lengths[a_ids]) - 1] |= A_END
    labels[np.cumsum(b_words.lengths[b_ids]) - 1] |= B_END
    ends = np.array([m.end() for m in _GROUP.finditer(labels.tobytes())], np.int64)
    a_at = np.concatenate([[0], np.cumsum(labels & A_END > 0)])[ends]  # tokens before each group's end
    b_at = np.concatenate([[0], np.cumsum(labels & B_END > 0)])[ends]
    links = a_ids[a_at - 1] << 32 | b_ids[b_at - 1]
    upto = np.searchsorted(ends, np.cumsum(sizes), "right")  # groups before each piece's end
    # Most groups are one token of each side: these are named once a link.
    values, inverse = np.unique(links, return_inverse=True)
    names = [f"{v >> 32}|{v & 0xFFFFFFFF}" for v in values.tolist()]
    texts = list(map(names.__getitem__, inverse.tolist()))
    a_from, b_from = np.concatenate([[0], a_at[:-1]]), np.concatenate([[0], b_at[:-1]])
    larger = np.flatnonzero((a_at > a_from + 1) | (b_at > b_from + 1))
    a_names, b_names = list(map(a_words.names.__getitem__, a_ids.tolist())), list(map(b_words.names.__getitem__, b_ids.tolist()))
    for k, i, x, j, y in zip(larger.tolist(), a_from[larger].tolist(), a_at[larger].tolist(), b_from[larger].tolist(), b_at[larger].tolist(), strict=True):
        texts[k] = ",".join(a_names[i:x]) + "|" + ",".join(b_names[j:y])
    features = np.empty((len(pieces), 4), np.int64)
    features[:, 0], features[:, 1], features[:, 2] = good, list(map(len, of_a)), list(map(len, of_b))
    features[:, 3] = np.diff(upto, prepend=0)
    groups, at = [], 0
    for to in upto.tolist():
        groups.append(texts[at] if to == at + 1 else ";".join(texts[at:to]))
        at = to
    return features, groups, links


class Block:
    """What is known of the pieces of a block so far, and its links by number."""

    def __init__(self, a_path: str | None, b_path: str | None):
        self.paths, self.numbers, self.uses, self.size = (a_path, b_path), {}, [], 0
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.features = np.zeros((0, 4), np.int64)  # good, tokens of A, tokens of B, links
        self.links, self.starts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def look_up(self, pieces: list[str]) -> np.ndarray:
        """The places of pieces (distinct ones) in this block's tables."""
        if len(self.groups) + len(pieces) > KEPT_PIECES:
            self.forget()
        new = [p for p in pieces if p not in self.at]
        features, groups, links = align(new, *self.paths)
        self.at.update(zip(new, range(len(self.groups), len(self.groups) + len(new)), strict=True))
        self.groups.extend(groups)
        values, inverse = np.unique(links, return_inverse=True)
        numbers = np.array([self.numbers.setdefault(v, len(self.numbers)) for v in values.tolist()], np.int64)
        self.features = np.concatenate([self.features, features])
        self.links = np.concatenate([self.links, numbers[inverse]])
        self.starts = np.cumsum(self.features[:, 3]) - self.features[:, 3]
        return np.array(list(map(self.at.__getitem__, pieces)), np.int64)

    def add(self, doc_ids: pa.Array, texts: pa.Array) -> Iterator[tuple]:
        """The documents of a slice: doc_id, tokens of A and B, groups, digest of the groups, numbers of its links, their uses."""
        spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts, pa.scalar("", pa.large_string()))
        data, offsets = flat(spaced)
        self.size += len(data)
        starts = cuts(data, offsets)
        edges = np.concatenate([starts, [len(data)]]).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(data.tobytes())).dictionary_encode()
        places = self.look_up(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        of_text = np.searchsorted(starts, offsets)
        empty = (np.diff(offsets) <= 1).tolist()
        totals = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.features[places], axis=0)])
        names = list(map(self.groups.__getitem__, places.tolist()))
        for i, doc_id in enumerate(doc_ids.to_pylist()):
            a, b = int(of_text[i]), int(of_text[i + 1])
            good, n_a, n_b, n_links = (totals[b] - totals[a]).tolist()
            if empty[i] or good < b - a:
                yield doc_id, 0, 0, 0, "", b"", b""
                continue
            own = gather(places[a:b], self.features[:, 3], self.starts, self.links)
            numbers, uses = np.unique(own, return_counts=True)
            self.uses.append((numbers, uses))
            yield doc_id, n_a, n_b, n_links, hashlib.sha256(";".join(names[a:b]).encode()).hexdigest(), _varints(np.diff(numbers, prepend=0)), _varints(uses)

    def counted(self) -> np.ndarray:
        """How often each link stands in the block's texts."""
        total = np.zeros(len(self.numbers), np.int64)
        for numbers, uses in self.uses:
            total[numbers] += uses
        self.uses = []
        return total


_PARTS = "block long, number long, link long, n long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, numbers binary, uses binary"
_TYPES = [pa.int64()] * 8 + [pa.string(), pa.binary(), pa.binary()]
_NAMES = [x.split()[0] for x in _PARTS.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(_NAMES)
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def parts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """A row for each document (its links as numbers of its block) and one for each distinct link of a block (number is not null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k, block = TaskContext.get().partitionId() << 32, 0, Block(a_path, b_path)

        def links() -> pa.RecordBatch:
            n = len(block.numbers)
            none = [pa.nulls(n, t) for t in _TYPES[4:]]
            return pa.record_batch([pa.array(np.full(n, task | k)), pa.array(np.arange(n)), pa.array(list(block.numbers), pa.int64()), pa.array(block.counted()), *none], _NAMES)

        for batch in batches:
            for part in slices(batch, "text"):
                if block.size and block.size + part.column("text").nbytes > BLOCK_BYTES:
                    yield links()
                    k, block = k + 1, Block(a_path, b_path)
                yield _batch([(task | k, None, None, None, *row) for row in block.add(part.column("doc_id"), part.column("text"))])
        yield links()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, _PARTS)


def link_counts(made: DataFrame) -> DataFrame:
    """(link, total, best): how often each link stands in the corpus, and whether no link of its B id stands there more often."""
    totals = made.where("number IS NOT NULL").groupBy("link").agg(F.sum("n").alias("total"))
    of_b = Window.partitionBy(F.col("link").bitwiseAND(0xFFFFFFFF))  # at most as many rows as A has ids
    return totals.select("link", "total", (F.col("total") == F.max("total").over(of_b)).alias("best"))


DIGESTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """The row of each document, with its links judged by the whole corpus."""
    spark = docs.sparkSession
    n = tasks_for(spark, text_bytes(docs)[1])
    made = stored(parts(docs, a_path, b_path), "alignment", compression="zstd")
    back = made.where("number IS NOT NULL").select("block", "number", "link").join(link_counts(made), "link")
    back = back.select("block", "number", F.when(F.col("best"), F.col("total")).otherwise(-F.col("total")).alias("n"))
    texts = made.where("number IS NULL").select("block", *_NAMES[4:])
    rows = back.unionByName(texts, allowMissingColumns=True)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A block's links come before its texts."""
        block, counts, table = None, [], None
        for batch in batches:
            of_link = pc.is_valid(batch.column("number")).to_numpy(zero_copy_only=False)
            blocks, n = batch.column("block").to_numpy(), batch.column("n").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.diff(blocks, prepend=blocks[0] - 1 if len(blocks) else 0))
            done = []
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(blocks)], strict=True):
                if blocks[a] != block:
                    block, counts, table = blocks[a], [], None
                links = int(of_link[a:b].sum())
                if links:
                    counts.append(n[a : a + links].astype(np.int64))
                if links < b - a and table is None:
                    table, counts = np.concatenate([np.zeros(0, np.int64), *counts]), []
                for row in batch.slice(a + links, b - a - links).to_pylist():
                    numbers, uses = np.cumsum(_from_varints(row["numbers"])), _from_varints(row["uses"])
                    found = table[numbers] if len(numbers) else np.zeros(0, np.int64)
                    done.append((row["doc_id"], row["n_a"], row["n_b"], row["n_groups"], row["n_groups"], int(uses[found > 0].sum()), int((np.abs(found) * uses).sum()), row["groups_sha256"]))
            columns = list(zip(*done, strict=True)) if done else [[]] * 8
            yield pa.record_batch([pa.array(list(c), pa.int64()) for c in columns[:7]] + [pa.array(list(columns[7]), pa.string())], [x.split()[0] for x in DIGESTS.split(", ")])

    return rows.repartition(n, "block").sortWithinPartitions("block", F.col("number").asc_nulls_last()).mapInArrow(judge, DIGESTS)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
