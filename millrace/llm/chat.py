"""Operator 7: chat formatting by columnar byte assembly.

A turn is written as <|im_start|>role, a newline, its text, <|im_end|> and a newline. Inside roles and texts, each
"<|" and each backslash is escaped by a backslash, as are newlines in roles, so no text can open or close a turn, and the
text can be had back. The loss mask covers the escaped text of assistant turns and nothing else.

A batch's turns are laid out in numpy: lengths of headers, contents and tails, their running sums, and indices at which
all bytes are copied into one buffer that becomes the Arrow column's. Turns are formatted where they are, without a
shuffle. To read a conversation back its parts are sorted by Spark and pass through its task as a stream, so a
conversation of any length needs no more memory than a batch.

Null text or role: as empty. Ties of turn: by role, then formatted text. Repeated rows: each is a turn. Null conv_id: rows of one
conversation whose id is null. Null turn: first. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import flat, slices, stored, tasks_for, text_bytes, utf8

OPEN, CLOSE = b"<|im_start|>", b"<|im_end|>\n"
#: The role whose texts are learnt.
LEARNT = "assistant"


def escape(column: pa.Array, newlines: bool = False) -> pa.Array:
    """Reversibly without "<|"; with newlines, also without them."""
    column = pc.replace_substring(column, "\\", "\\\\")
    column = pc.replace_substring(column, "<|", "<\\|")
    return pc.replace_substring(column, "\n", "\\n") if newlines else column


_UNESCAPE = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def unescape_text(text: str) -> str:
    """As unescape, for texts, where only backslash and bar follow a backslash."""
    return _UNESCAPE.sub(lambda m: m[1], text) if "\\" in text else text


def scatter(out: np.ndarray, starts: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy the pieces data[offsets[i] : offsets[i + 1]] to out, from starts[i] on, all at once."""
    lengths = np.diff(offsets)
    out[np.repeat(starts - offsets[:-1], lengths) + np.arange(len(data))] = data


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The formatted turns as one string column, and where (bytes) each one's text begins and ends in it."""
    n = len(roles)
    role_bytes, role_offsets = flat(utf8(escape(utf8(roles), newlines=True)))
    text_bytes, text_offsets = flat(utf8(escape(utf8(texts))))
    role_n, text_n = np.diff(role_offsets), np.diff(text_offsets)
    lengths = len(OPEN) + role_n + 1 + text_n + len(CLOSE)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    heads = starts + len(OPEN) + role_n
    out[starts[:, None] + np.arange(len(OPEN))] = np.frombuffer(OPEN, np.uint8)
    scatter(out, starts + len(OPEN), role_bytes, role_offsets)
    out[heads] = 10
    scatter(out, heads + 1, text_bytes, text_offsets)
    out[(ends - len(CLOSE))[:, None] + np.arange(len(CLOSE))] = np.frombuffer(CLOSE, np.uint8)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    column = pa.LargeStringArray.from_buffers(n, pa.py_buffer(offsets), pa.py_buffer(out))
    return column, heads + 1 - starts, heads + 1 + text_n - starts


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, formatted, loss_from, loss_to): each turn's part of its conversation, which is their join in
    order of turn, role, part. loss_from and loss_to bound what is learnt of a part, in bytes; null where nothing is.

    No turn needs another one, so nothing is shuffled and a conversation of any size is spread as its rows are.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                column, a, b = assemble(part.column("role"), part.column("text"))
                skip = ~pc.equal(part.column("role"), LEARNT).to_numpy(zero_copy_only=False).astype(bool)
                yield pa.record_batch({"conv_id": part.column("conv_id"), "turn": part.column("turn"), "role": part.column("role"), "formatted": column.cast(pa.string()), "loss_from": pa.array(a, pa.int64(), mask=skip), "loss_to": pa.array(b, pa.int64(), mask=skip)})

    return rows.mapInArrow(run, "conv_id long, turn long, role string, formatted string, loss_from long, loss_to long")


def joined(rendered: DataFrame) -> DataFrame:
    """(conv_id, formatted): whole conversations as one string each, for those that fit a row."""
    return rendered.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "formatted"))), lambda x: x["formatted"]), "").alias("formatted"))


def parse(formatted: bytes) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        line, end = formatted.find(b"\n", at), formatted.find(CLOSE, at)
        if not formatted.startswith(OPEN, at) or not at < line < end:
            raise ValueError(f"no turn at byte {at}")
        turns.append((unescape(formatted[at + len(OPEN) : line].decode()), unescape_text(formatted[line + 1 : end].decode())))
        at = end + len(CLOSE)
    return turns


def digests(rendered: DataFrame) -> DataFrame:
    """What op7 returns, parsed from the formatted parts; conversations pass as streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = (), None

        def row() -> tuple:
            return key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        def table(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
            return pa.record_batch({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types, strict=True))})

        for batch in batches:
            done = []
            for c, text, a, b in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_from", "loss_to")), strict=True):
                if (c,) != key:
                    if key:
                        done.append(row())
                    key, state = (c,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                raw = text.encode()
                for role, own in parse(raw):
                    state[0] += 1
                    state[1].update(f"{role}\n{own}\n".encode())
                if a is not None:
                    learnt = unescape_text(raw[a:b].decode())
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
                state[4] += len(text)
            yield table(done)
        if key:
            yield table([row()])

    n = tasks_for(rendered.sparkSession, text_bytes(rendered, "formatted")[1])
    names = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rendered.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted").mapInArrow(run, names)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return digests(stored(render(conversations.unionByName(planted)), "chat"))
