"""Operator 12: the structure of conversations repaired at least cost.

A repaired conversation's roles read, by their first letters, (s?(ua)+)?. Edits of a row: keep it (0; 5 if truncated), give it
the role user or assistant (1, and 5 if truncated), delete it (2; blank and repeated rows must go); between rows, insert an empty turn (5). The audit
is the edits' letters (K, R, D, I) in order; of audits of one cost the least in ASCII order is taken.

The grammar's four states and the edits are a weighted automaton. It is made deterministic lazily, read from the end of a
conversation: the costs still to come from each state, less their minimum, are one state of the new automaton, and the
step for a row's symbol (first letter, fault) is worked out when it is first met and kept in a transition table. So a
conversation is scanned by table look-ups, which give its cost; then the arcs that are tight (whose cost is just the
difference of the costs to come) are traced back over the scan, the least letter first, which gives the audit.

Rows are dealt by conversation once for the audits, without texts, and once with them: a conversation passes through its
task as a stream. A task holds nine bytes for each row of one conversation, as the audit is a string of one row; texts
are held a batch at a time, so a conversation with a third of all rows costs time but no memory. Its digest is one SHA-256 over
all its text and so cannot be split.

Null role or text: one blank (so a null text is blank, and a null role is no role). Null conv_id: one conversation. Null
turn: before all others. Ties of turn: by role, then text. Repeated rows: each is a row. Columns besides conv_id, turn, role and text are not
read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.shared import stored, tasks_for, text_bytes

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5

#: States of the grammar by the last role: none yet, system, user, assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: Where a role may go on from a state, and the one role that may be written in.
_AFTER = {(NONE, SYSTEM): SYSTEM, (NONE, USER): USER, (SYSTEM, USER): USER, (USER, ASSISTANT): ASSISTANT, (ASSISTANT, USER): USER}
_OWED = [USER, USER, ASSISTANT, USER]
_NAME = {USER: "user", ASSISTANT: "assistant"}
#: Inserts that end a conversation.
_TAIL = ["", INSERT * 2, INSERT, ""]

#: Faults by the number that a row carries; symbols are state of the row's role * 4 + fault.
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
WHITE = " \t\n\x0b\x0c\r"


class Automaton:
    """The deterministic automaton as far as it has been met. A process keeps one."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.steps: dict[int, tuple[int, int]] = {}  # state * 16 + symbol: next state, what the minimum grows by
        self.arcs: dict[int, tuple[str, int]] = {}  # (state * 16 + symbol) * 4 + state of the grammar: letters, state after them
        self.end = self.state(tuple(INSERT_COST * len(t) for t in _TAIL))[0]

    def state(self, costs: tuple[int, ...]) -> tuple[int, int]:
        least = min(costs)
        vector = tuple(c - least for c in costs)
        if vector not in self.number:
            self.number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.number[vector], least

    @staticmethod
    def edits(symbol: int, q: int) -> list[tuple[str, int, int]]:
        """(letter, cost, state after it) of all that may become of a row, in order of their letters."""
        role, fault = divmod(symbol, 4)
        out = [(DELETE, DELETE_COST, q)]
        if fault in (SOUND, TRUNCATED):
            more = TRUNCATED_COST if fault == TRUNCATED else 0
            if (q, role) in _AFTER:
                out.append((KEEP, more, _AFTER[q, role]))
            out.append((REROLE, REROLE_COST + more, _OWED[q]))
        return out

    def costs(self, state: int, symbol: int) -> list[int]:
        """From each state of the grammar, with this row and what follows it still to come; not normalised."""
        after = self.vectors[state]
        found = [min(c + after[to] for _, c, to in self.edits(symbol, q)) for q in range(4)]
        for _ in range(3):  # inserts before the row, three at most before a state comes again
            found = [min(found[q], INSERT_COST + found[_OWED[q]]) for q in range(4)]
        return found

    def step(self, key: int) -> tuple[int, int]:
        self.steps[key] = made = self.state(tuple(self.costs(*divmod(key, 16))))
        return made

    def arc(self, key: int, q: int) -> tuple[str, int]:
        """The letters of the least tight edits up to and with a row, and the state after them."""
        state, symbol = divmod(key, 16)
        costs, after, letters, at = self.costs(state, symbol), self.vectors[state], "", q
        while True:
            tight = [(e, to) for e, c, to in self.edits(symbol, at) if c + after[to] == costs[at]]
            if INSERT_COST + costs[_OWED[at]] == costs[at] and (not tight or tight[0][0] > INSERT):
                letters, at = letters + INSERT, _OWED[at]
                continue
            self.arcs[key * 4 + q] = made = letters + tight[0][0], tight[0][1]
            return made

    def solve(self, symbols: bytes) -> tuple[int, str]:
        """The least cost and the audit of a conversation's symbols."""
        state, total, seen, steps = self.end, 0, [], self.steps
        for symbol in reversed(symbols):
            key = state * 16 + symbol
            seen.append(key)
            state, more = steps.get(key) or self.step(key)
            total += more
        letters, q, arcs = [], NONE, self.arcs
        for key in reversed(seen):
            piece, q = arcs.get(key * 4 + q) or self.arc(key, q)
            letters.append(piece)
        return total + self.vectors[state][NONE], "".join(letters) + _TAIL[q]


_automaton = Automaton()


def spoken(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with nulls of the last two as one blank."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), one("role"), one("text"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows as spoken(), damaged by crc32(conv_id:turn) % 20, and `gone` for those that it drops, so that no conversation is lost."""
    key = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))).cast("binary")) % 20
    rows = spoken(conversations).withColumn("damage", key)
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("damage") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", r"[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("damage") == 0).alias("gone"),
        F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _symbol(role: Column, fault: Column) -> Column:
    first = F.left(role, F.lit(1))
    return (F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(NONE) * 4 + fault).cast("int")


def judged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, gone) with `symbol`: role and first fault. Rows that are gone have none (null).

    A repeat is found by a digest of role and text within a conversation. The rows are already dealt by conversation then.
    """
    n = tasks_for(rows.sparkSession, text_bytes(rows)[1])
    same = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    order = Window.partitionBy("conv_id", "gone", "same").orderBy(F.col("turn").asc_nulls_first())
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(bare == "", BLANK).when(F.col("before") > 1, DUPLICATE).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    rows = rows.withColumn("same", same).repartition(n, "conv_id").withColumn("before", F.row_number().over(order))
    return rows.select("conv_id", "turn", "role", "text", F.when(~F.col("gone"), _symbol(F.col("role"), fault)).alias("symbol"))


AUDITS = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _order() -> list:
    """Rows of a conversation; of equal ones the first is the one that is no repeat."""
    return [F.col("turn").asc_nulls_first(), "role", "text", F.col("symbol").bitwiseAND(3) == DUPLICATE]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bool, pa.RecordBatch]]:
    """Runs of one conv_id in sorted batches: conv_id, whether it goes on from the run before, its rows."""
    before, started = None, False
    for batch in batches:
        ids = batch.column("conv_id")
        values, valid = ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False)
        edges = np.flatnonzero((values[1:] != values[:-1]) | (valid[1:] != valid[:-1])) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(values)], strict=True):
            if a < b:
                own = ids[a].as_py()
                yield own, started and own == before, batch.slice(a, b - a)
                before, started = own, True


def _row(conv_id: int | None, parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple:
    symbols = np.concatenate([p[0] for p in parts])
    turns = np.concatenate([p[1] for p in parts])  # in order, without nulls
    gaps = int(turns[-1]) - int(turns[0]) - int(np.count_nonzero(np.diff(turns))) if len(turns) else 0
    faults, roles = symbols & 3, symbols >> 2
    legal = np.isin(roles[:-1] * 4 + roles[1:], [SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER])
    cost, audit = _automaton.solve(symbols.tobytes())
    return conv_id, gaps, *(int((faults == f).sum()) for f in (BLANK, DUPLICATE, TRUNCATED)), int((~legal).sum()), cost, audit


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*((x.split()[0], pa.string() if x.endswith("string") else pa.int64()) for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names)


def audits(marked: DataFrame) -> DataFrame:
    """Counts, cost and audit of each conversation, from judged rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts, done = None, [], []
        for conv_id, on, rows in _runs(batches):
            if not on:
                if parts:
                    done.append(_row(own, parts))
                own, parts = conv_id, []
                if len(done) >= 4096 or sum(map(len, (r[-1] for r in done[-64:]))) > 1 << 22:
                    yield _table(done, AUDITS)
                    done = []
            here = rows.filter(rows.column("symbol").is_valid())
            parts.append((here.column("symbol").to_numpy().astype(np.uint8), here.column("turn").drop_null().to_numpy().copy()))
        if parts:
            done.append(_row(own, parts))
        yield _table(done, AUDITS)

    n = tasks_for(marked.sparkSession, text_bytes(marked)[1])
    lines = marked.repartition(n, "conv_id").sortWithinPartitions("conv_id", *_order())
    return lines.select("conv_id", "turn", "symbol").mapInArrow(run, AUDITS)


class Writer:
    """Applies an audit to the rows of a conversation, which come in order, and hashes what comes out."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.sha, self.first = audit, 0, NONE, hashlib.sha256(), True

    def put(self, role: str, text: str) -> None:
        self.sha.update(("" if self.first else "\n").encode() + f"{role}:{text}".encode())
        self.first = False

    def inserts(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT:
            self.state = _OWED[self.state]
            self.put(_NAME[self.state], "")
            self.at += 1

    def row(self, role: str, text: str, symbol: int) -> None:
        self.inserts()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit == KEEP:
            self.state = symbol >> 2
            self.put(role, text)
        elif edit == REROLE:
            self.state = _OWED[self.state]
            self.put(_NAME[self.state], text)

    def digest(self) -> str:
        self.inserts()
        return self.sha.hexdigest()


REPAIRED = AUDITS + ", repaired_sha256 string"


def digests(marked: DataFrame, found: DataFrame) -> DataFrame:
    """The audits' rows with repaired_sha256: each audit comes before the rows of its conversation and is applied to them."""
    rows = found.withColumn("symbol", F.lit(-1)).unionByName(marked.where("symbol IS NOT NULL"), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, writer, done = None, None, []
        for _, on, rows in _runs(batches):
            if not on:
                if head:
                    done.append((*head, writer.digest()))
                    if len(done) >= 4096 or len(head[-1]) > 1 << 20:
                        yield _table(done, REPAIRED)
                        done = []
                head = tuple(rows.column(x.split()[0])[0].as_py() for x in AUDITS.split(", "))
                writer, rows = Writer(head[-1]), rows.slice(1)
            for role, text, symbol in zip(*(rows.column(c).to_pylist() for c in ("role", "text", "symbol")), strict=True):
                writer.row(role, text, symbol)
        if head:
            done.append((*head, writer.digest()))
        yield _table(done, REPAIRED)

    n = tasks_for(marked.sparkSession, text_bytes(marked)[1])
    return rows.repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("symbol") >= 0, *_order()).mapInArrow(run, REPAIRED)


def repaired(rows: DataFrame) -> DataFrame:
    """What op12 returns, from rows (conv_id, turn, role, text, gone)."""
    marked = stored(judged(rows), "repair")
    return digests(marked, stored(audits(marked), "audits"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
