"""Operator 8: benchmark decontamination by SimHash of item-sized windows.

Words are runs of letters, digits and other non-ASCII characters, in lower case. Items are put in classes of nearly equal
length. For a class whose shortest item has n words, windows of about a third of n words are fingerprinted: in documents
every tenth of n words, of items those that begin in a tenth of n words at the item's beginning, in its middle and at its
end. So wherever a copy of an item stands, three of the document's windows are windows of the item, in different places of
it: a copy whose beginning is missing, or that has one part rewritten, still has a window without a change.

A fingerprint is the 64-bit majority of its words' hashes. Fingerprints within RADIUS of each other agree to within
RADIUS // 4 in one of four 16-bit blocks at least; each block has a table of all keys within that distance of an item's,
so all item windows within RADIUS are found. What is found is verified at its place, with a quarter of the item's length to
both sides: the share, weighted by rarity among all items, of the item's runs of five words that the document has there,
which must reach 0.8. Running sums of the weights of all runs that any item has tell first where the share cannot reach it.

Items are taken in groups of about MOST_WORDS words, so what is sent to the executors is bounded; a larger benchmark takes
more passes. Rarity is counted over all items first.

Null or empty texts: no words, no matches. Items of fewer than five words are one run of all their words. Ties: each item
that a document holds gives a row, with its best, then first place. Null doc_id or item_id: kept as null. Repeated rows
of a document each give rows, equal item rows give one. Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import U64, flat, mix, shingles, slices, span_hashes, text_of, utf8, words

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 11
#: Words of a window at most and, where the item has so many, at least.
LONGEST, SHORTEST = 240, 8
#: Words of the items of one pass.
MOST_WORDS = 400_000
#: Weights of runs are summed in whole numbers of 1 / UNIT.
UNIT = 1 << 20

_SEPARATOR = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
#: The eight bits of a byte, each in a byte of its own.
_SPREAD = np.array([sum(((i >> b) & 1) << (8 * b) for b in range(8)) for i in range(256)], U64)
_HIGH, _ONES, _GATHER = U64(0x8080808080808080), U64(0x0101010101010101), U64(0x0102040810204080)


def split(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and each text's first word (n + 1)."""
    data, offsets = flat(utf8(pc.utf8_lower(column)))
    starts, ends, bounds = words(data, offsets, _SEPARATOR)
    return span_hashes(data, starts, ends), bounds


def sums(hashes: np.ndarray) -> np.ndarray:
    """Running sums of the words' bits (8, n + 1), eight bits to a number, a byte each; differences up to 255 are exact."""
    bits = np.ascontiguousarray(mix(hashes)).view(np.uint8).reshape(-1, 8)
    out = np.zeros((8, len(hashes) + 1), U64)
    for k in range(8):
        np.cumsum(_SPREAD[bits[:, k]], out=out[k, 1:])
    return out


def fingerprints(running: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """The majority of bits of `length` words from each start."""
    out = np.zeros(len(starts), U64)
    lift = _ONES * U64(127 - length // 2)
    for k in range(8):
        over = (running[k][starts + length] - running[k][starts] + lift) & _HIGH
        out |= ((over >> U64(7)) * _GATHER >> U64(56)) << U64(8 * k)
    return out


def length_classes(sizes: list[int]) -> list[tuple[int, int]]:
    """(shortest, longest) lengths of the classes: no more than an eighth apart."""
    out: list[tuple[int, int]] = []
    for n in sorted(set(sizes)):
        if out and n <= out[-1][0] + out[-1][0] // 8:
            out[-1] = (out[-1][0], n)
        else:
            out.append((n, n))
    return out


def window_sizes(low: int) -> tuple[int, int]:
    """Stride and length of the windows for items of `low` words or little more."""
    return max(1, low // 10), min(LONGEST, max(min(low, SHORTEST), -(-9 * low // 25)))


def window_offsets(size: int, stride: int, length: int) -> list[int]:
    """Where an item's windows begin: `stride` places each at its beginning, in its middle and at its end."""
    last = size - length
    middle = (last - stride + 1) // 2
    return sorted({min(last, max(0, first + i)) for first in (0, middle, last - stride + 1) for i in range(stride)})


def item_runs(hashes: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words, or of all words of a shorter item."""
    n = len(hashes)
    return shingles(hashes, np.array([0, n]), min(SHINGLE, n))[0] if n else np.zeros(0, U64)


class Items:
    """A group of items (item_id, text), ready to be looked for. seen: of how many items each run is, of those of more than
    one; total: how many items there are."""

    def __init__(self, rows: list[tuple[int, str]], seen: dict[int, int], total: int):
        hashes, bounds = split(pa.array([t for _, t in rows], pa.large_string()))
        self.ids = [i for i, _ in rows]
        self.sizes = np.diff(bounds)
        self.runs, self.counts, self.weights = [], [], []  # of each item: sorted distinct runs, how often, weight
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            runs, counts = np.unique(item_runs(hashes[a:b]), return_counts=True)
            rare = 1 + np.log(total / np.array([seen.get(r, 1) for r in runs.tolist()], float))
            self.runs.append(runs)
            self.counts.append(counts)
            self.weights.append(rare)
        self.full = np.array([(c * w).sum() for c, w in zip(self.counts, self.weights, strict=True)])
        self.known = {}  # by length of runs: sorted distinct runs of all items of such runs, and their weights, rounded up
        length = np.minimum(self.sizes, SHINGLE)
        for k in np.unique(length[length > 0]).tolist():
            own = np.flatnonzero(length == k).tolist()
            runs, at = np.unique(np.concatenate([self.runs[i] for i in own]), return_index=True)
            self.known[k] = runs, np.ceil(np.concatenate([self.weights[i] for i in own])[at] * UNIT).astype(np.int64)
        self.classes = []
        running = sums(hashes)
        steps = RADIUS // 4
        near = [0] + [1 << a for a in range(16)] * (steps >= 1) + [1 << a | 1 << b for a in range(16) for b in range(a)] * (steps >= 2)
        near = np.array(near, np.int32)
        for low, high in length_classes([n for n in self.sizes.tolist() if n]):
            stride, length = window_sizes(low)
            own = np.flatnonzero((self.sizes >= low) & (self.sizes <= high)).tolist()
            places = [window_offsets(int(self.sizes[i]), stride, length) for i in own]
            item, offset = np.repeat(own, [len(x) for x in places]), np.array([o for x in places for o in x], np.int64)
            prints = fingerprints(running, bounds[item] + offset, length)
            tables = []
            for block in range(4):
                keys = ((prints >> U64(16 * block)) & U64(0xFFFF)).astype(np.int32)
                keys = (keys[:, None] ^ near).ravel()
                order = np.argsort(keys, kind="stable")
                firsts = np.searchsorted(keys[order], np.arange((1 << 16) + 1))
                tables.append((np.diff(firsts) > 0, firsts.astype(np.int32), (order // len(near)).astype(np.int32)))
            self.classes.append((stride, length, item, offset, prints, tables))

    def near(self, running: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item, where it would begin) of all window pairs within RADIUS."""
        for stride, length, item, offset, prints, tables in self.classes:
            count = np.maximum((np.diff(bounds) - length) // stride + 1, 0)
            total = int(count.sum())
            if not total:
                continue
            starts = np.repeat(bounds[:-1], count) + stride * (np.arange(total) - np.repeat(np.cumsum(count) - count, count))
            own = fingerprints(running, starts, length)
            for block, (filled, firsts, which) in enumerate(tables):
                key = ((own >> U64(16 * block)) & U64(0xFFFF)).astype(np.int64)
                hit = np.flatnonzero(filled[key])
                if not len(hit):
                    continue
                key = key[hit]
                n = (firsts[key + 1] - firsts[key]).astype(np.int64)
                window = np.repeat(hit, n)
                at = np.repeat(firsts[key] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                other = which[at]
                close = np.bitwise_count(own[window] ^ prints[other]) <= RADIUS
                yield item[other[close]], starts[window[close]] - offset[other[close]]

    def shingled(self, hashes: np.ndarray, bounds: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length of runs: the hash of the run at each word, 0 where its text ends before, and running sums (n + 1) of the
        weights of those that any item has."""
        out = {}
        for k, (runs, weights) in self.known.items():
            found, places = shingles(hashes, bounds, k)
            at, held = np.zeros(len(hashes), U64), np.zeros(len(hashes) + 1, np.int64)
            at[places] = found
            which = np.minimum(np.searchsorted(runs, found), len(runs) - 1)
            held[places + 1] = np.where(runs[which] == found, weights[which], 0)
            out[k] = at, np.cumsum(held)
        return out

    def possible(self, hashes: np.ndarray, bounds: np.ndarray, shingled: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """(item, where it would begin, text, first run, end of runs), in order, of the window pairs whose runs may reach
        SIMILARITY: a place that has less weight of all items' runs than that has less of this item's."""
        reach = int(self.sizes.max(initial=0))  # an item begins less than this before the first word
        span = len(hashes) + reach
        pairs = [item * span + (at + reach) for item, at in self.near(sums(hashes), bounds)]
        item, at = np.divmod(np.unique(np.concatenate(pairs or [np.zeros(0, np.int64)])), span)
        at -= reach
        size = self.sizes[item]
        text = np.searchsorted(bounds, np.clip(at + size // 2, 0, len(hashes) - 1), "right") - 1
        first = np.maximum(at - size // 4, bounds[text])
        end = np.maximum(first, np.minimum(at + size + size // 4, bounds[text + 1]) - np.minimum(size, SHINGLE) + 1)
        keep = np.zeros(len(item), bool)
        for k, (_, held) in shingled.items():
            own = np.flatnonzero(np.minimum(size, SHINGLE) == k)
            keep[own] = held[end[own]] - held[first[own]] >= SIMILARITY * UNIT * (1 - 1e-9) * self.full[item[own]]
        return np.stack([item, at, text, first, end], 1)[keep]

    def search(self, column: pa.Array) -> list[tuple[int, int, int, float]]:
        """(text, item number, first word, similarity) of all verified matches, one an item and text."""
        hashes, bounds = split(column)
        if not len(hashes):
            return []
        shingled = self.shingled(hashes, bounds)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for i, at, text, a, b in self.possible(hashes, bounds, shingled).tolist():
            runs = self.runs[i]
            there = shingled[min(SHINGLE, int(self.sizes[i]))][0][a:b]
            place = np.minimum(np.searchsorted(runs, there), len(runs) - 1)
            n = np.bincount(place[runs[place] == there], minlength=len(runs))
            share = float((np.minimum(n, self.counts[i]) * self.weights[i]).sum() / self.full[i])
            if share >= SIMILARITY:
                old = best.get((text, i))
                if old is None or (share, -at) > (old[0], -old[1]):
                    best[text, i] = share, at
        return [(t, i, max(0, at - int(bounds[t])), share) for (t, i), (share, at) in best.items()]


_prepared: dict[str, Items] = {}


def prepared(token: str, shared) -> Items:
    """The items of this broadcast, prepared once in a process."""
    if token not in _prepared:
        _prepared.clear()
        _prepared[token] = Items(*shared.value)
    return _prepared[token]


def runs_of(items: DataFrame) -> DataFrame:
    """(run): each item's distinct runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, bounds = split(part.column("text"))
                found = [np.unique(item_runs(hashes[a:b])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                yield pa.record_batch({"run": pa.array(np.concatenate(found or [np.zeros(0, U64)]).view(np.int64))})

    return items.select("text").mapInArrow(run, "run long")


def passes(benchmark: DataFrame, most: int = MOST_WORDS) -> Iterator[tuple[str, object]]:
    """Broadcasts of groups of about `most` words of items, each with its token."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).distinct()
    total, words_ = items.agg(F.count("*"), F.sum(F.size(F.split("text", r"[^\p{L}\p{N}]+")))).first()
    groups = max(1, -(-(words_ or 0) // most))
    counted = runs_of(items).groupBy("run").agg(F.count("*").alias("n")).where("n > 1")
    for g in range(groups):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g)
        rows = sorted(((r.item_id, r.text) for r in own.collect()), key=lambda r: (r[0] is not None, r))
        mine = counted if groups == 1 else counted.join(runs_of(own), "run", "left_semi")
        seen = {r.run & 0xFFFFFFFFFFFFFFFF: r.n for r in mine.collect()}  # no more than this group's words
        yield uuid.uuid4().hex, spark.sparkContext.broadcast((rows, seen, total))


def leaks(docs: DataFrame, benchmark: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """doc_id, item_id, first_word, similarity: one row for each item that a document holds."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    out = None
    for token, shared in passes(benchmark, most):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, token=token) -> Iterator[pa.RecordBatch]:
            found = prepared(token, shared)
            for batch in batches:
                for part in slices(batch, "text"):
                    hits = found.search(part.column("text"))
                    ids = part.column("doc_id").to_pylist()
                    yield pa.record_batch({
                        "doc_id": pa.array([ids[t] for t, *_ in hits], pa.int64()), "item_id": pa.array([found.ids[i] for _, i, *_ in hits], pa.int64()),
                        "first_word": pa.array([a for _, _, a, _ in hits], pa.int64()), "similarity": pa.array([s for *_, s in hits], pa.float64()),
                    })

        part = docs.mapInArrow(run, "doc_id long, item_id long, first_word long, similarity double")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """The rows of docs that hold no item, with all their columns. Each row is judged by its own text, whatever its doc_id."""
    names = docs.columns
    docs = docs.withColumn("__text", text_of())
    for token, shared in passes(benchmark, most):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, token=token) -> Iterator[pa.RecordBatch]:
            found = prepared(token, shared)
            for batch in batches:
                for part in slices(batch, "__text"):
                    keep = np.ones(len(part), bool)
                    keep[[t for t, *_ in found.search(part.column("__text"))]] = False
                    yield part.set_column(part.schema.get_field_index("__text"), "__text", part.column("__text").cast(pa.string())).filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs.select(*names)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
