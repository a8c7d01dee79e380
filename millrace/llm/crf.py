"""Operator 4: a linear-chain conditional random field that labels lines good or bad, for document quality.

Each line has whole-line measurements (letters, capitals, symbols, repetition, ...) cut into bins; a line's potential
adds the weights of its own bins and of its neighbours' bins, and a 2 x 2 table weighs neighbouring labels. Forward and
backward sums give each line's probability of being good; their average by line length is turned into the document's
score by a fitted logistic curve.

Training uses labelled rows outside the held-out third only, at most TRAIN_DOCUMENTS of each class (those with the
smallest hash of doc_id), of at most TRAIN_LINES lines; each line learns its document's label. Labels, lang, source and
doc_id are never inputs of a score.

Null text: as empty. Empty text: one empty line, so a score as any other. Ties: a doc_id with several labels learns the
lowest, and one with several texts gives the least; null labels are left out. No labels of one class: the score is the other class's share. Repeated rows: each gives
its row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.shared import MULT, flat, mix, shingles, slices, span_hashes, text_of, words

TRAIN_DOCUMENTS = 2500
TRAIN_LINES = 400
BINS = 10
STEPS = 80
HELD_OUT_FOLD = 1

#: Byte classes that are counted in each line.
_COUNTED = {
    "letters": lambda c: c.isalpha() or ord(c) >= 0xC0,
    "capitals": lambda c: c.isascii() and c.isupper(),
    "digits": lambda c: c.isascii() and c.isdigit(),
    "blanks": lambda c: c in " \t\r\v\f",
    "stops": lambda c: c in ".?,;:",
    "shouts": lambda c: c == "!",
    "symbols": lambda c: c in "#$%&*|<>{}[]\\^~=+_@/",
    "heads": lambda c: not 0x80 <= ord(c) < 0xC0,  # characters, by their first bytes
}
_TABLES = {name: np.array([test(chr(i)) for i in range(256)], np.uint8) for name, test in _COUNTED.items()}
MEASURES = ("size", "words", "letters", "capitals", "digits", "stops", "shouts", "symbols", "word_size", "short_words", "same_bytes", "same_words", "seen_runs", "seen_line", "ends_well")


def measure(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of the slice's texts: measurements (lines, measures) and bytes; and each text's first line (n + 1)."""
    data, offsets = flat(part.column("text"))
    n = len(offsets) - 1
    cuts = np.flatnonzero(data == 10)
    at_text = np.searchsorted(offsets, cuts, "right") - 1  # texts may be empty: the last one that starts there
    # A text's lines start at its first byte and after each of its newlines.
    starts = np.concatenate([offsets[:-1], cuts + 1])
    owner = np.concatenate([np.arange(n), at_text])
    order = np.lexsort((starts, owner))
    starts, owner = starts[order], owner[order]
    first = np.searchsorted(owner, np.arange(n + 1))
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = offsets[1:]

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[ends] - sums[starts]

    count = {name: total(table[data]) for name, table in _TABLES.items()}
    size = np.maximum(count["heads"], 1)
    same = np.zeros(len(data), bool)
    same[1:] = (data[1:] == data[:-1]) & (_TABLES["letters"][data[1:]] == 0)
    same[offsets[:-1][offsets[:-1] < len(data)]] = False  # a text does not go on from the one before it
    word_starts, word_ends, bounds = words(data, offsets)
    of_line = np.searchsorted(starts, word_starts, "right") - 1
    lines = len(starts)
    n_words = np.bincount(of_line, minlength=lines)
    hashes = span_hashes(data, word_starts, word_ends)
    runs, at = shingles(hashes, bounds, 5)
    text_of_run = np.searchsorted(bounds, at, "right") - 1
    seen = pd.Series(runs ^ mix(text_of_run.astype(np.uint64) + MULT)).duplicated().to_numpy()
    seen_runs = np.bincount(of_line[at], weights=seen, minlength=lines) / np.maximum(np.bincount(of_line[at], minlength=lines), 1)
    line_hash = span_hashes(data, starts, ends) ^ mix(owner.astype(np.uint64) + MULT)
    seen_line = pd.Series(line_hash).duplicated().to_numpy() & (n_words > 0)
    same_words = np.zeros(len(hashes), bool)
    same_words[1:] = hashes[1:] == hashes[:-1]
    same_words[bounds[:-1][bounds[:-1] < len(hashes)]] = False
    last = np.where(ends > starts, data[np.minimum(np.maximum(ends - 1, 0), max(len(data) - 1, 0))] if len(data) else 0, 0)
    values = {
        "size": np.log1p(size), "words": np.log1p(n_words), "letters": count["letters"] / size, "capitals": count["capitals"] / np.maximum(count["letters"], 1),
        "digits": count["digits"] / size, "stops": count["stops"] / np.maximum(n_words, 1), "shouts": count["shouts"] / np.maximum(n_words, 1), "symbols": count["symbols"] / np.maximum(n_words, 1),
        "word_size": (size - count["blanks"]) / np.maximum(n_words, 1), "short_words": np.bincount(of_line, weights=word_ends - word_starts <= 3, minlength=lines) / np.maximum(n_words, 1),
        "same_bytes": total(same) / size, "same_words": np.bincount(of_line, weights=same_words, minlength=lines) / np.maximum(n_words, 1), "seen_runs": seen_runs, "seen_line": seen_line, "ends_well": np.isin(last, [46, 63, 33]),
    }
    return np.stack([np.asarray(values[m], np.float32) for m in MEASURES], 1), ends - starts, first


@dataclass
class Model:
    edges: np.ndarray  # (measures, BINS - 1): upper edges of bins
    weights: np.ndarray  # (3, measures, BINS + 1): own, previous and next line; the last bin is "no such line"
    links: np.ndarray  # (2, 2) log weights of neighbouring labels, bad = 0, good = 1
    curve: tuple[float, float]


def bins(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e, v, "right") for e, v in zip(edges, values.T, strict=True)], 1)


def potentials(b: np.ndarray, first: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each line, how much more its bins and its neighbours' speak for good than for bad."""
    before, after = neighbours(b, first)
    measures = np.arange(b.shape[1])
    return sum(w[measures, x].sum(1) for w, x in zip(weights, (b, before, after), strict=True))


def neighbours(b: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before, after = np.full_like(b, BINS), np.full_like(b, BINS)
    before[1:], after[:-1] = b[:-1], b[1:]
    before[first[:-1]], after[first[1:] - 1] = BINS, BINS
    return before, after


def marginals(e: np.ndarray, first: np.ndarray, links: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's probability of good; and, for the gradient, forward probabilities and backward ratios.

    All texts step through their lines together, those with most lines first.
    """
    count = np.diff(first)
    order = np.argsort(-count, kind="stable")
    at, count = first[:-1][order], count[order]
    t, up = np.exp(links), np.exp(np.clip(e, -30, 30))
    forward, back = np.empty(len(e)), np.ones(len(e))
    live = len(at)
    for i in range(int(count[0]) if len(count) else 0):
        while count[live - 1] <= i:
            live -= 1
        j = at[:live] + i
        if i:
            p = forward[j - 1]
            odds = up[j] * (p * t[1, 1] + (1 - p) * t[0, 1]) / (p * t[1, 0] + (1 - p) * t[0, 0])
        else:
            odds = up[j]
        forward[j] = odds / (1 + odds)
    for i in range((int(count[0]) if len(count) else 0) - 2, -1, -1):
        while live < len(at) and count[live] > i + 1:
            live += 1
        j = at[:live] + i
        r = up[j + 1] * back[j + 1]
        back[j] = (t[1, 1] * r + t[1, 0]) / (t[0, 1] * r + t[0, 0])
    odds = forward / np.maximum(1 - forward, 1e-14) * back
    return odds / (1 + odds), forward, back


def averages(p: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each text the mean of its lines' probabilities by line length (empty lines count as one byte)."""
    w = size + 1.0
    sums = np.concatenate([[0], np.cumsum(p * w)])
    total = np.concatenate([[0], np.cumsum(w)])
    return (sums[first[1:]] - sums[first[:-1]]) / (total[first[1:]] - total[first[:-1]])


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def train(values: np.ndarray, size: np.ndarray, first: np.ndarray, good: np.ndarray, shares: np.ndarray, steps: int = STEPS) -> Model:
    """Fit by Adam on the log-likelihood of all lines having their document's label, each document counting the same."""
    edges = np.stack([np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1]) for v in values.T])
    b = bins(values, edges)
    shape = (3, b.shape[1], BINS + 1)
    views = (b, *neighbours(b, first))
    flat_index = np.concatenate([np.arange(b.shape[1]) * (BINS + 1) + x + k * b.shape[1] * (BINS + 1) for k, x in enumerate(views)], 1)
    lines = np.diff(first)
    y, weight = np.repeat(good, lines), np.repeat(1 / lines, lines) / len(lines)
    inner = np.ones(len(y), bool)
    inner[first[:-1]] = False
    inner = np.flatnonzero(inner)
    x = np.zeros(int(np.prod(shape)) + 4)
    m, v = np.zeros_like(x), np.zeros_like(x)
    for step in range(1, steps + 1):
        w, links = x[:-4], x[-4:].reshape(2, 2)
        p, forward, back = marginals(w[flat_index].sum(1), first, links)
        miss = (y - p) * weight
        g = np.concatenate([np.bincount(flat_index.ravel(), np.repeat(miss, flat_index.shape[1]), len(w)), np.zeros(4)])
        f, ratio = forward[inner - 1], np.exp(np.clip(w[flat_index[inner]].sum(1), -30, 30)) * back[inner]
        joint = np.stack([(1 - f) * np.exp(links[0, 0]), (1 - f) * np.exp(links[0, 1]) * ratio, f * np.exp(links[1, 0]), f * np.exp(links[1, 1]) * ratio])
        joint /= joint.sum(0)
        there = np.stack([(y[inner] == 0), np.zeros(len(inner)), np.zeros(len(inner)), (y[inner] == 1)])
        g[-4:] = ((there - joint) * weight[inner]).sum(1)
        g -= 1e-4 * x
        g[-4:] -= 1e-2 * x[-4:]  # whole documents share a label; without this the links would decide everything
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = x + 0.1 * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    w, links = x[:-4].reshape(shape), x[-4:].reshape(2, 2)
    score = _logit(averages(marginals(potentials(b, first, w), first, links)[0], size, first))
    a, c, of_class = 1.0, 0.0, np.where(good == 1, shares[1] / max(good.sum(), 1), shares[0] / max((1 - good).sum(), 1))
    for _ in range(50):  # Newton's method on the logistic curve
        q = 1 / (1 + np.exp(-(a * score + c)))
        r = of_class * (q - good)
        h = of_class * q * (1 - q)
        g = np.array([(r * score).sum() + 1e-3 * (a - 1), r.sum() + 1e-3 * c])
        hess = np.array([[(h * score * score).sum() + 1e-3, (h * score).sum()], [(h * score).sum(), h.sum() + 1e-3]])
        step_a, step_c = np.linalg.solve(hess, g)
        a, c = a - np.clip(step_a, -1, 1), c - np.clip(step_c, -1, 1)
    return Model(edges, w, links, (float(a), float(c)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % 3 == HELD_OUT_FOLD


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCUMENTS) -> Model | float:
    """A model of labels.quality; or, if a class is missing, the share of good labels."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r.quality: r["count"] for r in usable.groupBy("quality").count().collect()}
    picked = None
    for q in (0, 1):
        some = usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        picked = some if picked is None else picked.unionByName(some)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, size, first = measure(part)
                edges = first.tolist()
                few = np.flatnonzero(np.diff(first) <= TRAIN_LINES).tolist()
                yield pa.record_batch({"quality": part.column("quality").take(pa.array(few, pa.int64())), "values": pa.array([values[edges[i] : edges[i + 1]].tobytes() for i in few], pa.binary()), "size": pa.array([size[edges[i] : edges[i + 1]].astype(np.int64).tobytes() for i in few], pa.binary())})

    sample = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), "doc_id")  # 2 * most ids
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("quality", "text")).alias("f")).select("f.*")  # one text an id
    rows = sample.select("quality", "text").mapInArrow(lines, "quality int, values binary, size binary").collect()
    good = np.array([r.quality == 1 for r in rows], np.int64)
    if not len(good) or good.all() or not good.any():
        return counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    order = sorted(range(len(rows)), key=lambda i: (rows[i].quality, bytes(rows[i]["values"])))  # any order of tasks gives one model
    values = [np.frombuffer(rows[i]["values"], np.float32).reshape(-1, len(MEASURES)) for i in order]
    size = np.concatenate([np.frombuffer(rows[i]["size"], np.int64) for i in order])
    first = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    total = counts[0] + counts[1]
    shares = np.array([counts[0], counts[1]]) / total * len(good)
    return train(np.concatenate(values), size, first, good[order], shares)


def score(docs: DataFrame, model: Model | float, keep: tuple[str, ...] = ("doc_id",), lines: bool = False) -> DataFrame:
    """The kept columns and each text's score; with lines, also each line's probability of being good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.select(*keep, text_of().alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for part in slices(batch, "__text"):
                values, size, first = measure(pa.record_batch({"text": part.column("__text")}))
                if isinstance(own, float):
                    p, found = np.full(len(size), own), np.full(len(part), own)
                else:
                    p = marginals(potentials(bins(values, own.edges), first, own.weights), first, own.links)[0]
                    a, c = own.curve
                    found = 1 / (1 + np.exp(-(a * _logit(averages(p, size, first)) + c)))
                out = {name: part.column(name) for name in keep} | {"score": pa.array(found)}
                if lines:
                    out["line_scores"] = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(p))
                yield pa.record_batch(out)

    types = dict(columns.dtypes)
    return columns.mapInArrow(run, ", ".join([*(f"`{k}` {types[k]}" for k in keep), "score double", *["line_scores array<double>"] * lines]))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
