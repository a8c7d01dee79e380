"""Operator 2: near-duplicates by BagMinHash signatures, banding and verified multiset overlap.

A text is the bag of its runs of five words (a text of fewer words is compared as a whole). Signatures: each run with
each dyadic interval of its count, (0, 1], (1, 2], (2, 4], ..., has a Poisson process of the interval's length; each of
its points has a random register and, by halving the interval again and again, a unit level, and counts if the level is
within the run's count. A register keeps its earliest point. Two texts agree in a register with the probability of their
weighted Jaccard similarity. Points after the time at which all registers are filled are never made, so most runs cost
one hash.

Rows of one word sequence are one node, whatever their doc_ids. Nodes that share a band are candidates if their registers
agree in LEAST_AGREEMENT at least; candidates are verified on the bags themselves. Small bands give all their pairs. A
large band is first joined up cheaply: each node is held against the band's smallest node and against those few that agree
with it in most registers. This is no cap, as each large band whose nodes are not yet in one class is then settled: a pair
inside a class can add nothing, so every node outside the band's most common class is held against all others, in cells of
a block of nodes by a block of nodes. A cell has the nodes' runs as 16-bit hashes, which never make a similarity smaller, and
gives the links that join its classes up, at most one for each class. Should one of these fail on the bags themselves, its
band is settled once more with 64-bit hashes of the runs, as the bags have them, so that links are true ones; again a cell gives at
most one for each class. So of the pairs that share a band and agree none is left out, each is looked at in the
first band that it shares, and rows grow with the nodes and not with their pairs.

A pair of similarity 0.8 shares no band with probability 2e-4, and agrees in less than LEAST_AGREEMENT with 2e-6.

Classes are connected components of the verified links.

Null text: as empty; empty texts are one class. Null doc_id: returned with null class_id. Ties and repeated rows: equal
word sequences share a class; the class id is its least doc_id. A doc_id with several texts: each text is in a class of its
own right, and each row has its text's class. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.shared import MULT, PRIME, U64, flat, mix, salted, shingles, slices, span_hashes, stored, text_of, words

SHINGLE = 5
SIMILARITY = 0.8
ROWS = 6
BANDS = 28
REGISTERS = ROWS * BANDS
#: A group of at most so many nodes gives all its pairs; of larger ones each node first gives its NEAREST by registers,
#: among CHUNK nodes of the group at a time.
SMALL_GROUP = 6
NEAREST = 3
#: Nodes, and runs, that a block of a large group is meant to hold.
CHUNK = 1024
BLOCK_RUNS = 1 << 20
#: Bits of a run's hash when a large group is first settled, 16 at most.
SHORT_BITS = 16
#: Pairs whose registers agree less than this are not verified; similar ones agree in 0.8, with a deviation of 0.031.
LEAST_AGREEMENT = 0.65
#: Rows of three numbers that may be sent to all executors (some 50 MB).
BROADCAST_ROWS = 1 << 20


def bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of each text: text, run hash, count; and two hashes of each text's whole word sequence."""
    starts, ends, bounds = words(data, offsets)
    hashes = span_hashes(data, starts, ends)
    runs, at = shingles(hashes, bounds, SHINGLE)
    owner = np.searchsorted(bounds, at, "right") - 1
    order = np.lexsort((runs, owner))
    owner, runs = owner[order], runs[order]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:] != runs[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(runs)))
    whole = [whole_hash(salted(hashes, salt), bounds) for salt in (1, 2)]
    return owner[first], runs[first], counts, whole[0], whole[1]


def whole_hash(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of the sequence of hashes between bounds."""
    n = len(bounds) - 1
    count = np.diff(bounds)
    place = np.arange(len(hashes)) - np.repeat(bounds[:-1], count)
    terms = mix(hashes + mix(place.astype(U64) * MULT + PRIME))
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(terms, dtype=U64)])
    return mix(sums[bounds[1:]] - sums[bounds[:-1]] + count.astype(U64) * MULT).reshape(n)


def _unit(x: np.ndarray) -> np.ndarray:
    return ((x >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def signatures(owner: np.ndarray, runs: np.ndarray, counts: np.ndarray, texts: int, registers: int = REGISTERS) -> np.ndarray:
    """(texts, registers) of 64-bit point names; texts without runs have zeros."""
    best = np.full(texts * registers, np.inf)
    name = np.zeros(texts * registers, U64)
    total = np.bincount(owner, counts, texts)
    horizon = np.where(total > 0, registers * (np.log(registers) + 3) / np.maximum(total, 1), 0)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        of = np.flatnonzero(np.isin(owner, todo)) if len(todo) < texts else np.arange(len(owner))
        level = 0
        while len(of):
            length = 1 if level < 2 else 1 << (level - 1)
            low = 0 if level == 0 else 1 << (level - 1)
            of = of[counts[of] > low]
            if len(of):
                _points(of, level, low, length, owner, runs, counts, horizon, best, name, registers)
            level += 1
        empty = np.isinf(best.reshape(texts, registers)).any(1)
        todo = todo[empty[todo]]
        horizon[todo] *= 2  # the same points again, and those after them
    return name.reshape(texts, registers)


def _points(of, level, low, length, owner, runs, counts, horizon, best, name, registers) -> None:
    """Enter the points of one dyadic interval of these runs, up to their texts' horizons."""
    seed = salted(runs[of], 101 + level)
    until, time, step = horizon[owner[of]], np.zeros(len(of)), 0
    live = np.arange(len(of))
    while len(live):
        h = salted(seed[live], 1000 + step)
        time[live] -= np.log(_unit(h)) / length
        live = live[time[live] <= until[live]]
        if not len(live):
            return
        g = salted(seed[live], 500_000 + step)
        # The low bits halve the interval down to a unit; the high bits choose the register.
        unit = low + 1 + (g & U64(length - 1)).astype(np.int64)
        key = owner[of[live]] * registers + ((g >> U64(32)) % U64(registers)).astype(np.int64)
        ok = unit <= counts[of[live]]
        key, t, points = key[ok], time[live][ok], mix(g[ok] ^ runs[of[live]][ok])
        np.minimum.at(best, key, t)
        won = t == best[key]
        name[key[won]] = points[won]
        step += 1


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of two bags (sorted distinct hashes, counts)."""
    both, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    inner = int(np.minimum(a[1][i], b[1][j]).sum())
    return inner / max(1, int(a[1].sum() + b[1].sum()) - inner)


def _features(docs: DataFrame) -> DataFrame:
    """doc_id, version, two hashes of the word sequence, number of runs, band keys and one byte of each register."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, offsets = flat(part.column("text"))
                owner, runs, counts, h1, h2 = bags(data, offsets)
                n = len(part)
                names = signatures(owner, runs, counts, n)
                size = np.bincount(owner, counts, n).astype(np.int64)
                keys = np.zeros((n, BANDS), U64)
                for r in range(ROWS):
                    keys = mix(keys * PRIME + names[:, r::ROWS])
                keys = mix(keys ^ (np.arange(1, BANDS + 1, dtype=U64) * MULT))
                keys = keys[np.repeat(np.arange(n), np.where(size > 0, 1, 0))]
                ends = np.concatenate([[0], np.cumsum(np.where(size > 0, BANDS, 0))])
                yield pa.record_batch({
                    "doc_id": part.column("doc_id"), "version": part.column("version"), "h1": pa.array(h1.view(np.int64)), "h2": pa.array(h2.view(np.int64)), "size": pa.array(size),
                    "bands": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel().view(np.int64))),
                    "registers": pa.array([x.tobytes() for x in (names & U64(255)).astype(np.uint8)], pa.binary()),
                })

    return rows_of(docs).mapInArrow(run, "doc_id long, version long, h1 long, h2 long, size long, bands array<long>, registers binary")


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, version (a hash of the text, as a doc_id may have several) and text of the rows that have a doc_id."""
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return docs.select("doc_id", F.xxhash64("text").alias("version"), "text")


def _groups(rows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows (key, node, size) the pairs (pivot, node) worth verifying, and the rows (key, node, size) of large groups."""
    rows = stored(rows, "groups", compression="zstd")
    stats = rows.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("size", "node")).alias("least")).where("n > 1")
    held = stored(rows.join(stats, "key"), "held", compression="zstd")
    small = held.where(F.col("n") <= SMALL_GROUP).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("size", "node"))).alias("all"))  # at most SMALL_GROUP each
    pairs = small.select("all", F.posexplode("all").alias("i", "first")).select("first", F.explode(F.slice("all", F.col("i") + 2, SMALL_GROUP)).alias("second"))
    pairs = pairs.select(F.col("first.node").alias("pivot"), F.col("second.node").alias("node"))
    large = held.where(F.col("n") > SMALL_GROUP)
    stars = large.where(F.col("node") != F.col("least.node")).select(F.col("least.node").alias("pivot"), "node")

    def nearest(table: pa.Table) -> pa.Table:
        """Of each node the NEAREST others that agree with it in most registers."""
        nodes = table.column("node").to_numpy()
        x = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint8).reshape(len(nodes), -1)
        found = set()
        for i in range(len(nodes)):
            agree = (x == x[i]).sum(1)
            agree[i] = -1
            for j in np.argpartition(-agree, min(NEAREST, len(nodes) - 1))[:NEAREST].tolist():
                if agree[j] >= LEAST_AGREEMENT * x.shape[1]:
                    found.add((int(min(nodes[i], nodes[j])), int(max(nodes[i], nodes[j]))))
        return pa.table({"pivot": pa.array([p for p, _ in found], pa.int64()), "node": pa.array([n for _, n in found], pa.int64())})

    chunk = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / CHUNK))
    dealt = large.select("key", "node", chunk.alias("chunk")).join(nodes.select("node", "registers"), "node")
    near = dealt.groupBy("key", "chunk").applyInArrow(nearest, "pivot long, node long")
    return pairs.unionByName(near).unionByName(stars).where("pivot <> node").distinct(), large.select("key", "node", "size")


def _packed(texts: DataFrame, wide: bool) -> DataFrame:
    """(node, bag): the runs of each text as sorted hashes of 16 bits, or 64 if wide; a run that occurs n times gives n of them."""
    bits = SHORT_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                owner, runs, counts, _, _ = bags(*flat(part.column("text")))
                turn = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                short = mix(np.repeat(runs, counts) + turn.astype(U64) * MULT) & (U64(2 ** (64 if wide else bits) - 1))
                whose = np.repeat(owner, counts)
                order = np.lexsort((short, whose))
                short, edges = short[order].astype("<u8" if wide else "<u2"), np.searchsorted(whose, np.arange(len(part) + 1)).tolist()
                yield pa.record_batch({"node": part.column("node"), "bag": pa.array([short[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())})

    return texts.select("node", "text").mapInArrow(run, "node long, bag binary")


def _unsettled(large: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (key, node, size) of large groups with several classes, with the node's class, whether that is another than the
    group's most common one, and in how many blocks the group's nodes and those other ones are dealt."""
    known = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    held = known.groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("runs"))
    groups = held.groupBy("key").agg(F.sum("n").alias("n"), F.sum("runs").alias("runs"), F.count("*").alias("classes"), F.max(F.struct("n", "root", "runs")).alias("most")).where("classes > 1")
    blocks = F.greatest(F.ceil(F.col("n") / CHUNK), F.ceil(F.col("runs") / BLOCK_RUNS))
    outers = F.greatest(F.ceil((F.col("n") - F.col("most.n")) / CHUNK), F.ceil((F.col("runs") - F.col("most.runs")) / BLOCK_RUNS))
    known = known.join(groups.select("key", blocks.alias("blocks"), outers.alias("outers"), F.col("most.root").alias("most")), "key")
    return stored(known.select("key", "node", "size", "root", (F.col("root") != F.col("most")).alias("outer"), "blocks", "outers"), "unsettled", compression="zstd")


def _links_between(known: DataFrame, sketches: DataFrame, wide: bool) -> DataFrame:
    """(key, pivot, node) of pairs of _unsettled rows whose packed bags are similar: as many as join all classes of a cell up."""
    # A cell holds a block of all nodes and a block of the outer ones: nodes go to each block of outer ones, and these to each block.
    rows = known.withColumn("block", F.pmod(F.xxhash64("node", "key"), F.col("blocks"))).withColumn("outer_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("outers") - 1)))
    asking = known.where("outer").withColumn("outer_block", F.pmod(F.xxhash64("key", "node"), F.col("outers"))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    columns = ("key", "block", "outer_block", "node", "size", "root", "outer")
    cells = rows.select(*columns, F.lit(False).alias("asks")).unionByName(asking.select(*columns, F.lit(True).alias("asks"))).join(sketches, "node")

    def compare(table: pa.Table) -> pa.Table:
        asks, node, size, root, outer = (table.column(c).to_numpy() for c in ("asks", "node", "size", "root", "outer"))
        x = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint8).reshape(len(node), -1)
        bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
        bags_ = table.column("bag").to_pylist()
        each = 8 if wide else 2
        runs = np.frombuffer(b"".join(bags_), f"<u{each}")
        runs = runs if wide else runs.astype(np.int64)
        ends = np.cumsum([len(b) // each for b in bags_])
        starts = ends - np.array([len(b) // each for b in bags_])
        new = np.ones(len(runs), bool)
        new[1:] = runs[1:] != runs[:-1]
        new[starts] = True
        turn = np.arange(len(runs)) - np.maximum.accumulate(np.where(new, np.arange(len(runs)), 0))
        own, key = np.flatnonzero(~asks), table.column("key")[0].as_py()
        found: list[tuple[float, int, int]] = []
        for i in np.flatnonzero(asks).tolist():
            # Of two outer nodes, the one of the lower number asks.
            hit = own[(root[own] != root[i]) & ~(outer[own] & (node[own] < node[i])) & (np.minimum(size[own], size[i]) >= SIMILARITY * np.maximum(size[own], size[i]) - 1e-6)]
            hit = hit[(x[hit] == x[i]).sum(1) >= LEAST_AGREEMENT * x.shape[1]]
            earlier = int(np.argmax(bands[i] == key))
            hit = hit[~(bands[hit, :earlier] == bands[i, :earlier]).any(1)]  # those are looked at in that band
            if not len(hit):
                continue
            mine, n = runs[starts[i] : ends[i]], ends[hit] - starts[hit]
            at = np.repeat(starts[hit] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            if wide:
                shared = mine[np.minimum(np.searchsorted(mine, runs[at]), len(mine) - 1)] == runs[at]
            else:
                shared = np.bincount(mine, minlength=1 << 16)[runs[at]] > turn[at]
            both = np.add.reduceat(shared.astype(np.int64), np.cumsum(n) - n)
            share = both / (size[hit] + size[i] - both)
            hit, share = hit[share >= SIMILARITY], share[share >= SIMILARITY]
            order = np.lexsort((-share, root[hit]))  # the most similar one of each class
            first = order[np.unique(root[hit][order], return_index=True)[1]]
            hit, share = hit[first], share[first]
            found += [(s, i, j) for s, j in zip(share.tolist(), hit.tolist(), strict=True)]
        kept = spanning(found, root)
        return pa.table({"key": pa.array([key] * len(kept), pa.int64()), "pivot": pa.array([int(min(node[i], node[j])) for _, i, j in kept], pa.int64()), "node": pa.array([int(max(node[i], node[j])) for _, i, j in kept], pa.int64())})

    return cells.groupBy("key", "block", "outer_block").applyInArrow(compare, "key long, pivot long, node long")


def spanning(found: list[tuple[float, int, int]], root: np.ndarray) -> list[tuple[float, int, int]]:
    """Of links (similarity, i, j) those, most similar first, that join two classes not yet joined."""
    up: dict[int, int] = {}

    def top(r: int) -> int:
        while up.setdefault(r, r) != r:
            up[r] = r = up[up[r]]
        return r

    kept = []
    for link in sorted(found, reverse=True):
        a, b = top(int(root[link[1]])), top(int(root[link[2]]))
        if a != b:
            up[a] = b
            kept.append(link)
    return kept


def _agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose registers agree often enough to be worth verifying."""
    a = nodes.select("node", F.col("registers").alias("x"))
    b = nodes.select(F.col("node").alias("pivot"), F.col("registers").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("x", "y"))
                yield batch.select(["node", "pivot"]).filter(pa.array((x == y).mean(1) >= LEAST_AGREEMENT))

    return pairs.join(a, "node").join(b, "pivot").select("node", "pivot", "x", "y").mapInArrow(run, "node long, pivot long")


def few(rows: DataFrame) -> DataFrame:
    """A stored table of three numbers a row, to be broadcast if it has at most BROADCAST_ROWS."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _texts(docs: DataFrame, heads: DataFrame, needed: DataFrame) -> DataFrame:
    """(node, text) of the nodes needed. Their number is checked: of BROADCAST_ROWS at most they are sent to all texts, and of
    more the texts are shuffled."""
    wanted = few(stored(heads.join(needed.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "version"), "wanted"))
    return rows_of(docs).join(wanted, ["doc_id", "version"]).dropDuplicates(["doc_id", "version"]).select("node", "text")


def _verify(asked: DataFrame, docs: DataFrame, heads: DataFrame) -> DataFrame:
    """(node, pivot, similar) of all pairs."""
    texts = _texts(docs, heads, asked.select("node").union(asked.select("pivot")))
    a, b = texts.select("node", F.col("text").alias("x")), texts.select(F.col("node").alias("pivot"), F.col("text").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple] = {}  # pivots, as one is compared many times in a row
        for batch in batches:
            for part in slices(batch, "x"):
                data, offsets = flat(part.column("x"))
                owner, runs, counts, _, _ = bags(data, offsets)
                edges = np.searchsorted(owner, np.arange(len(part) + 1)).tolist()
                out = []
                for i, (node, pivot) in enumerate(zip(*(part.column(c).to_pylist() for c in ("node", "pivot")), strict=True)):
                    own = runs[edges[i] : edges[i + 1]], counts[edges[i] : edges[i + 1]]
                    if pivot not in kept:
                        if len(kept) > 64:
                            kept.clear()
                        _, r, n, _, _ = bags(*flat(part.column("y").slice(i, 1).cast(pa.large_string())))
                        kept[pivot] = r, n
                    out.append((node, pivot, similarity(own, kept[pivot]) >= SIMILARITY))
                yield pa.record_batch({"node": pa.array([o[0] for o in out], pa.int64()), "pivot": pa.array([o[1] for o in out], pa.int64()), "similar": pa.array([o[2] for o in out], pa.bool_())})

    return stored(asked.select("node", "pivot").distinct().join(a, "node").join(b, "pivot").select("node", "pivot", "x", "y").mapInArrow(run, "node long, pivot long, similar boolean"), "verified", compression="zstd")


def _joined(verified: DataFrame) -> DataFrame:
    return verified.where("similar").select(F.col("node").alias("a"), F.col("pivot").alias("b"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, version, class_id (the least doc_id of its class), node and class_node: numbers of its word sequence and of
    its class in this run."""
    features = stored(_features(docs), "signatures")
    heads = features.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "version")).alias("f")).select("h1", "h2", "f.*")
    heads = stored(heads.withColumn("node", F.monotonically_increasing_id()), "heads")
    members = features.select("doc_id", "version", "h1", "h2").join(heads.select("h1", "h2", "node", F.col("doc_id").alias("head")), ["h1", "h2"])
    members = stored(members.select("doc_id", "version", "node", "head"), "members")
    keys = ["doc_id", "version"]
    nodes = features.where("size > 0").drop("h1", "h2").join(heads.select(*keys, "node"), keys).dropDuplicates(keys)
    nodes = stored(nodes.select("node", "size", "bands", "registers"), "nodes")

    pairs, large = _groups(nodes.select(F.explode("bands").alias("key"), "node", "size"), nodes)
    roots = components(_joined(_verify(stored(_agreeing(pairs, nodes), "asked"), docs, heads)))
    # Large bands that are not in one class yet: what joins their classes up.
    for wide in (False, True):
        known = _unsettled(large, roots)
        if known.isEmpty():
            break
        held = few(stored(known.select("node").distinct(), "held-nodes"))
        sketches = nodes.select("node", "registers", "bands").join(held, "node", "left_semi").join(_packed(_texts(docs, heads, known), wide), "node")
        sketches = stored(sketches, "sketches")
        asked = stored(_links_between(known, sketches, wide), "asked")
        if asked.isEmpty():
            break
        verified = _verify(asked, docs, heads)
        roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_joined(verified)))
        failed = verified.where("NOT similar")
        if failed.isEmpty():
            break
        large = large.join(stored(asked.join(failed, ["node", "pivot"], "left_semi").select("key").distinct(), "again"), "key", "left_semi")
    linked = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct()).join(heads.select("node", "doc_id"), "node")
    named = linked.join(linked.groupBy("root").agg(F.min("doc_id").alias("class_id")), "root").select("node", "root", "class_id")
    found = members.join(named, "node", "left").select(*keys, F.coalesce("class_id", "head").alias("class_id"), "node", F.coalesce("root", "node").alias("class_node"))
    none = F.lit(None).cast("long")
    return found.unionByName(docs.where(F.col("doc_id").isNull()).select(*(none.alias(c) for c in found.columns)))


def kept(docs: DataFrame) -> DataFrame:
    """Of each class one row, that of the least doc_id (of several texts of it, the one of the least hash), with all its
    columns; and all rows without doc_id."""
    first = classes(docs).where(F.col("doc_id").isNotNull()).groupBy("class_node").agg(F.min(F.struct("doc_id", "version")).alias("f")).select("f.*")
    rows = docs.where(F.col("doc_id").isNotNull()).withColumn("__id", F.col("doc_id").cast("long")).withColumn("__version", F.xxhash64(text_of()))
    first = first.select(F.col("doc_id").alias("__id"), F.col("version").alias("__version"))
    rows = rows.join(first, ["__id", "__version"], "left_semi").dropDuplicates(["__id", "__version"]).select(docs.columns)
    return rows.unionByName(docs.where(F.col("doc_id").isNull()))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("keep"))
