"""Operator 11: nearest vectors by multi-index hashing of learned binary codes.

A code has 256 bits: signs of the vectors' coordinates in rotations that iterative quantisation learns on at most
FIT_VECTORS of them. Before that a vector gets one more coordinate, which brings all to the largest norm, so that the order of inner
products is that of angles. Each of the 32 substrings (8 bits) of a code is indexed. If two codes differ in at most R bits, some
substring differs in at most R // 32 (a share of them in one bit less), so probing the values around each of a query's substrings retrieves
every code within R; these are ranked by inner products of the vectors themselves, in double precision.

R is learned: RADIUS_QUERIES query rows are held against all vectors, and R holds the share RECALL of the true neighbours of the
share RECALL of them. Queries for which too few vectors lie within R are searched again without a bound, that is exactly.

Equal vectors are one class: it carries as many of its least ids as a query can want, one more than k, so copies of any number cost nothing and
none is lost. Classes are dealt to blocks of at most BLOCK_ROWS by hash; each block is a multi-index of its own, built by the task that
reads it, and queries stream through it in chunks. A block gives a query at most k + 1 ids, and these are cut again to k + 1 before they
meet. Rows that move: classes once a chunk of CHUNK_ROWS queries, queries once a block.

Vectors that are null, empty, zero, hold a null or non-finite number, or have another length than most, and rows without vec_id, take no
part. Ties: smaller vec_id first. Repeated rows are one row. Rows of one vec_id with different vectors are queries each and never
candidates of each other. Columns besides vec_id and embedding are not read. An empty table, or one vector alone, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.shared import stored

BITS = 256
PARTS = BITS // 8
FIT_VECTORS, FIT_BYTES, FIT_ROUNDS = 8192, 32 << 20, 30
RADIUS_QUERIES, RECALL = 128, 0.95
#: Classes of a block, at most on average and, where tasks are few, at least; queries of a chunk.
BLOCK_ROWS, LEAST_BLOCK, CHUNK_ROWS = 131_072, 8192, 65_536


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part, each once."""
    rows = vectors.where("vec_id IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (length.d if length else 0)).dropDuplicates(["vec_id", "v"])


def classes(rows: DataFrame, ids: int) -> DataFrame:
    """(v, ids): each distinct vector with its least vec_ids, `ids` at most; the others are cut before the shuffle."""
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("place") <= ids)
    return ranked.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows of an array."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Codes:
    """Binary codes by learned rotations."""

    def __init__(self, sample: np.ndarray, largest: float, bits: int = BITS, seed: int = 7):
        self.largest = largest
        x = self.raised(sample)
        rng = np.random.default_rng(seed)
        values, basis = np.linalg.eigh(x.T @ x)
        basis = basis[:, values > values.max() * 1e-9][:, ::-1][:, :bits]
        z, turns = x @ basis, []
        while sum(t.shape[1] for t in turns) < bits:
            turn = np.linalg.qr(rng.normal(size=(z.shape[1], z.shape[1])))[0]
            for _ in range(FIT_ROUNDS):
                left, _, right = np.linalg.svd(np.where(z @ turn > 0, 1.0, -1.0).T @ z)
                turn = (left @ right).T
            turns.append(basis @ turn)
        self.turns = np.hstack(turns)[:, :bits]

    def raised(self, v: np.ndarray) -> np.ndarray:
        """Of norm 1, by one more coordinate."""
        v = v / self.largest
        return np.hstack([v, np.sqrt(np.maximum(0, 1 - (v * v).sum(1, keepdims=True)))])

    def rows(self, v: np.ndarray) -> np.ndarray:
        return np.packbits(self.raised(v) @ self.turns > 0, axis=1)

    def queries(self, v: np.ndarray) -> np.ndarray:
        """Of norm 1, the coordinate that raises the rows being 0."""
        v = v / np.sqrt((v * v).sum(1, keepdims=True))
        return np.packbits(np.hstack([v, np.zeros((len(v), 1))]) @ self.turns > 0, axis=1)


@cache
def ball(radius: int) -> np.ndarray:
    """All bytes of at most `radius` bits, which change a substring by that many."""
    return np.flatnonzero(np.bitwise_count(np.arange(256, dtype=np.uint8)) <= radius).astype(np.int64)


class Index:
    """A block's codes, indexed by each of their substrings."""

    def __init__(self, codes: np.ndarray, radius: int):
        self.n, self.radius = len(codes), radius
        self.words = np.ascontiguousarray(codes).view(np.uint64)
        self.order = np.concatenate([np.argsort(codes[:, j], kind="stable").astype(np.int32) for j in range(PARTS)])
        sizes = np.stack([np.bincount(codes[:, j], minlength=256) for j in range(PARTS)])
        self.starts = np.concatenate([[0], np.cumsum(sizes.ravel())])
        # radius + 1 = whole * PARTS + rest: `rest` substrings are probed to `whole`, the others to one bit less.
        whole, rest = divmod(radius + 1, PARTS)
        self.masks = [ball(whole if j < rest else whole - 1) for j in range(PARTS)]
        self.parts = np.repeat(np.arange(PARTS), [len(m) for m in self.masks])
        self.changes = np.concatenate(self.masks)

    def within(self, code: np.ndarray) -> np.ndarray:
        """The rows of all codes within the radius of this one."""
        at = self.parts * 256 + (code[self.parts] ^ self.changes)
        begin, n = self.starts[at], self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(n)
        hit = np.zeros(self.n, bool)
        hit[self.order[np.repeat(begin - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]] = True
        rows = np.flatnonzero(hit)
        return rows[np.bitwise_count(self.words[rows] ^ code.view(np.uint64)).sum(1, dtype=np.int64) <= self.radius]


def best(v: np.ndarray, rows: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of these rows those whose inner product with the query may be among the k largest, and the products."""
    rough = v[rows] @ query
    if len(rows) > k:  # a product of all rows at once may round otherwise than one of a single row
        rows = rows[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9 * (1 + np.abs(rough).max())]
    return rows, (v[rows] * query).sum(1)


def fit(rows: DataFrame, distinct: DataFrame, every: int, k: int) -> tuple[Codes, int] | None:
    """The codes, and the radius that holds the share RECALL of the true neighbours of that share of some query rows; None without vectors."""
    largest, d = rows.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.max(F.size("v"))).first()
    if not d:
        return None
    by_hash = lambda df, n: np.array([r.v for r in df.orderBy(F.xxhash64("v"), "v").limit(n).select("v").collect()])
    codes = Codes(by_hash(distinct, min(FIT_VECTORS, max(1, FIT_BYTES // (8 * d)))), float(np.sqrt(largest)))
    asked = np.array([r.v for r in rows.where(F.col("vec_id") % every == 0).orderBy(F.xxhash64("vec_id"), "v").limit(RADIUS_QUERIES).select("v").collect()])
    if not len(asked):
        return codes, BITS
    own = codes.queries(asked).view(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column("v"))
            if not len(v):
                continue
            products, words = asked @ v.T, codes.rows(v).view(np.uint64)
            copies = batch.column("ids").value_lengths().to_numpy()
            for i, q in enumerate(asked):
                counts = copies - (v == q).all(1)  # without the query's own row
                top = np.argsort(-products[i], kind="stable")[: k + 1]
                top = np.repeat(top, counts[top])[:k]
                bits = np.bitwise_count(words[top] ^ own[i]).sum(1, dtype=np.int64)
                yield pa.record_batch({"q": pa.array([i] * len(top), pa.int64()), "score": pa.array(products[i, top], pa.float64()), "bits": pa.array(bits)})

    near = distinct.select("v", "ids").mapInArrow(run, "q long, score double, bits long")
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "bits"))).where(F.col("place") <= k)
    own_bits: dict[int, list[int]] = {}
    for r in near.select("q", "bits").collect():  # k for each of the queries asked
        own_bits.setdefault(r.q, []).append(r.bits)
    share = lambda x: sorted(x)[max(0, int(np.ceil(RECALL * len(x))) - 1)]
    return codes, share([share(x) for x in own_bits.values()]) if own_bits else BITS


def search(distinct: DataFrame, queries: DataFrame, n: int, asked: int, codes: Codes, radius: int, ids: int) -> DataFrame:
    """(v, found): for each query vector the `ids` nearest (score, vec_id) among the codes within the radius."""
    spark = distinct.sparkSession
    blocks = max(-(-n // BLOCK_ROWS), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // LEAST_BLOCK)), 1)
    chunks = max(1, -(-asked // CHUNK_ROWS))
    deal = lambda m: F.pmod(F.xxhash64("v"), F.lit(m))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = distinct.select("v", "ids", deal(blocks).cast("int").alias("block"), each(chunks).alias("chunk"))
    right = queries.select("v", F.lit(None).cast("array<long>").alias("ids"), each(blocks).alias("block"), deal(chunks).cast("int").alias("chunk"))
    cells = left.unionByName(right).withColumn("cell", F.col("block") * chunks + F.col("chunk"))
    cells = cells.repartitionById(blocks * chunks, F.col("cell")).sortWithinPartitions("cell", F.col("ids").isNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A cell's rows come before its queries."""
        cell, parts, index, v, members, sizes = None, [], None, None, None, None
        for batch in batches:
            own = batch.column("cell").to_numpy()
            is_row = batch.column("ids").is_valid().to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if own[a] != cell:
                    cell, parts, index = own[a], [], None
                rows = int(is_row[a:b].sum())
                if rows:
                    parts.append(batch.slice(a, rows))
                if rows == b - a or not parts and index is None:
                    continue
                if index is None:
                    v = np.concatenate([matrix(p.column("v")) for p in parts])
                    lists = pa.concat_arrays([p.column("ids") for p in parts])
                    members, sizes = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                    index, parts = Index(codes.rows(v), radius), []
                asked = batch.column("v").slice(a + rows, b - a - rows)
                found = []
                points = matrix(asked)
                for code, q in zip(codes.queries(points), points, strict=True):
                    near, scores = best(v, index.within(code), q, ids)
                    count = sizes[near + 1] - sizes[near]
                    starts = np.repeat(sizes[near] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                    vec_ids, scores = members[starts], np.repeat(scores, count)
                    top = np.lexsort((vec_ids, -scores))[:ids]
                    found.append([{"score": s, "vec_id": i} for s, i in zip(scores[top].tolist(), vec_ids[top].tolist(), strict=True)])
                yield pa.record_batch({"v": asked, "found": pa.array(found, pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64())])))})

    return cells.mapInArrow(run, "v array<double>, found array<struct<score double, vec_id long>>")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    distinct = stored(classes(rows, k + 1), "nearest-classes")
    asked = rows.where(F.col("vec_id") % every == 0)
    queries = stored(asked.groupBy("v").agg(F.lit(1).alias("n")).select("v"), "nearest-queries")
    fitted = fit(rows, distinct, every, k)
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n, total = distinct.count(), queries.count()
    top = Window.partitionBy("v").orderBy(F.desc("score"), "vec_id")

    def merged(found: DataFrame) -> DataFrame:
        each = found.select("v", F.inline("found")).withColumn("place", F.row_number().over(top)).where(F.col("place") <= k + 1)
        lists = each.groupBy("v").agg(F.collect_list(F.struct("place", "vec_id", "score")).alias("found"))
        return stored(lists.select("v", F.sort_array("found").alias("found")), "nearest-found")

    codes, radius = fitted
    first = merged(search(distinct, queries, n, total, codes, radius, k + 1))
    few = queries.join(first.where(F.size("found") > k).select("v"), "v", "left_anti")
    few_n = few.count() if radius < BITS else 0
    if few_n:
        rest = merged(search(distinct, few, n, few_n, codes, BITS, k + 1))
        first = first.where(F.size("found") > k).unionByName(rest)
    others = asked.join(first, "v").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("vec_id")), 1, k).alias("found"))
    return others.select("query_id", F.posexplode("found").alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id"), F.col("x.score"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
