"""Approximate nearest neighbours by cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import save, shuffle_parts, table
from .vectors import by_length, is_valid, matrix, unit

#: Bounds of the number of tables; recall asked for on the sample; vectors of the bounded sample and queries measured on it; vectors,
#: and queries, of one task; neighbours.
LEAST, MOST, RECALL, SAMPLE, TRIALS, CAP, NEAREST = 4, 32, 0.98, 6000, 100, 4000, 10
#: Vectors a bucket, on average, above which a table's hash is made of two rotations instead of one.
CROWDED = 8 * CAP
#: Comparisons with queries that cost as much as sending a vector to one more table.
PER_COPY = 50
SEED = 8


class CrossPolytope:
    """Rotations made of three rounds of random signs and a fast Hadamard transform. A hash of a vector is the signed axis
    nearest to its rotated direction; a bucket is one hash, or one of each of two rotations."""

    def __init__(self, dim: int, hashes: int = 1):
        self.dim, self.hashes, self.size = dim, hashes, 1 << max(1, (dim - 1).bit_length())
        #: Buckets of a table.
        self.buckets = (2 * self.size) ** hashes

    def rotate(self, x: np.ndarray, t: int, k: int = 0) -> np.ndarray:
        y = np.zeros((len(x), self.size))
        y[:, : x.shape[1]] = x
        for signs in np.random.default_rng((SEED, self.dim, t, k)).choice([-1.0, 1.0], (3, self.size)):
            y *= signs
            h = 1
            while h < self.size:
                pair = y.reshape(len(x), -1, 2, h)
                left = pair[:, :, 0] + pair[:, :, 1]
                pair[:, :, 1] = pair[:, :, 0] - pair[:, :, 1]
                pair[:, :, 0] = left
                h *= 2
            y /= np.sqrt(self.size)
        return y

    def _axes(self, x: np.ndarray, t: int, k: int) -> np.ndarray:
        """How near each signed axis is: an axis, or, `size` further, its negative."""
        y = self.rotate(x, t, k)
        return np.concatenate([y, -y], axis=1)

    def place(self, x: np.ndarray, t: int) -> np.ndarray:
        """The bucket of each vector in table t."""
        out = np.zeros(len(x), np.int64)
        for k in range(self.hashes):
            out = out * 2 * self.size + self._axes(x, t, k).argmax(axis=1)
        return out

    def nearness(self, x: np.ndarray, t: int) -> np.ndarray:
        """Of every bucket of table t, the sum of its axes' nearness to each vector."""
        out = self._axes(x, t, 0)
        for k in range(1, self.hashes):
            out = (out[:, :, None] + self._axes(x, t, k)[:, None, :]).reshape(len(x), -1)
        return out

    def probe(self, x: np.ndarray, t: int, probes: int) -> np.ndarray:
        """The buckets of table t that are nearest to each vector."""
        if probes >= self.buckets:
            return np.broadcast_to(np.arange(self.buckets), (len(x), self.buckets))
        step = max(1, (1 << 21) // self.buckets)
        parts = [np.argpartition(-self.nearness(x[at : at + step], t), probes - 1, axis=1)[:, :probes] for at in range(0, len(x), step)]
        return np.concatenate(parts) if parts else np.zeros((0, probes), np.int64)


def nearest_of(q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, id, distance) of the k nearest of x to each query, ties to the smaller id; a query's own id is left out.

    A matrix product finds who can be among them, with a margin for its rounding; their distances are then summed exactly.
    """
    out = []
    xx = (x * x).sum(axis=1)
    for at in range(0, len(q), 256):
        part = q[at : at + 256]
        qq = (part * part).sum(axis=1)
        d2 = qq[:, None] + xx[None, :] - 2 * (part @ x.T)
        d2[ids[None, :] == own[at : at + 256, None]] = np.inf
        if k < len(x):
            d2[d2 > (np.partition(d2, k - 1, axis=1)[:, k - 1] + 1e-9 * (qq + xx.max()))[:, None]] = np.inf
        r, c = np.nonzero(np.isfinite(d2))
        far = np.concatenate([np.sqrt(((x[c[i : i + 65536]] - part[r[i : i + 65536]]) ** 2).sum(axis=1)) for i in range(0, len(r), 65536)]) if len(r) else np.zeros(0)
        order = np.lexsort((ids[c], far, r))
        r, c, far = r[order], c[order], far[order]
        n = np.bincount(r, minlength=len(part))
        best = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n) < k
        out.append((r[best] + at, ids[c[best]], far[best]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def choose(x: np.ndarray, rows: int, queries: int, k: int = NEAREST, recall: float = RECALL, crowded: int = CROWDED) -> tuple[CrossPolytope, int, int]:
    """The index, its tables, and the buckets that a query looks up in each, that reach `recall` on the sample x against brute
    force at the least cost for so many rows and queries.

    For each number of tables the sample tells how many buckets are needed: the recall'th share of its neighbours' ranks, as
    the table that ranks a neighbour's bucket first finds it. With all buckets the search is exact, so there always is such
    a number. In the whole table neighbours are nearer than in a sample of it, so recall is higher there.
    """
    dim = x.shape[1]
    if len(x) <= 2 * k:
        return (one := CrossPolytope(dim)), 1, one.buckets
    trials = np.arange(0, len(x), max(1, len(x) // TRIALS))
    d2 = (x[trials] ** 2).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x[trials] @ x.T
    d2[np.arange(len(trials)), trials] = np.inf
    true = np.argpartition(d2, k, axis=1)[:, :k]
    u = unit(x)
    one = CrossPolytope(dim)
    index = CrossPolytope(dim, 2) if rows > one.buckets * crowded and one.buckets <= 512 else one
    best, rank = None, None
    for t in range(MOST):
        near = index.nearness(u[trials], t)
        bucket = index.place(u[true.ravel()], t).reshape(true.shape)
        own = np.take_along_axis(near, bucket, axis=1)
        mine = np.stack([(near > own[:, j : j + 1]).sum(axis=1) for j in range(k)], axis=1)
        rank = mine if rank is None else np.minimum(rank, mine)
        probes = int(np.sort(rank.ravel())[min(rank.size, int(np.ceil(recall * rank.size))) - 1]) + 1
        cost = (t + 1) * (1 + probes / index.buckets * queries / PER_COPY)
        if t + 1 >= LEAST and (best is None or cost < best[0]):
            best = cost, t + 1, probes
    return index, best[1], best[2]


def nearest(vectors: DataFrame, every: int = 100, k: int = NEAREST, cap: int = CAP, crowded: int = CROWDED) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k nearest found of each row of vectors(vec_id, embedding) whose id is divisible
    by `every`, by Euclidean distance in double precision, ties to the smaller vec_id; candidates are all other ids.

    Every vector is indexed in each table by its direction's bucket; a query looks up several buckets a table, as many as
    choose() finds on a bounded sample. A bucket's vectors and the queries that ask for it meet in one task, which returns at
    most k rows a query; a bucket of more than cap vectors, or queries, is cut into blocks, each of which gets all blocks of
    the other side. A query for which fewer than k are found is compared with all vectors, in blocks. Vectors that are null,
    empty, zero or hold null or non-finite components, or have a null vec_id, take no part. Vectors of different lengths have
    no distance; those of the most frequent length are searched as said, the others' queries look up all buckets. A repeated
    row counts once. An empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(is_valid("embedding") & F.col("vec_id").isNotNull())
    asks = F.col("vec_id") % every == 0
    dims = v.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n"), F.count_if(asks).alias("q")).orderBy(F.desc("n"), "d").limit(1).collect()
    schema = "query_id long, vec_id long, score double"
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = dims[0].d
    sample = v.where(F.size("embedding") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    index, tables, probes = choose(matrix(sample.column(0).combine_chunks()), dims[0].n, dims[0].q, k, crowded=crowded)
    kind = v.schema["embedding"].dataType.simpleString()

    def found_in(b: pa.RecordBatch, asked: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, buckets) of a batch's vectors; a bucket's number also tells the vector's length and the table."""
        for rows, x in by_length(b.column("embedding")):
            d = x.shape[1]
            own = index if d == dim else CrossPolytope(d)
            for t in range(tables if d == dim else 1):
                n = (probes if d == dim else own.buckets) if asked else 1
                at = own.probe(unit(x), t, n) if asked else own.place(unit(x), t)[:, None]
                yield np.repeat(rows, n), at.ravel() | (t << 24) | (d << 32)

    def place(asked: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    b = batch.slice(at, 1024)
                    for rows, bucket in found_in(b, asked):
                        took = b.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([pa.array(bucket), took.column("vec_id"), took.column("embedding")], names=["bucket", "vec_id", "embedding"])

        return run

    def count(asked: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 1024):
                    for _, bucket in found_in(batch.slice(at, 1024), asked):
                        which, n = np.unique(bucket, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(n)], names=["bucket", "n"])

        return run

    def blocks(rows: DataFrame, asked: bool, name: str) -> DataFrame:
        """(bucket, blocks) of the buckets that need more than one, by counts that each task adds up."""
        n = rows.select("embedding").mapInArrow(count(asked), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        return n.where(F.col("n") > cap).select("bucket", F.ceil(F.col("n") / cap).cast("int").alias(name))

    def meet(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _meet(left, right, k)

    queries = v.where(asks)
    big = save(blocks(v, False, "vs").join(blocks(queries, True, "qs"), "bucket", "full"), "nearest-blocks")
    placed = f"bucket long, vec_id long, embedding {kind}"
    one, asked = v.mapInArrow(place(False), placed), queries.mapInArrow(place(True), placed)
    if not big.isEmpty():
        one, asked = one.join(big, "bucket", "left"), asked.join(big, "bucket", "left")
    else:
        one, asked = (d.withColumns({"vs": F.lit(1), "qs": F.lit(1)}) for d in (one, asked))
    n = {c: F.coalesce(c, F.lit(1)) for c in ("vs", "qs")}
    part = lambda c: F.pmod(F.xxhash64("vec_id"), n[c]).cast("int")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), n[c] - 1))
    one = one.select("bucket", "vec_id", "embedding", part("vs").alias("vb"), all_of("qs").alias("qb"))
    asked = asked.select("bucket", "vec_id", "embedding", all_of("vs").alias("vb"), part("qs").alias("qb"))
    keys = ("bucket", "vb", "qb")
    found = one.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, schema)
    found = save(_top(found, k), "nearest")
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("query_id")
    short = queries.where(F.size("embedding") == dim).join(enough, queries["vec_id"] == enough["query_id"], "left_anti")
    short = save(short.withColumn("rows", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.lit(0)))).where("rows = 1").drop("rows"), "nearest-short")
    if not short.isEmpty():
        parts = max(shuffle_parts(spark), math.ceil(dims[0].n / cap))
        held = v.where(F.size("embedding") == dim).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
        spread = short.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        rest = held.groupBy("block").cogroup(spread.groupBy("block")).applyInArrow(meet, schema)
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").select("query_id", "vec_id", "score").union(_top(rest, k).select("query_id", "vec_id", "score"))
    return _top(found.select("query_id", "vec_id", "score"), k).select("query_id", "rank", "vec_id", "score")


def _top(found: DataFrame, k: int) -> DataFrame:
    """Each query's k nearest with their ranks: pre-aggregated, as what a task finds of a query is at most k rows of it."""
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")).groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("top"))
    return best.select("query_id", F.posexplode("top").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def _meet(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    cols = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    if len(left) and len(right):
        left, right = left.combine_chunks(), right.combine_chunks()
        # Equal ids are one candidate, and one query.
        ids, first = np.unique(left.column("vec_id").to_numpy(), return_index=True)
        own, asks = np.unique(right.column("vec_id").to_numpy(), return_index=True)
        x, q = (matrix(_one(t.column("embedding")))[rows] for t, rows in ((left, first), (right, asks)))
        r, who, far = nearest_of(q, x, ids, own, k)
        cols = [own[r], who, far]
    return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})


def _one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
