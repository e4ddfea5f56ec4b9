"""Shared folder, materialised tables, Arrow slicing and connected components for the corpus operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, only where it is unset, an own one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='plisse-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, scratch: list[str] | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it: lineage ends there, and a lost executor costs nothing.

    Spark is told to delete the shuffle files of this one write when it is done, as nothing reads them again. The table's path
    is added to scratch, for drop().
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    if scratch is not None:
        scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, scratch: list[str]) -> None:
    """Delete tables of save() that no later step reads."""
    jvm = spark._jvm
    for path in scratch:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    scratch.clear()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it none of df's columns (Spark minds no case) and none given before."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def widened(df: DataFrame, *more: tuple[str, str]) -> StructType:
    """df's schema with more fields (name, type)."""
    return StructType([*df.schema.fields, *(StructField(n, _parse_datatype_string(t)) for n, t in more)])


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_lengths(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def trim() -> None:
    """Give freed memory back to the system: a Python worker outlives its tasks, and the next stage's need the room."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and trim() once it has ended and let go of what it held: the worker may wait long for its next task."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return outer


_caches: list[dict] = []


def cache() -> dict:
    """A memory of a Python worker that outlives its tasks, until one of another operator runs there."""
    _caches.append({})
    return _caches[-1]


def only(*own: dict) -> None:
    """Empty the memories of all operators but these: a worker runs the tasks of one after the other."""
    for c in _caches:
        if c and not any(c is x for x in own):
            c.clear()


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most limit bytes of text, so that memory follows the slice; a longer text stands alone."""
    trim()
    for batch in batches:
        ends = np.cumsum(byte_lengths(batch.column(column)))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, stop - at)
            at = stop
    trim()


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array of UTF-8 bytes, and where each starts and the last one ends; null is an empty text."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(texts) else raw[:0], offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes start, start+1, ... of many runs, one run after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total, dtype=np.int64)


_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: Edges (16 bytes each) that one task may join by itself.
ALONE = 1 << 20


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges a-b, ascending, and the smallest node of each one's component.

    In each round every root with an edge to a smaller one is hung below the smallest of these, so the roots of a component
    halve at least.
    """
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    up = np.arange(len(nodes))
    while True:
        x, y = up[i], up[j]
        apart = x != y
        if not apart.any():
            return nodes, nodes[up]
        i, j, x, y = i[apart], j[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while (up[up] != up).any():
            up = up[up]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (component, node) of a task's edges instead of these, ALONE of them at a time; a node that is smallest has none."""

    def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        nodes, low = roots(t.column("a").to_numpy(), t.column("b").to_numpy())
        own = nodes != low
        return pa.RecordBatch.from_arrays([pa.array(low[own]), pa.array(nodes[own])], names=["a", "b"])

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= ALONE:
            yield out(held)
            held, size = [], 0
    if held:
        yield out(held)


def components(edges: DataFrame, name: str = "cc", scratch: list[str] | None = None, alone: int = ALONE) -> DataFrame:
    """Connected components of edges(a long, b long): rows (node, component), the component being its smallest node.

    Each task first replaces its edges by those of a forest. If at most `alone` are left, one task joins them. Otherwise
    alternating large-star and small-star rounds do (Kiveris et al. 2014): every round is a few shuffles of the edges, rounds
    grow with the logarithm of a component's size, and nothing is gathered on the driver but two counters a round. Both ways
    give the same result. Nodes without an edge aren't in it; self-loops are ignored. The neighbours of one node are never
    put in one task's list: the minimum is an aggregate and the neighbours are joined to it, which adaptive execution may
    split.
    """
    spark, own, schema = edges.sparkSession, [], "a long, b long"
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").mapInArrow(_contract, schema)
    e = save(e, name, own)
    if e.count() <= alone:
        e = save(e.coalesce(1).mapInArrow(_contract, schema), name, scratch)
        drop(spark, own)
    else:
        e, last = save(e.distinct(), name, own), None
        for _ in range(64):
            # Large star: each node's larger neighbours go to the smallest of its neighbourhood.
            both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
            big = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
            # Small star: each node and its smaller neighbours go to the smallest of them.
            down = big.select(F.col("b").alias("n"), F.col("a").alias("s"))
            least = down.groupBy("n").agg(F.min("s").alias("m"))
            small = down.join(least, "n").select(F.col("m").alias("a"), F.col("s").alias("b")).union(least.select(F.col("m").alias("a"), F.col("n").alias("b")))
            path: list[str] = []
            e = save(small.where("a < b").distinct(), name, path)
            drop(spark, own)
            own = path
            state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if state == last:
                break
            last = state
        if scratch is not None:
            scratch += own
    return e.select(F.col("b").alias("node"), F.col("a").alias("component")).union(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
