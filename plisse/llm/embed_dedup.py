"""Embedding near-duplicates by a forest of random-projection trees with spill."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, mix, roots, save, table
from .vectors import by_length, in_blocks, is_valid, matrix, unit

COSINE = 0.95
#: Trees; half-width of the spill around a split, for unit vectors; vectors that a leaf should hold; vectors of the bounded
#: sample whose medians place the splits; split directions that the nodes of one level choose from; vectors of one task.
TREES, SPILL, LEAF, SAMPLE, POOL, CAP = 12, 0.012, 160, 8192, 4, 1500
#: Vectors of the sample that make a median.
FEW = 16
SEED = 20


class Forest:
    """Recursive random splits. A node's direction is one of its level's pool, chosen by a hash of the node. Its threshold is
    the median of the sample that reaches it; where fewer than FEW do, the place on its direction of the mean of the sample
    at its last ancestor that had so many. A vector within SPILL of a threshold goes to both sides. The forest's size is
    bounded by the sample, whatever its depth."""

    def __init__(self, depth: int, dim: int, trees: int = TREES, spill: float = SPILL):
        self.depth, self.dim, self.trees, self.spill = depth, dim, trees, spill
        #: Nodes that the sample fits, ascending, their thresholds and means, by tree.
        self.nodes = [np.zeros(0, np.int64)] * trees
        self.cuts = [np.zeros(0)] * trees
        self.means = [np.zeros((0, dim))] * trees

    def directions(self, tree: int, level: int) -> np.ndarray:
        d = np.random.default_rng((SEED, tree, level, self.dim)).standard_normal((self.dim, POOL))
        return d / np.linalg.norm(d, axis=0)

    def fit(self, x: np.ndarray) -> Forest:
        for tree in range(self.trees):
            nodes, cuts, means = [], [], []
            at = np.ones(len(x), np.int64)  # the sample's nodes: paths below a leading 1, split without spill
            for level in range(self.depth):
                own = self._own(x @ self.directions(tree, level), np.arange(len(x)), at, tree)
                order = np.lexsort((own, at))
                uniq, head, n = np.unique(at[order], return_index=True, return_counts=True)
                full = n >= FEW
                uniq, head, n = uniq[full], head[full], n[full]
                if not len(uniq):
                    break
                ranked = own[order]
                cut = (ranked[head + (n - 1) // 2] + ranked[head + n // 2]) / 2
                sums = np.add.reduceat(x[order], np.stack([head, head + n], 1).ravel()[: -1 if head[-1] + n[-1] == len(x) else None], axis=0)[::2]
                nodes.append(uniq)
                cuts.append(cut)
                means.append(sums / n[:, None])
                where = np.minimum(np.searchsorted(uniq, at), len(uniq) - 1)
                inside = uniq[where] == at
                at = np.where(inside, at << 1 | (own >= cut[where]), 0)  # 0: too few, and nothing below either
            if nodes:
                self.nodes[tree], self.cuts[tree], self.means[tree] = np.concatenate(nodes), np.concatenate(cuts), np.concatenate(means)
        return self

    @staticmethod
    def _own(p: np.ndarray, rows: np.ndarray, nodes: np.ndarray, tree: int) -> np.ndarray:
        return p[rows, (mix((nodes | tree << 40).astype(np.uint64)) % np.uint64(POOL)).astype(np.int64)]

    def _walk(self, x: np.ndarray, tree: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, node) of the leaves that rows reach."""
        rows, nodes, last = np.arange(len(x)), np.ones(len(x), np.int64), np.full(len(x), -1, np.int64)
        known, cuts, means = self.nodes[tree], self.cuts[tree], self.means[tree]
        for level in range(self.depth):
            d = self.directions(tree, level)
            own = self._own(x @ d, rows, nodes, tree)
            cut = np.zeros(len(rows))
            if len(known):
                at = np.minimum(np.searchsorted(known, nodes), len(known) - 1)
                fitted = known[at] == nodes
                last = np.where(fitted, at, last)
                cut = np.where(fitted, cuts[at], self._own(means @ d, last, nodes, tree))
            left, right = own < cut + self.spill, own >= cut - self.spill
            child = nodes << 1
            rows, nodes, last = np.concatenate([rows[left], rows[right]]), np.concatenate([child[left], child[right] | 1]), np.concatenate([last[left], last[right]])
        return rows, nodes | tree << 40

    def route(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs over all trees, by row and leaf."""
        parts = [self._walk(x, t) for t in range(self.trees)]
        rows, leaves = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((leaves, rows))
        return rows[order], leaves[order]


def unit_by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    return ((rows, unit(x)) for rows, x in by_length(column))


def _codes(column: pa.Array) -> np.ndarray:
    """The leaves of each row, ascending, filled up with the largest number."""
    n = np.diff(np.asarray(column.offsets))
    codes = np.full((len(n), max(1, n.max(initial=0))), np.iinfo(np.int64).max)
    codes[np.arange(codes.shape[1]) < n[:, None]] = column.flatten().to_numpy()
    return codes


def _leaf_pairs(u: np.ndarray, codes: np.ndarray, block: np.ndarray, here: int, weight: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """For the vectors of one leaf: links counted here, and the label (row) of each one's component within the leaf.

    Of all leaves that a pair shares, only the first counts it, so that each link counts once over all trees. If there are
    two blocks, only pairs across them are looked at. A product in single precision, with a margin for its rounding, finds
    the pairs that can link; the cosine of these is then summed in double precision.
    """
    n, width = codes.shape
    count, label = np.zeros(n, np.int64), np.arange(n)
    two = block.min() != block.max()
    linked_i, linked_j = [], []
    single = u.astype(np.float32)
    for at in range(0, n, 512):
        i, j = np.nonzero(single[at : at + 512] @ single[at:].T >= np.float32(cosine - 1e-4))
        i, j = i + at, j + at
        ok = i < j
        if two:
            ok &= block[i] != block[j]
        i, j = i[ok], j[ok]
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            near = np.einsum("ij,ij->i", u[a], u[b]) >= cosine
            linked_i.append(a[near])
            linked_j.append(b[near])
    i, j = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (linked_i, linked_j))
    for at in range(0, len(i), 50_000):
        a, b = i[at : at + 50_000], j[at : at + 50_000]
        first = np.ones(len(a), bool)
        cb = codes[b]
        for k in range(width):
            ca = codes[a, k]
            before = np.flatnonzero((ca < here) & first)
            if not len(before):
                break  # codes are sorted in each row, so later ones aren't smaller
            first[before] &= ~(cb[before] == ca[before, None]).any(axis=1)
        count += np.bincount(a[first], weights=weight[b[first]], minlength=n).astype(np.int64)
        count += np.bincount(b[first], weights=weight[a[first]], minlength=n).astype(np.int64)
    if len(i):
        nodes, low = roots(i, j)
        label[nodes] = low
    return count, label


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, spill: float = SPILL) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of vectors(vec_id, embedding).

    Equal vectors become one class with a multiplicity first, so copies cost one vector and aren't expanded into pairs. The
    forest is fitted to a bounded sample; every class is routed through it to its leaves, and each leaf compares its
    vectors. A leaf emits counts and one edge to each vector's label, not its pairs. A leaf above CAP vectors is cut into
    blocks whose pairs are compared in separate tasks. Depth follows the number of classes, so leaves keep their size.

    Vectors that are null, empty, zero or hold null or non-finite components, and those with a null vec_id, have no links and
    are their own component. Vectors of different lengths never link. A repeated row is a copy like any other. An empty table
    gives no rows; other columns are ignored.
    """
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    given = given.withColumn("ok", is_valid("embedding") & F.col("vec_id").isNotNull())
    keyed = given.select("vec_id", "embedding", F.when(F.col("ok"), F.xxhash64("embedding")).alias("k1"), F.when(F.col("ok"), F.xxhash64(F.lit(1), "embedding")).alias("k2"))
    classes = keyed.where("k1 is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    classes = save(classes, "vector-classes")
    total = classes.count()
    dims = classes.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    depth = max(0, min(36, math.ceil(math.log2(max(1, total) / LEAF))))
    forests: dict[int, Forest] = {}
    if dims:
        sample = classes.where(F.size("embedding") == dims[0].d).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding").toArrow()
        forests[dims[0].d] = Forest(depth, dims[0].d, trees, spill).fit(unit(matrix(sample.column(0).combine_chunks())))
    kind = classes.schema["embedding"].dataType.simpleString()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                b = batch.slice(at, 4096)
                for rows, u in unit_by_length(b.column("embedding")):
                    forest = forests.setdefault(u.shape[1], Forest(depth, u.shape[1], trees, spill))
                    r, leaf = forest.route(u)
                    yield b, rows[r], leaf

    def count_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, leaf in route(batches):
            leaves, n = np.unique(leaf, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(leaves), pa.array(n.astype(np.int64))], names=["leaf", "n"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows, leaf in route(batches):
            starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1])) if len(rows) else np.zeros(0, np.int64)
            lengths = np.diff(np.append(starts, len(rows)))
            which = np.repeat(np.arange(len(starts)), lengths)
            every = pa.ListArray.from_arrays(pa.array(np.append(starts, len(rows)).astype(np.int32)), pa.array(leaf))
            took = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), took.column("rep"), took.column("copies"), took.column("embedding"), every.take(pa.array(which))], names=["leaf", "rep", "copies", "embedding", "leaves"])

    def compare(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        reps, copies = t.column("rep").to_numpy(), t.column("copies").to_numpy()
        here, p, q = (k.as_py() for k in key)
        block = t.column("block").to_numpy()
        leaves = t.column("leaves")
        codes = _codes(leaves.combine_chunks() if isinstance(leaves, pa.ChunkedArray) else leaves)
        out: list[tuple[np.ndarray, ...]] = []
        for rows, u in unit_by_length(t.column("embedding").chunk(0) if isinstance(t.column("embedding"), pa.ChunkedArray) else t.column("embedding")):
            blocks = block[rows]
            if p != q and blocks.min() == blocks.max():
                continue
            count, label = _leaf_pairs(u, codes[rows], blocks if p != q else np.zeros(len(rows)), here, copies[rows], cosine)
            some = np.flatnonzero((count > 0) | (label != np.arange(len(rows))))
            out.append((reps[rows][some], count[some], reps[rows][label[some]]))
        cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({"rep": pa.array(cols[0]), "links": pa.array(cols[1]), "peer": pa.array(cols[2])})

    sizes = classes.select("embedding").mapInArrow(count_leaves, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n"))
    dealt = classes.select("rep", "copies", "embedding").mapInArrow(deal, f"leaf long, rep long, copies long, embedding {kind}, leaves array<long>")
    dealt = in_blocks(dealt, "leaf", sizes, CAP, "rep")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", other).withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")}).drop("blocks", "other")
    found = save(dealt.groupBy("leaf", "p", "q").applyInArrow(compare, "rep long, links long, peer long"), "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(found.select(F.col("rep").alias("a"), F.col("peer").alias("b")))
    of_class = classes.select("k1", "k2", "rep", "copies").join(links, "rep", "left").join(comps, F.col("rep") == comps["node"], "left")
    of_class = of_class.select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = keyed.select("vec_id", "k1", "k2").join(of_class, ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def op10_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
