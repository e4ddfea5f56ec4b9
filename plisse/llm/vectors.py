"""What the two vector operators share: valid vectors, their Arrow form, and groups too large for one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_valid(name: str) -> Column:
    """Not null, not empty, all components present and finite, not all of them zero."""
    v = F.col(name)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def unit(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that neither very large nor very small components overflow or vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of a list column, for each length of vector in it."""
    sizes = np.diff(np.asarray(column.offsets))
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, matrix(column if len(rows) == len(sizes) else column.take(pa.array(rows)))


def in_blocks(rows: DataFrame, key: str, sizes: DataFrame, cap: int, by: str) -> DataFrame:
    """rows with blocks (1 unless key's group, counted in sizes(key, n), exceeds cap) and block, dealt by a hash of `by`."""
    big = sizes.where(F.col("n") > cap).select(key, F.ceil(F.col("n") / cap).cast("int").alias("blocks"))
    out = rows.join(big, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    return out.withColumn("block", F.pmod(F.xxhash64(by), F.col("blocks")).cast("int"))
