"""XXH3 hashes, which Spark lacks: Arrow batches, nothing row by row on the JVM side."""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType


@F.arrow_udf(ArrayType(StringType()))
def _checksums(raw: pa.Array) -> pa.Array:
    return pa.array([None if x is None else [None if a is None else f"{xxhash.xxh3_64_intdigest(a) & 0xFFFF:04x}" for a in x] for x in raw.to_pylist()], pa.list_(pa.string()))


@F.arrow_udf(StringType())
def _ids(raw: pa.Array) -> pa.Array:
    return pa.array([None if x is None else f"{xxhash.xxh3_128_hexdigest(x)}:{len(x)}" for x in raw.to_pylist()], pa.string())


def marker_checksums(raw: Column) -> Column:
    """Of an array of bytes, the low 16 bits of each one's 64-bit hash, as four hexadecimal digits."""
    return _checksums(raw)


def restore_id(raw: Column) -> Column:
    """128-bit hash and length of some bytes: 32 hexadecimal digits, a colon, the length."""
    return _ids(raw)
