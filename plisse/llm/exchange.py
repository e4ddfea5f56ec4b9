"""Packed arrays dealt by key ranges: a map task sends one binary row for each range instead of a row for each entry."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import only, shuffle_parts, trim

SCHEMA = "part int, payload binary"


def ranges(df: DataFrame) -> int:
    """One range a shuffle partition. A map task sends a row a range each time it flushes what it gathered, not each slice, so
    the rows number tasks times ranges, as the blocks of any shuffle do."""
    return shuffle_parts(df.sparkSession)


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of a 64-bit key, by its high bits."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def pack(columns: list[np.ndarray]) -> bytes:
    return len(columns[0]).to_bytes(8, "little") + b"".join(c.tobytes() for c in columns)


def unpack(payload: bytes, kinds: list[str]) -> list[np.ndarray]:
    n, at, out = int.from_bytes(payload[:8], "little"), 8, []
    for k in kinds:
        d = np.dtype(k)
        out.append(np.frombuffer(payload, d, n, at))
        at += n * d.itemsize
    return out


def split(part: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
        yield int(part[a]), [c[a:b] for c in columns]


def steps(x: np.ndarray) -> bytes:
    """Differences of neighbouring numbers, their bytes by significance: where they ascend slowly most are zero and compress away."""
    return np.ascontiguousarray(np.diff(x, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unsteps(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view("<i8").ravel())


def to_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "payload"])


def batches(rows: Iterable[tuple[int, bytes]], limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Rows (part, payload) in batches of about limit bytes, so that neither side holds more of them at once."""
    held: list[tuple[int, bytes]] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[1])
        if size >= limit:
            yield to_batch(held)
            held, size = [], 0
    if held:
        yield to_batch(held)


def deal(sent: DataFrame, reduce: Callable[[Iterator[tuple[int, Iterator[bytes]]]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Send rows (part, payload) to the tasks of their parts, the part being the task's number; reduce gets each part with its payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((p, x) for b in batches for p, x in zip(b.column("part").to_pylist(), b.column("payload"), strict=True))
        held: list = [next(rows, None)]

        def payloads(part: int) -> Iterator[bytes]:
            while held[0] is not None and held[0][0] == part:
                yield held[0][1].as_py()
                held[0] = next(rows, None)

        def parts() -> Iterator[tuple[int, Iterator[bytes]]]:
            while held[0] is not None:
                part = held[0][0]
                own = payloads(part)
                yield part, own
                for _ in own:
                    pass

        only()
        trim()
        yield from reduce(parts())
        trim()

    return sent.repartitionById(ranges(sent), "part").mapInArrow(run, schema)
