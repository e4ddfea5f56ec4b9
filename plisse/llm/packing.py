"""Sum-of-squares online packing of tokenised documents into windows."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import word_tokens
from .common import slices, table, trim

WINDOW = 4096
END_ID = 2
#: Windows that a task holds open at most.
OPEN = 32


class SumOfSquares:
    """Places pieces (document, start, size) one at a time into windows of fixed size.

    level[h] counts the open windows filled to h. A piece of size s goes to the fill level h (0: a new window) for which the
    sum of the squares of the counts after it is least; ties go to the fullest. A window that is exactly full is closed. When
    `most` windows are open and a new one would be best, the piece is cut instead, at the level for which the sum is least
    once its first part has closed a window there and the rest is a new one; so no more are ever open.
    """

    def __init__(self, window: int = WINDOW, most: int = OPEN):
        self.window, self.most = window, most
        self.level = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[list]] = {}
        self.count = 0

    def place(self, document, start: int, size: int) -> list | None:
        """The pieces of the window that this one, or its first part, fills, else None."""
        w, n = self.window, self.level
        used = np.fromiter(self.open, np.int64, len(self.open))
        used.sort()
        after = used[used <= w - size] + size
        # The change of the sum of squares: one window leaves level h, one comes to level h + size (none where it's full).
        change = 1 - 2 * n[after - size] + np.where(after < w, 2 * n[after] + 1, 0)
        fresh = 2 * int(n[size]) + 1 if size < w else 0
        best = int(change.min()) if len(change) else None
        if best is not None and (best <= fresh or (self.count >= self.most and len(change) == len(used))):
            return self._put(int(after[np.flatnonzero(change == best)[-1]]) - size, document, start, size)
        if self.count < self.most or size == w:
            return self._put(0, document, start, size)
        over = used[used > w - size]
        rest = over + size - w
        change = 2 * n[rest] + 1 - 2 * n[over]
        h = int(over[np.flatnonzero(change == change.min())[-1]])
        full = self._put(h, document, start, w - h)
        self._put(0, document, start + w - h, size - (w - h))
        return full

    def _put(self, h: int, document, start: int, size: int) -> list | None:
        pieces = []
        if h:
            pieces = self.open[h].pop()
            self.level[h] -= 1
            self.count -= 1
            if not self.open[h]:
                del self.open[h]
        pieces.append((document, start, size))
        if h + size == self.window:
            return pieces
        self.open.setdefault(h + size, []).append(pieces)
        self.level[h + size] += 1
        self.count += 1
        return None

    def drain(self) -> list[list]:
        """The open windows' pieces, fullest first; afterwards none is open."""
        out = [p for h in sorted(self.open, reverse=True) for p in self.open[h]]
        self.open.clear()
        self.level[:] = 0
        self.count = 0
        return out


def pack(docs: DataFrame, tokenizer: str = word_tokens.TOKENIZER, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pack docs(doc_id, text) into sequences of at most window ids; returns one row a piece.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids). A document is its ids and end_id; a null or
    empty text is end_id alone. What exceeds a window is cut off in whole windows first; the rest, which most documents are
    as a whole, is placed by SumOfSquares in the order of the task's input. When a task's input ends, the OPEN windows left at
    most are poured together and cut at the window size, so a task pads one sequence at its end. Sequence ids are unique, the
    task's number in the high bits; nothing is shuffled. Null doc_ids and repeated rows are packed like any other; an empty
    table gives no rows; other columns, whatever their names, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokens.encoder(tokenizer)
        packer = SumOfSquares(window)
        sequence = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []

        def emit(pieces: list) -> None:
            nonlocal sequence
            at = 0
            for (doc, total, first, ids), start, size in pieces:
                own = ids[start - first : start - first + size]
                rows.append((doc, start, size, zlib.crc32(own.astype("<u4").tobytes()), total, sequence, at, own))
                at += size
            sequence += 1

        def pour() -> None:
            held, free = [], window
            for pieces in packer.drain():
                for document, start, size in pieces:
                    while size:
                        take = min(size, free)
                        held.append((document, start, take))
                        start, size, free = start + take, size - take, free - take
                        if not free:
                            emit(held)
                            held, free = [], window
            if held:
                emit(held)

        for b in slices(batches, limit=word_tokens.SLICE):
            ids, ends = word_tokens.closed(*encode.encode(b.column("text")), end_id)
            for i, doc in enumerate(b.column("doc_id").to_pylist()):
                own = ids[ends[i] : ends[i + 1]]
                total, at = len(own), 0
                while total - at >= window:
                    emit([((doc, total, 0, own), at, window)])
                    at += window
                if at < total:
                    # A copy: a view would keep the whole slice's ids alive.
                    if full := packer.place((doc, total, at, own[at:].copy()), at, total - at):
                        emit(full)
            if rows:
                yield _batch(rows)
                rows = []
        pour()
        if rows:
            yield _batch(rows)
        rows = []
        trim()

    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    sizes = np.fromiter((len(x) for x in cols[7]), np.int32, len(rows))
    ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(np.concatenate(cols[7]).astype(np.int32)))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:7]), ids], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])


def pieces(docs: DataFrame) -> DataFrame:
    """The digest of pack(): its rows without the ids; nulls, ties, empty tables and other columns are treated as there."""
    return pack(docs).drop("ids")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "documents"))
