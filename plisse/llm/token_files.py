"""Token ids in seekable files: independent zstandard frames, a trailing seek table, a checksum for each frame.

A file is a sequence of zstandard frames, each with its content checksum. A frame holds whole documents: uint32 number of
documents n, uint32 number of these without an id, which come first, n int64 document ids (0 where there is none; the least
number stands for it in the index), n uint32 token counts, then the ids (uint16 where the vocabulary fits, else uint32; all
little-endian). A document larger than the frame target has a frame of its own. Two skippable frames end the file: the
index (first and last document id and token count of each frame) and the seek table of the public seekable format
(compressed size, content size and the low 32 bits of the content's XXH64 for each frame, then a 9-byte footer). A reader
takes the end of the file, picks frames by document id, and decompresses only those.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import word_tokens
from .common import save, shared_path, shuffle_parts, slices, table

#: Fixed values of the public seekable format.
SKIPPABLE_SEEK, SKIPPABLE_INDEX, SEEKABLE_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
NO_ID = -(1 << 63)
FRAME_BYTES = 1 << 18
END_ID = 1


class FrameWriter:
    """Writes documents (id, ids) into frames of a binary sink."""

    def __init__(self, sink, wide: bool, level: int = 3):
        import xxhash
        import zstandard

        self.sink, self.kind = sink, np.dtype("<u4" if wide else "<u2")
        self.press = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.digest = xxhash.xxh64_intdigest
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        self.parts: list[bytes] = []
        self.held = 0
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """Documents come in the order of their ids, those without one first."""
        part = ids.astype(self.kind).tobytes()
        if self.docs and self.held + len(part) > FRAME_BYTES:
            self.flush()
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.parts.append(part)
        self.held += len(part)

    def flush(self) -> None:
        if not self.docs:
            return
        body = struct.pack("<II", len(self.docs), self.docs.count(None)) + np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array(self.sizes, "<u4").tobytes() + b"".join(self.parts)
        frame = self.press.compress(body)
        self.sink.write(frame)
        self.frames.append((len(frame), len(body), self.digest(body) & 0xFFFFFFFF))
        first, last = (NO_ID if d is None else d for d in (self.docs[0], self.docs[-1]))
        self.index.append((first, last, sum(self.sizes)))
        self.docs, self.sizes, self.parts, self.held = [], [], [], 0

    def close(self) -> None:
        self.flush()
        body = struct.pack("<BI", self.kind.itemsize, len(self.index)) + b"".join(struct.pack("<qqQ", *x) for x in self.index)
        self.sink.write(struct.pack("<II", SKIPPABLE_INDEX, len(body) + 4) + body + struct.pack("<I", len(body)))
        table = b"".join(struct.pack("<III", *x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)


class FrameReader:
    """Reads documents from a seekable file; only the frames asked for are decompressed, and each is verified."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE_MAGIC or flags != 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        seek_at = size - 9 - 12 * n - 8
        source.seek(seek_at - 4)
        (index_size,) = struct.unpack("<I", source.read(4))
        source.seek(seek_at + 8)
        self.frames = list(struct.iter_unpack("<III", source.read(12 * n)))
        source.seek(seek_at - 4 - index_size)
        width, m = struct.unpack("<BI", source.read(5))
        self.kind = np.dtype("<u4" if width == 4 else "<u2")
        self.index = list(struct.iter_unpack("<qqQ", source.read(24 * m)))
        self.starts = np.concatenate(([0], np.cumsum([f[0] for f in self.frames]))).astype(np.int64)

    def frame(self, k: int) -> list[tuple[int | None, np.ndarray]]:
        import xxhash
        import zstandard

        self.source.seek(int(self.starts[k]))
        packed, size, check = self.frames[k]
        body = zstandard.ZstdDecompressor().decompress(self.source.read(packed), max_output_size=size)
        if len(body) != size or xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} doesn't match its checksum")
        n, none = struct.unpack_from("<II", body)
        docs = [None] * none + np.frombuffer(body, "<i8", n, 8)[none:].tolist()
        sizes = np.frombuffer(body, "<u4", n, 8 + 8 * n).astype(np.int64)
        ids = np.frombuffer(body, self.kind, -1, 8 + 12 * n)
        ends = np.concatenate(([0], np.cumsum(sizes)))
        return [(d, ids[ends[i] : ends[i + 1]]) for i, d in enumerate(docs)]

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.frames)):
            yield from self.frame(k)

    def documents(self, wanted: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
        """The documents asked for, from the frames whose range of ids can hold them."""
        wanted = np.unique(np.fromiter(wanted, np.int64))
        for k, (first, last, _) in enumerate(self.index):
            lo, hi = np.searchsorted(wanted, first), np.searchsorted(wanted, last, "right")
            if lo < hi:
                keep = set(wanted[lo:hi].tolist())
                yield from (x for x in self.frame(k) if x[0] in keep)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = word_tokens.TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Encode docs(doc_id, text) into files under folder, in ascending doc_id over file number and place in the file.

    Returns a small table, one row a file that has documents: (part, file, n_docs, n_tokens). The texts are dealt by ranges
    of doc_id and sorted within; a file is one task's. A task writes under a name of its own and renames it when done, so a
    lost executor or a second attempt leaves no half file. Rows of equal doc_id are ordered by text; those without a doc_id
    come first, dealt by the beginnings of their texts; a null text is empty and holds end_id alone; an empty table gives no
    files; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("least", F.when(F.col("doc_id").isNull(), F.substring("text", 1, 256)))
    dealt = texts.repartitionByRange(shuffle_parts(spark), "doc_id", "least").sortWithinPartitions("doc_id", "least", "text").drop("least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokens.encoder(tokenizer)
        part = TaskContext.get().partitionId()
        store, root = fs.FileSystem.from_uri(folder)
        sink = writer = None
        n_docs = n_tokens = 0
        for b in slices(batches, limit=word_tokens.SLICE):
            if writer is None:
                store.create_dir(root, recursive=True)
                name, own = f"{root}/part-{part:06d}.tokens", f"{root}/.attempt-{uuid.uuid4().hex}"
                sink = store.open_output_stream(own)
                writer = FrameWriter(sink, encode.tokenizer.get_vocab_size() > 1 << 16)
            ids, ends = word_tokens.closed(*encode.encode(b.column("text")), end_id)
            for i, d in enumerate(b.column("doc_id").to_pylist()):
                writer.add(d, ids[ends[i] : ends[i + 1]])
            n_docs, n_tokens = n_docs + b.num_rows, n_tokens + len(ids)
        if writer is not None:
            writer.close()
            sink.close()
            store.move(own, name)
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"part-{part:06d}.tokens"], "n_docs": [n_docs], "n_tokens": [n_tokens]})

    return save(dealt.mapInArrow(run, "part long, file string, n_docs long, n_tokens long"), "token-manifest")


def read_tokens(spark: SparkSession, folder: str, files: list[tuple[str, int]], wanted: list[int] | None = None) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32, ids) of the files of write_tokens(), each given with the count of ids before it.

    wanted: read only these documents' frames (start is then null). One task reads a file at a time, frame by frame.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, at in zip(b.column("file").to_pylist(), b.column("base").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as source:
                    reader = FrameReader(source)
                    rows: list[tuple] = []
                    for doc, ids in reader if wanted is None else reader.documents(wanted):
                        rows.append((doc, at if wanted is None else None, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), ids.astype(np.int32)))
                        at += len(ids)
                        if len(rows) >= 256:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    listed = spark.createDataFrame(files or [("", 0)], "file string, base long").where("file != ''")
    return listed.repartition(max(1, len(files)), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(list(cols[4]), pa.list_(pa.int32()))], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def manifest(written: DataFrame) -> list[tuple[str, int]]:
    """The files in order, each with the count of ids before it. One row a file comes to the driver, none a document."""
    files, base = [], 0
    for r in sorted(written.collect(), key=lambda r: r.part):
        files.append((r.file, base))
        base += r.n_tokens
    return files


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "tokens")
    files = manifest(write_tokens(table(spark, sf_dir, "documents"), folder))
    return read_tokens(spark, folder, files).drop("ids")
