"""Exact removal of long repeats by a logarithmic family of sparse suffix arrays.

A repeat of MATCH bytes is found through the suffixes that start at synchronising positions: in each window of MATCH bytes
the SEED-byte string of least hash, the leftmost if several. Equal windows choose equal places, so of all suffixes only about
one in 35 is indexed and no repeat is lost. A suffix array holds its suffixes in the order of a 128-bit fingerprint of their
context, the bytes of all windows that chose them; only equality of the first hundred or so bytes is ever asked, and
fingerprint order answers it with fixed-width numbers in place of bytes. New batches are sorted, merge-scanned against each
level, and equal-sized levels are merged, so that n batches leave about log n levels (LevelFamily).

Map tasks run a family over their slices, which settles copies within the task, and send what is left by ranges of the seed's
hash; a reducing task runs a family over the batches of its range. Contexts that agree wholly are settled there. Where a seed
stands in different contexts, at the rims of repeats, the windows themselves are compared in a second round of the same kind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange
from .common import cache, fresh, mix, only, save, shuffle_parts, slices, spread, table, text_buffer, tidy

MATCH, SEED = 100, 32
#: Equal windows agree in at least so many bytes to one side of their seed.
HALF = (MATCH - SEED) // 2
#: Contexts of one seed in one task beyond which they go to the second round at once, so that no seed fills a task; the others
#: of such a seed follow them, all their windows, once its range has been told of it.
MANY = 256
#: Entries that a map task gathers before it sends them; bytes of text, and of window starts, looked at together.
GATHER, CHUNK = 400_000, 1 << 19
_U = np.uint64
#: The bits of a seed's hash that entries carry to their range.
_SENT = _U((1 << 48) - 1)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD6E8FEB86659FD93))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = cache()


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n. Those for a very long text aren't kept for the next."""
    size = 1 << max(16, int(n).bit_length())
    have = next(iter(_powers), 0)
    if have < size or have > max(size, 4 * CHUNK):
        _powers.clear()
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _powers[size] = tuple(out)
    return next(iter(_powers.values()))


class Rolling:
    """Fingerprints of any stretch of a byte array, from sums of byte codes times powers of the base."""

    def __init__(self, data: np.ndarray):
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_CODE[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Synchronising positions of texts that lie one after the other in data: (h1, h2, sides, text number, p, a, b).

    Windows that start at a..b (inclusive, in data) chose the seed at p; h1 is the seed's hash, h2 that of the bytes of all
    these windows and of where the seed lies in them. sides has 16 bits each of the hashes of the HALF bytes before and after
    the seed (of fewer, at the rim of a text). Positions are in data.
    """
    out = []
    lengths = np.maximum(0, np.diff(ends) - MATCH + 1)
    first = 0
    while first < len(lengths):
        # Texts up to CHUNK bytes together; a longer text in stretches of CHUNK windows.
        stop = max(first + 1, int(np.searchsorted(ends, ends[first] + CHUNK, "right")) - 1)
        for begin in range(int(ends[first]), max(int(ends[first]) + 1, int(ends[stop])), CHUNK):
            part = data[begin : min(int(ends[stop]), begin + CHUNK + MATCH - 1)] if stop == first + 1 else data[begin : int(ends[stop])]
            texts = np.arange(first, stop)
            low = np.maximum(ends[texts] - begin, 0)
            high = np.minimum(ends[texts] + lengths[texts] - begin, max(0, len(part) - MATCH + 1))
            n = np.maximum(0, high - low)
            if n.sum():
                h1, h2, s0, s1, p, rolling = _chunk(part, spread(low, n))
                owner = np.repeat(texts, n)[s0[1]]
                before = rolling.of(np.maximum(p - HALF, np.maximum(ends[owner] - begin, 0)), p)
                after = rolling.of(p + SEED, np.minimum(p + SEED + HALF, np.minimum(ends[owner + 1] - begin, len(part))))
                sides = ((before >> _U(48)) << _U(16) | after >> _U(48)).astype(np.uint32)
                out.append((h1, h2, sides, owner, p + begin, s0[0] + begin, s1 + begin))
            if stop > first + 1:
                break
        first = stop
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint32), *(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _chunk(data: np.ndarray, starts: np.ndarray):
    rolling = Rolling(data)
    at = np.arange(len(data) - SEED + 1)
    h = rolling.of(at, at + SEED)
    wide = MATCH - SEED + 1
    # The least hash of each window (its high bits, then the place), by minima from both ends of blocks.
    key = (h & ~_U(0xFFFFFF)) | at.astype(np.uint64)
    blocks = -(-len(key) // wide)
    padded = np.full(blocks * wide, ~_U(0), np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(blocks, wide)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    p = (np.minimum(backward[starts], forward[starts + wide - 1]) & _U(0xFFFFFF)).astype(np.int64)
    # Neighbouring windows of one text that chose the same place form one entry.
    new = np.append(True, (p[1:] != p[:-1]) | (starts[1:] != starts[:-1] + 1))
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(p)) - 1
    p, a, b = p[head], starts[head], starts[tail]
    h1 = h[p]
    h2 = mix(rolling.of(a, b + MATCH) + ((p - a) * 256 + (p - b)).astype(np.uint64))
    return h1, h2, (a, head), b, p, rolling


def _pack_entries(c: list[np.ndarray]) -> bytes:
    """Entries by document and place; of the seed's hash the low six bytes, to which the range adds some bits."""
    order = np.lexsort((c[3], c[2]))
    key, seed, doc, p, hi, lo, sides = (x[order] for x in c)
    low = np.ascontiguousarray(seed.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    return len(key).to_bytes(8, "little") + b"".join((key.tobytes(), low.tobytes(), exchange.steps(doc), exchange.steps(p.astype(np.int64)), hi.tobytes(), lo.tobytes(), sides.tobytes()))


def _unpack_entries(payload: bytes, part: int) -> Run:
    n, at, out = int.from_bytes(payload[:8], "little"), 8, []
    for width in (8, 6, 8, 8, 1, 1, 4):
        out.append(np.frombuffer(payload, np.uint8, n * width, at))
        at += n * width
    seed = np.zeros((n, 8), np.uint8)
    seed[:, :6] = out[1].reshape(n, 6)
    seed = seed.view("<u8").ravel() | _U((part & 0xFFFF) << 48)
    return Run([out[0].view("<u8").copy(), seed, exchange.unsteps(out[2]), exchange.unsteps(out[3]).astype(np.int32), out[4].copy(), out[5].copy(), out[6].view("<u4").copy()])


def _pack_windows(c: list[np.ndarray]) -> bytes:
    order = np.lexsort((c[3], c[2]))
    key, seed, doc, p = (x[order] for x in c)
    return len(key).to_bytes(8, "little") + b"".join((key.tobytes(), seed.astype("<u4").tobytes(), exchange.steps(doc), exchange.steps(p.astype(np.int64))))


def _unpack_windows(payload: bytes) -> Run:
    n, at, out = int.from_bytes(payload[:8], "little"), 8, []
    for width in (8, 4, 8, 8):
        out.append(np.frombuffer(payload, np.uint8, n * width, at))
        at += n * width
    return Run([out[0].view("<u8").copy(), out[1].view("<u4").copy(), exchange.unsteps(out[2]), exchange.unsteps(out[3]).astype(np.int32)])


class Run:
    """Entries in key order: key, seed hash, document, place, and what else they carry."""

    def __init__(self, columns: list[np.ndarray]):
        self.columns = columns

    def __len__(self) -> int:
        return len(self.columns[0])

    def take(self, at: np.ndarray) -> Run:
        return Run([c[at] for c in self.columns])

    @staticmethod
    def join(runs: list[Run]) -> Run:
        return Run([np.concatenate(c) for c in zip(*(r.columns for r in runs), strict=True)])


class LevelFamily:
    """A logarithmic family of sorted arrays in which each key is kept once, at its earliest (document, place)."""

    def __init__(self):
        self.levels: dict[int, Run] = {}

    def add(self, batch: Run) -> Run:
        """Sort a batch, scan it against every level, keep it as a level; returns the entries that have an earlier equal."""
        order = np.lexsort((batch.columns[3], batch.columns[2], batch.columns[0]))
        batch = batch.take(order)
        same = self._same(batch, np.arange(1, len(batch)), batch, np.arange(len(batch) - 1)) if len(batch) else np.zeros(0, bool)
        later = [batch.take(np.flatnonzero(np.append(False, same)))] if len(batch) else []
        batch = batch.take(np.flatnonzero(np.append(True, ~same))) if len(batch) else batch
        for level in list(self.levels.values()):
            at = np.searchsorted(level.columns[0], batch.columns[0])
            hit = np.flatnonzero(at < len(level))
            hit = hit[self._same(batch, hit, level, at[hit])]
            if not len(hit):
                continue
            there = at[hit]
            d, e = batch.columns[2][hit], level.columns[2][there]
            earlier = (d < e) | ((d == e) & (batch.columns[3][hit] < level.columns[3][there]))
            later.append(batch.take(hit[~earlier]))
            later.append(level.take(there[earlier]))
            for mine, theirs in zip(level.columns, batch.columns, strict=True):
                mine[there[earlier]] = theirs[hit[earlier]]
            rest = np.ones(len(batch), bool)
            rest[hit] = False
            batch = batch.take(np.flatnonzero(rest))
        if len(batch):
            size = len(batch).bit_length()
            while size in self.levels:
                batch = Run.join([self.levels.pop(size), batch])
                batch = batch.take(np.argsort(batch.columns[0], kind="stable"))
                size = max(size + 1, len(batch).bit_length())
            self.levels[size] = batch
        return Run.join(later) if later else batch.take(np.zeros(0, np.int64))

    @staticmethod
    def _same(x: Run, i: np.ndarray, y: Run, j: np.ndarray) -> np.ndarray:
        return (x.columns[0][i] == y.columns[0][j]) & (x.columns[1][i] == y.columns[1][j])

    def entries(self) -> Run | None:
        return Run.join(list(self.levels.values())) if self.levels else None


def _entries(data: np.ndarray, ends: np.ndarray, docs: np.ndarray) -> Run:
    h1, h2, sides, owner, p, a, b = anchors(data, ends)
    return Run([mix(h1 ^ mix(h2)), h1, docs[owner], (p - ends[owner]).astype(np.int32), (p - a).astype(np.uint8), (p - b).astype(np.uint8), sides])


FOUND = "doc long, start int, stop int, rim boolean, seed long"


def _intervals(run: Run) -> pa.RecordBatch:
    """Bytes of entries that have an earlier equal: from their first window's start to their last one's end."""
    _, _, doc, p, hi, lo, _ = run.columns
    start, stop = p.astype(np.int64) - hi, p.astype(np.int64) - lo + MATCH
    return _merged(doc, start, stop)


def _merged(doc: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((start, doc))
    doc, start, stop = doc[order], start[order], stop[order]
    if len(doc):
        # Ends don't fall within a document when starts are sorted and stretches overlap; the running maximum makes that sure.
        base = np.cumsum(np.append(False, doc[1:] != doc[:-1])).astype(np.int64) << 40
        reach = np.maximum.accumulate(base + stop)
        new = np.append(True, (base[1:] + start[1:]) > reach[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(doc)) - 1
        doc, start, stop = doc[head], start[head], reach[tail] - base[tail]
    return _found(doc, start, stop, False, np.zeros(len(doc), np.int64))


def _found(doc, start, stop, rim: bool, seed) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(np.full(n, rim)), pa.array(seed.view(np.int64) if seed.dtype == np.uint64 else seed)], names=["doc", "start", "stop", "rim", "seed"])


def _rims(run: Run, before: np.ndarray | None = None, after: np.ndarray | None = None) -> pa.RecordBatch:
    """Windows for the second round, as stretches of starts: of all entries, or those of more bytes before the seed where
    another entry agrees before it, and those of more bytes after it where another agrees after it."""
    _, h1, doc, p, hi, lo, _ = run.columns
    h1 = h1 & _SENT  # windows of map tasks and of ranges meet, so both must name a seed alike
    p, hi, lo = (x.astype(np.int64) for x in (p, hi, lo))
    if before is None:
        return _found(doc, p - hi, p - lo, True, h1)
    first = np.where(before, p - hi, p - np.minimum(hi, HALF))
    last = np.where(after, p - lo, p - np.maximum(lo, HALF))
    some = (before | after) & (first <= last)
    return _found(doc[some], first[some], last[some], True, h1[some])


def _to_rows(found: pa.RecordBatch, parts: int) -> list[tuple[int, bytes]]:
    """Settled rows, which only pass through the exchange, in payloads of bounded size spread over its parts."""
    cols = [found.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
    cols[3] = cols[3].astype(np.uint8)
    first = int(mix(cols[0][:1].astype(np.uint64))[0] % _U(parts)) if len(cols[0]) else 0
    return [((first + k) % parts, b"\1" + exchange.pack([c[at : at + 8192] for c in cols])) for k, at in enumerate(range(0, len(cols[0]), 8192))]


def _range(seed: np.ndarray, parts: int) -> np.ndarray:
    """The range of a seed's hash. It is mixed first: seeds are chosen for their least hashes, so those lie close together."""
    return exchange.part_of(mix(seed), parts)


def _send_entries(family: LevelFamily, parts: int, later: list[Run], many: int) -> Iterator[pa.RecordBatch]:
    """What a map task sends: settled stretches and entries of crowded seeds as they are, the other entries and the names of
    the crowded seeds by range of the seed's hash."""
    rows: list[tuple[int, bytes]] = []
    if later and sum(map(len, later)):
        rows += _to_rows(_intervals(Run.join(later)), parts)
    run = family.entries()
    if run is not None:
        run = run.take(np.argsort(run.columns[1], kind="stable"))
        seed = run.columns[1]
        head = np.flatnonzero(np.append(True, seed[1:] != seed[:-1]))
        sizes = np.diff(np.append(head, len(seed)))
        crowded = np.repeat(sizes, sizes) > many
        if crowded.any():
            rows += _to_rows(_rims(run.take(np.flatnonzero(crowded))), parts)
            names = seed[head[sizes > many]]
            rows += [(part, b"\2" + cols[0].astype("<u8").tobytes()) for part, cols in exchange.split(_range(names, parts), [names])]
        keep = np.flatnonzero(~crowded)
        columns = [c[keep] for c in run.columns]
        rows += [(part, b"\0" + _pack_entries(cols)) for part, cols in exchange.split(_range(columns[1], parts), columns)]
    if rows:
        yield exchange.to_batch(rows)


def _passed(payload: bytes) -> pa.RecordBatch:
    doc, start, stop, rim, seed = exchange.unpack(payload[1:], ["<i8", "<i4", "<i4", "u1", "<i8"])
    return _found(doc, start, stop, bool(rim[0]), seed)


def _settle(parts: Iterator[tuple[int, Iterator[bytes]]]) -> Iterator[pa.RecordBatch]:
    """First round: entries with an earlier equal are repeats as a whole; of seeds in several contexts the rest are rims. What
    is here of a seed that was crowded in any map task can equal windows that aren't, so all its windows go on."""
    for part, payloads in parts:
        family, crowded = LevelFamily(), np.zeros(0, np.uint64)
        for payload in payloads:
            if payload[0] == 2:
                crowded = np.union1d(crowded, np.frombuffer(payload, "<u8", offset=1) & _SENT)
                continue
            if payload[0]:
                yield _passed(payload)
                continue
            later = family.add(_unpack_entries(payload[1:], part))
            if len(later):
                yield _intervals(later)
        if (run := family.entries()) is not None:
            seeds, inverse, n = np.unique(run.columns[1], return_inverse=True, return_counts=True)
            full = np.isin(seeds & _SENT, crowded)
            if full.any():
                yield _rims(run.take(np.flatnonzero(full[inverse])))
            rim = run.take(np.flatnonzero(((n > 1) & ~full)[inverse]))
            if len(rim):
                yield _rims(rim, *(_shared(rim.columns[1], side) for side in (rim.columns[6] >> np.uint32(16), rim.columns[6] & np.uint32(0xFFFF))))


def _shared(seed: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Which entries have another of the same seed and side."""
    _, inverse, n = np.unique(mix(seed) ^ side.astype(np.uint64), return_inverse=True, return_counts=True)
    return n[inverse] > 1


def _settle_windows(parts: Iterator[tuple[int, Iterator[bytes]]]) -> Iterator[pa.RecordBatch]:
    """Second round: windows with an earlier equal."""
    for _, payloads in parts:
        family = LevelFamily()
        for payload in payloads:
            if payload[0]:
                yield _passed(payload)
                continue
            later = family.add(_unpack_windows(payload[1:]))
            if len(later):
                yield _window_stretches(later)


def _window_stretches(run: Run) -> pa.RecordBatch:
    start = run.columns[3].astype(np.int64)
    return _merged(run.columns[2], start, start + MATCH)


def _ordered(docs: DataFrame, order: str) -> DataFrame:
    """docs with a unique number `order` in the order of doc_id: doc_id itself, or where that repeats or is null a number in
    the order of doc_id (null first) and text. Rows of one doc_id, or of none, are dealt by their texts too."""
    ids = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("present")).first()
    if ids.n == ids.present and docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return docs.withColumn(order, F.col("doc_id").cast("long"))
    (least,) = fresh(docs, "least")
    dealt = docs.withColumn(least, F.col("text").cast("string").substr(1, 256))  # bounds of ranges needn't hold whole texts
    dealt = dealt.repartitionByRange(shuffle_parts(docs.sparkSession), "doc_id", least).sortWithinPartitions("doc_id", least, "text").drop(least)
    return save(dealt.withColumn(order, F.monotonically_increasing_id()), "ordered-docs")


def repeats(docs: DataFrame, many: int | None = None, gather: int | None = None) -> DataFrame:
    """Repeated stretches of docs(_ord, text): rows (doc, start, stop) of bytes, several of which may overlap.

    many and gather stand for MANY and GATHER; both are read here and go to the tasks with the functions.
    """
    many, gather = MANY if many is None else many, GATHER if gather is None else gather
    parts = exchange.ranges(docs)
    texts = docs.select("_ord", F.col("text").cast("string").alias("text")).where(F.octet_length("text") >= MATCH)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(_powers)
        family, later, held = LevelFamily(), [], 0
        for b in slices(batches, limit=CHUNK):
            data, ends = text_buffer(b.column("text"))
            run = _entries(data, ends, b.column("_ord").to_numpy())
            held += len(run)
            later.append(family.add(run))
            if held > gather:
                yield from _send_entries(family, parts, later, many)
                family, later, held = LevelFamily(), [], 0
        yield from _send_entries(family, parts, later, many)

    found = save(exchange.deal(texts.mapInArrow(tidy(index), exchange.SCHEMA), _settle, FOUND), "suffix-round1")
    rims = found.where("rim").groupBy("doc").agg(F.collect_list(F.struct("seed", "start", "stop")).alias("rims"))  # one document's
    asked = texts.join(rims, texts["_ord"] == rims["doc"]).select("_ord", "text", "rims")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(_powers)
        family, later, held = LevelFamily(), [], 0
        for b in slices(batches, limit=CHUNK):
            data, ends = text_buffer(b.column("text"))
            rolling = Rolling(data)
            rims = b.column("rims")
            n = np.diff(np.asarray(rims.offsets))
            flat = rims.flatten()
            seed, start, stop = (flat.field(k).to_numpy().astype(np.int64) for k in range(3))
            owner = np.repeat(np.arange(b.num_rows), n)
            size = stop - start + 1
            s = spread(start, size)
            owner, seed = np.repeat(owner, size), np.repeat(seed, size).view(np.uint64)
            at = s + ends[owner]
            run = Run([mix(seed ^ mix(rolling.of(at, at + MATCH))), seed.astype(np.uint32), b.column("_ord").to_numpy()[owner], s.astype(np.int32)])
            held += len(run)
            later.append(family.add(run))
            if held > gather:
                yield from send(family, later)
                family, later, held = LevelFamily(), [], 0
        yield from send(family, later)

    def send(family: LevelFamily, later: list[Run]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, bytes]] = []
        if later and sum(map(len, later)):
            rows += _to_rows(_window_stretches(Run.join(later)), parts)
        if (run := family.entries()) is not None:
            rows += [(part, b"\0" + _pack_windows(cols)) for part, cols in exchange.split(exchange.part_of(run.columns[0], parts), run.columns)]
        if rows:
            yield exchange.to_batch(rows)

    second = exchange.deal(asked.mapInArrow(tidy(windows), exchange.SCHEMA), _settle_windows, FOUND)
    return found.where("not rim").select("doc", "start", "stop").union(second.select("doc", "start", "stop"))


def _spans(column: pa.Array) -> Iterator[list[tuple[int, int]]]:
    """Sorted, maximal stretches of each row's list."""
    for row in column.to_pylist():
        out: list[tuple[int, int]] = []
        for x in sorted((x["start"], x["stop"]) for x in row or ()):
            if out and x[0] <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], x[1]))
            else:
                out.append(x)
        yield out


def _with_spans(docs: DataFrame, column: str) -> DataFrame:
    """docs with the repeated stretches of each row."""
    order, doc = fresh(docs, "ord", "doc")
    docs = _ordered(docs, order)
    texts = docs.select(F.col(order).alias("_ord"), F.col("text").cast("string").alias("text"))
    found = repeats(texts).groupBy(F.col("doc").alias(doc)).agg(F.collect_list(F.struct("start", "stop")).alias(column))  # one document's
    return docs.join(found, F.col(order) == F.col(doc), "left").drop(doc, order)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Digest of docs(doc_id, text) without the bytes of repeats: (doc_id, n_bytes, n_removed, n_spans, kept_sha256).

    A byte goes if a MATCH-byte string that covers it also starts earlier: in a document before (by doc_id, null first,
    repeated doc_ids by text) or before it in the same one. Null texts are empty, texts shorter than MATCH are kept whole,
    an empty table gives no rows, other columns are ignored. Every row has one result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = []
            for text, spans in zip(b.column("text").to_pylist(), _spans(b.column("repeats")), strict=True):
                raw, kept, at = (text or "").encode(), hashlib.sha256(), 0
                for s, e in spans:
                    kept.update(raw[at:s])
                    at = e
                kept.update(raw[at:])
                rows.append((len(raw), sum(e - s for s, e in spans), len(spans), kept.hexdigest()))
            n, removed, count, sha = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _with_spans(texts, "repeats").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs, all columns kept, with the repeats of remove_repeats() cut out of text; a character of which only a part repeats
    stays whole. A null text stays null, an empty or a short one as it is; of repeated rows the first by doc_id (null first)
    and text keeps its text; an empty table gives no rows; columns may have any names."""
    names = docs.columns
    (column,) = fresh(docs, "repeats")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            for i, spans in enumerate(_spans(b.column(column))):
                if spans:
                    raw, out, at = texts[i].encode(), [], 0
                    for s, e in spans:
                        while s < e and raw[s] & 0xC0 == 0x80:  # not from within a character
                            s += 1
                        while e < len(raw) and e > s and raw[e] & 0xC0 == 0x80:  # nor to within one
                            e -= 1
                        out.append(raw[at:s])
                        at = max(at, e)
                    texts[i] = (b"".join(out) + raw[at:]).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else b.column(n) for n in names], names=names)

    return _with_spans(docs, column).select(*names, column).mapInArrow(run, docs.schema)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
