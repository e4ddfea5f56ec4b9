"""The five detectors, on whole spans at a time.

Units arrive in order, one span after the other, and leave as their span's commits. What the detectors ask of a text is only
whether it equals another, so texts become numbers first, and everything after is arithmetic on arrays: runs are islands of
equal neighbours; a block of L units repeats where a streak of units that equal the L-th after them is L long at least. Only
the choice among overlapping blocks is sequential, and it looks at the candidates alone. A plan of windows would sort every
span some ten times for this.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from plisse.functions import text as T
from plisse.operators.units import SPAN
from plisse.plans.options import MAX_BLOCK_LINES, MIN_BLOCK_LINES, TABLE_KEYS, Options

KINDS = tuple(T.KINDS)
COMMIT = "struct<kind:string,first:int,last:int,count:bigint,anchor_start:int,anchor_end:int,removed_start:int,removed_end:int>"
COMMITS = f"array<{COMMIT}>"
#: Bytes of a marker without its count, and the four of its checksum among them, by style and kind.
WIDTHS = {s: [len((o + before + sign + after + sep + close).encode()) + 4 for before, after in T.KINDS.values()] for s, (o, sign, sep, close) in T.FRAMES.items()}
#: Units that are looked at together, if their spans are shorter.
TOGETHER = 1 << 16


def digits(n: np.ndarray) -> np.ndarray:
    return np.searchsorted(10 ** np.arange(1, 19), n, "right") + 1


class Spans:
    """Some spans' units: the span's number, whether eligible, byte range, and the widths of the span's markers by kind."""

    def __init__(self, span: np.ndarray, eligible: np.ndarray, start: np.ndarray, end: np.ndarray, widths: np.ndarray, table_keys: int = TABLE_KEYS):
        self.span, self.eligible, self.start, self.end, self.widths, self.table_keys = span, eligible, start, end, widths, table_keys
        self.claimed = np.zeros(len(span), bool)
        self.found: list[tuple[np.ndarray, ...]] = []

    def free(self) -> np.ndarray:
        return self.eligible & ~self.claimed

    def _pays(self, kind: int, first: np.ndarray, anchor: np.ndarray, stop: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Whether the first `anchor` units and a marker are shorter than all up to stop."""
        begin = self.start[first]
        marker = self.widths[self.span[first], kind] + digits(count)
        return self.end[first + anchor - 1] - begin + marker < self.end[stop - 1] - begin

    def _claim(self, kind: int, first: np.ndarray, anchor: np.ndarray, stop: np.ndarray, count: np.ndarray) -> None:
        if len(first):
            edge = np.zeros(len(self.span) + 1, np.int64)
            edge[first] += 1
            edge[stop] -= 1  # starts and stops may coincide
            self.claimed |= np.cumsum(edge)[:-1] > 0
            self.found.append((np.full(len(first), kind), first, anchor, stop, count))

    def runs(self, kind: int, value: np.ndarray, least: int) -> None:
        """Claim maximal runs of free units of equal value, if long enough and profitable."""
        free = self.free()
        same = np.zeros(len(value) + 1, bool)
        same[1:-1] = free[1:] & free[:-1] & (self.span[1:] == self.span[:-1]) & (value[1:] == value[:-1])
        first = np.flatnonzero(same[1:] & ~same[:-1])
        stop = np.flatnonzero(same[:-1] & ~same[1:]) + 1
        count = stop - first - 1
        ok = stop - first >= max(2, least)
        first, stop, count = first[ok], stop[ok], count[ok]
        one = np.ones(len(first), np.int64)
        ok = self._pays(kind, first, one, stop, count)
        self._claim(kind, first[ok], one[ok], stop[ok], count[ok])

    def _streak(self, free: np.ndarray, value: np.ndarray, period: int) -> np.ndarray:
        """How many units from each on equal the one `period` later, without a break; both free and of one span."""
        n = len(value)
        if n <= period:
            return np.zeros(n, np.int64)
        same = np.zeros(n + 1, bool)
        same[: n - period] = free[:-period] & free[period:] & (self.span[:-period] == self.span[period:]) & (value[:-period] == value[period:])
        if not same.any():
            return np.zeros(n, np.int64)
        breaks = np.where(same, n, np.arange(n + 1))
        return np.minimum.accumulate(breaks[::-1])[::-1][:n] - np.arange(n)

    def candidates(self, fine: np.ndarray, coarse: np.ndarray, shortest: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(at, length, copies): for each start the longest block that repeats and has no repeat of coarse values inside."""
        free, n = self.free(), len(fine)
        length, copies = np.zeros(n, np.int64), np.zeros(n, np.int64)
        reach = np.full(n, n + 2 * longest, np.int64)  # the end of the nearest coarse repeat that starts here or later
        for p in range(1, max(1, longest // 2) + 1):
            at = np.flatnonzero(self._streak(free, coarse, p) >= p)
            reach[at] = np.minimum(reach[at], at + 2 * p)
        reach = np.minimum.accumulate(reach[::-1])[::-1]
        for p in range(shortest, longest + 1):
            left = self._streak(free, fine, p)
            at = np.flatnonzero(left >= p)
            at = at[at + p < reach[at]]
            length[at], copies[at] = p, left[at] // p + 1
        at = np.flatnonzero(length)
        return at, length[at], copies[at]

    def blocks(self, kind: int, fine: np.ndarray, coarse: np.ndarray, shortest: int, longest: int) -> None:
        """Claim blocks in order of their starts.

        A start is passed over within an earlier block, or if the free unit before it, unless that ends the last claimed
        block, has the same coarse value: the repeat would then begin earlier in a form that doesn't match whole.
        """
        at, length, copies = self.candidates(fine, coarse, shortest, longest)
        if not len(at):
            return
        free = self.free()
        before = np.maximum(at - 1, 0)
        wall = (at > 0) & free[before] & free[at] & (self.span[before] == self.span[at]) & (coarse[before] == coarse[at])
        stop = at + length * copies
        pays = self._pays(kind, at, length, stop, copies - 1)
        taken, end = [], -1
        for i, (a, z, w) in enumerate(zip(at.tolist(), stop.tolist(), (wall | ~pays).tolist(), strict=True)):
            if a >= end and (not w or (a == end and pays[i])):
                taken.append(i)
                end = z
        self._claim(kind, at[taken], length[taken], stop[taken], copies[taken] - 1)

    def crowded(self, value: np.ndarray, among: np.ndarray) -> np.ndarray:
        """The spans in which more different values than the table holds stand at the units `among`."""
        sizes = np.bincount(self.span, minlength=len(self.widths))
        out = [s for s in np.flatnonzero(sizes > self.table_keys) if len(np.unique(value[among & (self.span == s)])) > self.table_keys]
        return np.array(out, np.int64)


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that are equal where values are."""
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() if len(column) else np.zeros(0, np.int32)


def _heads(t: pa.Table) -> np.ndarray:
    """Whether each piece begins a span."""
    payload, number = (_codes(t.column(c)) for c in SPAN)
    return np.append(True, (payload[1:] != payload[:-1]) | (number[1:] != number[:-1]))


def _units(t: pa.Table, table_keys: int = TABLE_KEYS) -> tuple[Spans, np.ndarray, np.ndarray, np.ndarray]:
    """A table's spans, where they begin, which pieces are units, and the span of each piece."""
    new = _heads(t)
    head, span = np.flatnonzero(new), np.cumsum(new) - 1
    size, gap = t.column("size").to_numpy().astype(np.int64), t.column("gap").to_numpy()
    whole = np.cumsum(size + gap)
    end = whole - gap - (whole - size - gap)[head][span]
    unit = size > 0
    widths = np.array([WIDTHS[s] for s in t.column("style").take(pa.array(head)).to_pylist()])
    return Spans(span[unit], t.column("eligible").to_numpy()[unit], (end - size)[unit], end[unit], widths, table_keys), head, unit, span


def _values(t: pa.Table, unit: np.ndarray) -> list[np.ndarray | None]:
    return [_codes(t.column(c).filter(pa.array(unit))) if c in t.column_names else None for c in ("raw", "ws", "masked")]


def _found(t: pa.Table, carried: list[str], options: Options, stages: tuple[str, ...], table_keys: int) -> pa.RecordBatch:
    """One row a span of a table of pieces that holds whole spans."""
    spans, head, unit, span = _units(t, table_keys)
    raw, ws, masked = _values(t, unit)
    degraded = np.zeros(len(head), bool)
    if "exact_run" in stages:
        spans.runs(KINDS.index("exact_run"), raw, options.min_group_size)
    if "ws_run" in stages and options.normalize_ws:
        spans.runs(KINDS.index("ws_run"), ws, options.min_group_size)
    if masked is not None:
        degraded[spans.crowded(masked, np.ones(len(masked), bool))] = True
    if "block" in stages:
        degraded[spans.crowded(ws, spans.free())] = True
        spans.blocks(KINDS.index("block"), ws, masked, MIN_BLOCK_LINES, MAX_BLOCK_LINES)
    if "template_group" in stages and options.template_dedup:
        spans.runs(KINDS.index("template_group"), masked, options.min_group_size)
    if "templated_block" in stages and options.template_dedup:
        spans.blocks(KINDS.index("templated_block"), masked, masked, 1, MAX_BLOCK_LINES)
    found = spans.found or [(np.zeros(0, np.int64),) * 5]
    kind, first, anchor, stop, count = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(first, kind="stable")
    kind, first, anchor, stop, count = (c[order] for c in (kind, first, anchor, stop, count))
    owner = spans.span[first]
    base = t.column("base").to_numpy()[head][owner]
    units = np.bincount(spans.span, minlength=len(head))
    ahead = (np.cumsum(units) - units)[owner]
    i32 = lambda x: pa.array(x.astype(np.int32))
    begin = i32(base + spans.start[first])
    names = pa.DictionaryArray.from_arrays(i32(kind), pa.array(KINDS)).cast(pa.string())
    columns = {"kind": names, "first": i32(first - ahead), "last": i32(stop - 1 - ahead), "count": pa.array(count.astype(np.int64)), "anchor_start": begin, "anchor_end": i32(base + spans.end[first + anchor - 1]), "removed_start": begin, "removed_end": i32(base + spans.end[stop - 1])}
    per = np.bincount(owner, minlength=len(head))
    commits = pa.ListArray.from_arrays(i32(np.append(0, np.cumsum(per))), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))
    splits = np.bincount(span[t.column("head").to_numpy(zero_copy_only=False)], minlength=len(head))
    return _batch(t, carried, head, {"n_units": pa.array(units), "degraded": pa.array(degraded), "record_splits": pa.array(splits), "commits": commits})


def _batch(t: pa.Table, carried: list[str], at: np.ndarray, more: dict[str, pa.Array]) -> pa.RecordBatch:
    kept = [t.column(c).take(pa.array(at)).combine_chunks() for c in carried]
    return pa.RecordBatch.from_arrays([*kept, *more.values()], names=[*carried, *more])


def _whole_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole spans, of TOGETHER pieces at least; the span that may go on waits for the next one."""
    held: list[pa.RecordBatch] = []
    n = cut = 0
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        at = np.flatnonzero(_heads(pa.Table.from_batches([b])))[-1]
        if at or last != tuple(b.column(c)[0] for c in SPAN):
            cut = n + int(at)
        last = tuple(b.column(c)[-1] for c in SPAN)
        held.append(b)
        n += b.num_rows
        if cut and n >= TOGETHER:
            t = pa.Table.from_batches(held)
            yield t.slice(0, cut)
            held, n, cut = t.slice(cut).to_batches(), n - cut, 0
    if held:
        yield pa.Table.from_batches(held)


#: What split_pieces() adds to a span, beside which its columns are carried through.
PIECE = {"base", "over_cap", "head", "gap", "eligible", "raw"}


def _forms(pieces: DataFrame, stages: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """pieces with the forms that the stages compare, and the names of the columns that are carried."""
    carried = [c for c in pieces.columns if c not in PIECE]
    forms = {"raw": F.col("raw")}
    if set(stages) != {"exact_run"}:
        pieces = pieces.withColumn("_ws", T.normalize_ws(F.col("raw")))
        forms["ws"] = F.col("_ws")
    if set(stages) & {"block", "template_group", "templated_block"}:
        forms["masked"] = T.mask(F.col("_ws"))
    return pieces.select(*carried, "base", "head", "gap", "eligible", F.length("raw").alias("size"), *[c.alias(n) for n, c in forms.items()]), carried


def _schema(pieces: DataFrame, carried: list[str], more: str) -> StructType:
    return StructType([pieces.schema[c] for c in carried] + list(_parse_datatype_string(more)))


def find_groups(pieces: DataFrame, options: Options = Options(), stages: tuple[str, ...] = KINDS, table_keys: int = TABLE_KEYS) -> DataFrame:
    """Commits of split_pieces(): a span's own columns, n_units, degraded, record_splits and commits, one row a span.

    Each stage sees what the earlier ones left; byte ranges are within the payload. The pieces of a span come one after the
    other, as split_pieces() leaves them; nothing is shuffled or sorted here. Spans are gathered up to TOGETHER units, so
    memory is bounded by that or the largest span. A span whose different forms exceed table_keys is degraded: its commits
    are listed, but don't count.
    """
    asked, carried = _forms(pieces, stages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_spans(batches):
            yield _found(t, carried, options, stages, table_keys)

    return asked.mapInArrow(run, _schema(pieces, carried, f"n_units long, degraded boolean, record_splits long, commits {COMMITS}"))


def block_starts(pieces: DataFrame) -> DataFrame:
    """The longest repeated block of templates at each start, before any is chosen: a span's own columns, at, length, copies."""
    asked, carried = _forms(pieces, ("templated_block",))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_spans(batches):
            spans, head, unit, _ = _units(t)
            masked = _values(t, unit)[2]
            at, length, copies = spans.candidates(masked, masked, MIN_BLOCK_LINES, MAX_BLOCK_LINES)
            units = np.bincount(spans.span, minlength=len(head))
            owner = spans.span[at]
            yield _batch(t, carried, head[owner], {"at": pa.array(at - (np.cumsum(units) - units)[owner]), "length": pa.array(length), "copies": pa.array(copies)})

    return asked.mapInArrow(run, _schema(pieces, carried, "at long, length long, copies long"))
