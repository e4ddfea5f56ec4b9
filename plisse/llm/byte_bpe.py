"""Byte-level BPE by corpus-level merge replay over the distinct pieces of a corpus, and its decoding.

Texts become numbers of their slice's distinct words, and words those of its distinct pieces. The pieces of all slices meet
by ranges of their hash, where each distinct one of the corpus stands once; a range replays the merges over all of its
pieces and answers every slice that asked. With the answers the slices' numbers become ids.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import heapq
import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import exchange
from .common import cache, only, save, shared_path, slices, table, tidy
from .word_tokens import Ragged

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Bytes of text whose distinct words and pieces are numbered together; level of compression of what is kept of them.
SLICE, LEVEL = 8 << 20, 6


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Encodes many distinct pieces at once.

    The pieces lie one after the other in one array of token positions, linked to their neighbours. An inverted index leads
    from each pair of adjacent tokens to the positions where it stands, and a heap holds the ranks of the pairs present. The
    lowest rank is applied at all its positions, left to right; only the two neighbours of a merged position are indexed
    anew. A piece alone would always merge its lowest pair, leftmost first, so the replay gives the same ids as long as no
    merge creates a pair of lower rank than one still due in the same round; a piece where that happens is encoded alone.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.vocabulary = {v: k for k, v in ranks.items()}
        self.first = [ranks[bytes([b])] for b in range(256)]
        #: The id of every pair of ids whose bytes together are in the vocabulary, by left << 20 | right.
        self.merged = {ranks[k[:i]] << 20 | ranks[k[i:]]: r for k, r in ranks.items() for i in range(1, len(k)) if k[:i] in ranks and k[i:] in ranks}

    def rank(self, left: int, right: int) -> int:
        """The id of the merged pair, -1 if there is none."""
        return self.merged.get(left << 20 | right, -1)

    def alone(self, piece: bytes) -> list[int]:
        """One piece by repeated search of its lowest pair; a piece of n bytes takes about n log n steps."""
        ids = [self.first[b] for b in piece]
        n = len(ids)
        nxt, prv, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank(ids[i], ids[i + 1])) >= 0]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if live[i] else n
            if not live[i] or ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], live[j], nxt[i] = r, False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
                if (q := self.rank(r, ids[nxt[i]])) >= 0:
                    heapq.heappush(heap, (q, i, r, ids[nxt[i]]))
            if prv[i] >= 0 and (q := self.rank(ids[prv[i]], r)) >= 0:
                heapq.heappush(heap, (q, prv[i], ids[prv[i]], r))
        return [x for x, ok in zip(ids, live, strict=True) if ok]

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        out: list[list[int] | None] = [[w] if (w := self.ranks.get(p)) is not None else None for p in pieces]
        todo = [k for k, x in enumerate(out) if x is None]
        first, ids, begin = self.first, [], []
        for k in todo:
            begin.append(len(ids))
            ids += [first[b] for b in pieces[k]]
            ids.append(-1)  # a wall between pieces
        n = len(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        find = self.merged.get
        where: dict[int, list[int]] = {}
        for i in range(n - 1):
            # A wall on either side makes the key negative, which isn't in the table.
            if (r := find(ids[i] << 20 | ids[i + 1])) is not None:
                if r in where:
                    where[r].append(i)
                else:
                    where[r] = [i]
        heap = list(where)
        heapq.heapify(heap)
        odd: set[int] = set()
        while heap:
            r = heapq.heappop(heap)
            spots = where.pop(r, None)
            if spots is None:
                continue
            spots.sort()
            for i in spots:
                j = nxt[i]
                # Different pairs can have the same bytes, and so the same rank; the place must still hold one of them.
                if ids[i] < 0 or find(ids[i] << 20 | ids[j]) != r:
                    continue
                ids[i] = r
                ids[j] = -2
                k = nxt[i] = nxt[j]
                prv[k] = i
                if (q := find(r << 20 | ids[k])) is not None:
                    if q in where:
                        where[q].append(i)
                    else:
                        where[q] = [i]
                        heapq.heappush(heap, q)
                    if q <= r:
                        odd.add(i)
                h = prv[i]
                if h >= 0 and (q := find(ids[h] << 20 | r)) is not None:
                    if q in where:
                        where[q].append(h)
                    else:
                        where[q] = [h]
                        heapq.heappush(heap, q)
                    if q <= r:
                        odd.add(i)
        alone = {bisect.bisect_right(begin, i) - 1 for i in odd}
        for m, (k, at) in enumerate(zip(todo, begin, strict=True)):
            out[k] = self.alone(pieces[k]) if m in alone else [x for x in ids[at : at + len(pieces[k])] if x >= 0]
        return out


class Splitter:
    """Cuts texts into distinct units (a word with the space before it, or a text's beginning), and these into pieces."""

    def __init__(self, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        self.usual = pattern == public_tokenizers.PATTERN

    def _spaced(self, words: pa.Array) -> list[list[str]]:
        """The pieces of each word with a space before it. Letters, then marks without an apostrophe, are two pieces."""
        split = pc.extract_regex(words, r"^(?P<stem>\p{L}+)(?P<tail>[!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)$")
        stems, tails = (pc.struct_field(split, f).to_pylist() for f in ("stem", "tail"))
        return [self.find(" " + w) if a is None else [" " + a, z] if z else [" " + a] for w, a, z in zip(words.to_pylist(), stems, tails, strict=True)]

    def split(self, texts: pa.Array) -> tuple[list[str], Ragged, np.ndarray, np.ndarray]:
        """(distinct pieces, pieces of each unit, units of all texts one text after the other, where each text starts and the
        last one ends). Null is empty.

        Where no space has white space beside it, each space begins a piece, and white space of other kinds lies within the
        words between: such texts are cut at their spaces. Others are one unit each.
        """
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        plain = ~pc.match_substring_regex(texts, r" \s|\s |[\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]").to_numpy(zero_copy_only=False) & self.usual
        split = pc.split_pattern(pc.if_else(pa.array(plain), texts, pa.scalar("", pa.large_string())), " ")
        ends = np.asarray(split.offsets).astype(np.int64)
        ends -= ends[0]
        coded = split.flatten().dictionary_encode()
        units = coded.indices.to_numpy().astype(np.int64)
        # The first word of a text has no space before it; a text of another form stands there as a whole.
        firsts = coded.dictionary.take(pa.array(units[ends[:-1]])).to_pylist()
        whole = iter(texts.filter(pa.array(~plain)).to_pylist())
        parts = self._spaced(coded.dictionary) + [self.find(f if ok else next(whole)) for f, ok in zip(firsts, plain, strict=True)]
        units[ends[:-1]] = len(coded.dictionary) + np.arange(len(texts))
        known: dict[str, int] = {}
        codes = np.fromiter((known.setdefault(p, len(known)) for x in parts for p in x), np.int64, sum(map(len, parts)))
        of_unit = Ragged(codes, np.fromiter(map(len, parts), np.int64, len(parts)))
        # The more frequent a unit the smaller its number, so that texts in numbers compress well.
        order = np.argsort(-np.bincount(units, minlength=len(parts)), kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        return list(known), Ragged(of_unit.take(order), of_unit.lengths[order]), rank[units], ends


class ByteCoder:
    """Encoding and decoding over one vocabulary."""

    def __init__(self, path: str, pattern: str):
        self.replay = MergeReplay(load_ranks(path))
        self.splitter = Splitter(pattern)
        words = [self.replay.vocabulary.get(i, b"") for i in range(max(self.replay.vocabulary) + 1)]
        self.words = Ragged(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)))
        self.decimal = np.array([str(i) for i in range(len(words))], dtype=object)

    def ids_of(self, pieces: list[bytes]) -> Ragged:
        ids = self.replay.encode(pieces)
        return Ragged(np.fromiter((i for x in ids for i in x), np.uint32, sum(map(len, ids))), np.fromiter(map(len, ids), np.int64, len(ids)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids as uint32 of texts that are a corpus by themselves, one text after the other, and where each text starts
        and the last one ends."""
        pieces, parts, units, ends = self.splitter.split(texts)
        return join(self.ids_of([p.encode() for p in pieces]), parts, units, ends)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.words.take(np.asarray(ids, np.int64)).tobytes()

    def digest(self, ids: np.ndarray) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the bytes decoded from the ids."""
        return len(ids), hashlib.sha256(",".join(self.decimal[ids]).encode()).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


def join(ids: Ragged, parts: Ragged, units: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts, given those of pieces, the pieces of units and the units of texts."""
    sizes = np.append(0, np.cumsum(ids.lengths[parts.flat]))
    starts = parts.starts
    whole = Ragged(ids.take(parts.flat), sizes[starts + parts.lengths] - sizes[starts])
    return whole.take(units), np.append(0, np.cumsum(whole.lengths[units]))[ends]


_coders: dict[tuple[str, str], ByteCoder] = cache()


def coder(path: str, pattern: str) -> ByteCoder:
    only(_coders)
    if (path, pattern) not in _coders:
        _coders[path, pattern] = ByteCoder(path, pattern)
    return _coders[path, pattern]


def _squeeze(x: np.ndarray) -> bytes:
    """Numbers below 2**32, their bytes by significance, compressed; the length first."""
    raw = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(raw)
    return struct.pack("<II", len(packed), len(x)) + packed


def _stretch(raw: bytes, at: int) -> tuple[np.ndarray, int]:
    """The numbers that begin there, and where they end."""
    size, n = struct.unpack_from("<II", raw, at)
    data = zstandard.ZstdDecompressor().decompress(raw[at + 8 : at + 8 + size], max_output_size=4 * n) if n else b""
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64), at + 8 + size


def _arrays(raw: bytes, n: int, at: int = 0) -> list[np.ndarray]:
    out = []
    for _ in range(n):
        x, at = _stretch(raw, at)
        out.append(x)
    return out


def _store(store: fs.FileSystem, name: str, parts: list[bytes]) -> None:
    """Write a file under another name first, so that a lost executor leaves none half written."""
    attempt = f"{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(attempt) as sink:
        for x in parts:
            sink.write(x)
    store.move(attempt, name)


def _read(store: fs.FileSystem, name: str) -> bytes:
    with store.open_input_file(name) as source:
        return source.read()


def _index(pattern: str, parts: int, folder: str):
    """Writes a slice's texts in numbers as a file; sends its distinct pieces by range of their hash, and its name to be listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        splitter, number = Splitter(pattern), TaskContext.get().partitionId() << 20
        for b in slices(batches, limit=SLICE):
            pieces, of_unit, units, ends = splitter.split(b.column("text"))
            ids = b.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            own = zstandard.ZstdCompressor(level=LEVEL).compress(np.asarray(ids.fill_null(0)).astype("<i8").tobytes() + null.astype(np.uint8).tobytes())
            _store(store, f"{root}/texts-{number}", [struct.pack("<II", len(own), len(null)), own, *map(_squeeze, (of_unit.lengths, of_unit.flat, units, ends))])
            yield from exchange.batches(asks(number, [p.encode() for p in pieces]))
            number += 1

    def asks(number: int, raw: list[bytes]) -> Iterator[tuple[int, bytes]]:
        name = struct.pack("<q", number)
        yield number % parts, name
        hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, raw), np.uint64, len(raw))
        for part, (at,) in exchange.split(exchange.part_of(hashed, parts), [np.arange(len(raw))]):
            own = [raw[i] for i in at.tolist()]
            yield part, name + _squeeze(np.diff(at, prepend=0)) + _squeeze(np.fromiter(map(len, own), np.int64, len(own))) + zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(own))

    return run


def _replay(ranks: str, pattern: str, parts: int):
    """A range's distinct pieces, encoded at once, and the answers to the slices, dealt by slice."""

    def run(groups: Iterator[tuple[int, Iterator[bytes]]]) -> Iterator[pa.RecordBatch]:
        for _, payloads in groups:
            own = coder(ranks, pattern)
            known: dict[bytes, int] = {}
            asked, named = [], []
            for x in payloads:
                if len(x) == 8:
                    named.append(x)
                    continue
                at, end = _stretch(x, 8)
                lengths, end = _stretch(x, end)
                raw, stops = zstandard.ZstdDecompressor().decompress(x[end:]), np.cumsum(lengths).tolist()
                asked.append((x[:8], at, np.fromiter((known.setdefault(raw[a:z], len(known)) for a, z in zip([0, *stops], stops, strict=False)), np.int64, len(stops))))
            ids = own.ids_of(list(known))
            del known
            yield from exchange.batches((struct.unpack("<q", number)[0] % parts, number) for number in named)
            yield from exchange.batches((struct.unpack("<q", number)[0] % parts, number + _squeeze(at) + _squeeze(ids.lengths[which]) + _squeeze(ids.take(which))) for number, at, which in asked)

    return run


def _answer(folder: str):
    """Writes what a slice's pieces are, in the order of the slice's numbers, as a file of the slice; lists the slice."""

    def run(groups: Iterator[tuple[int, Iterator[bytes]]]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for _, payloads in groups:
            held: dict[bytes, list[bytes]] = {}
            for x in payloads:
                held.setdefault(x[:8], []).append(x)
            for name, answers in held.items():
                (number,) = struct.unpack("<q", name)
                got = [_arrays(x, 3, 8) for x in answers if len(x) > 8]
                if got:
                    where = np.concatenate([np.cumsum(x[0]) for x in got])
                    ids = Ragged(np.concatenate([x[2] for x in got]), np.concatenate([x[1] for x in got]))
                    order = np.argsort(where)
                    _store(store, f"{root}/ids-{number}", [_squeeze(ids.lengths[order]), _squeeze(ids.take(order))])
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sum(len(x[0]) for x in got)], pa.int64())], names=["slice", "pieces"])

    return run


def _encoded(docs: DataFrame, ranks: str, pattern: str, emit: Callable[[ByteCoder, list, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """emit's rows of each slice's ids. Two files a slice, of its texts in numbers and of the answers, stay in the shared folder,
    as the result reads them."""
    parts, folder = exchange.ranges(docs), shared_path(docs.sparkSession, "piece-ids")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    asked = texts.mapInArrow(tidy(_index(pattern, parts, folder)), exchange.SCHEMA)
    listed = save(exchange.deal(exchange.deal(asked, _replay(ranks, pattern, parts), exchange.SCHEMA), _answer(folder), "slice long, pieces long"), "slices")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks, pattern)
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for number, pieces in zip(b.column("slice").to_pylist(), b.column("pieces").to_pylist(), strict=True):
                raw = _read(store, f"{root}/texts-{number}")
                size, n = struct.unpack_from("<II", raw)
                data = zstandard.ZstdDecompressor().decompress(raw[8 : 8 + size])
                doc_ids = pa.array(np.frombuffer(data, "<i8", n), pa.int64(), mask=np.frombuffer(data, np.uint8, n, 8 * n).astype(bool)).to_pylist()
                lengths, flat, units, ends = _arrays(raw, 4, 8 + size)
                sizes, every = _arrays(_read(store, f"{root}/ids-{number}"), 2) if pieces else [np.zeros(0, np.int64)] * 2
                ids, stops = join(Ragged(every, sizes), Ragged(flat, lengths), units, ends)
                for at in range(0, len(doc_ids), 1024):
                    cut = stops[at : at + 1025]
                    yield emit(own, doc_ids[at : at + 1024], ids[cut[0] : cut[-1]], cut - cut[0])

    return listed.repartition(parts, "slice").mapInArrow(tidy(run), schema)


def encode_documents(docs: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Rows (doc_id, ids array<int>) of docs(doc_id, text). Null text: no ids; repeated rows stay; other columns are ignored."""

    def emit(own: ByteCoder, doc_ids: list, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    return _encoded(docs, ranks, pattern, emit, "doc_id long, ids array<int>")


def decode_documents(coded: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Rows (doc_id, content binary) of coded(doc_id, ids array<int>); null ids give empty content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([own.decode(x or ()) for x in b.column("ids").to_pylist()], pa.binary())], names=["doc_id", "content"])

    return coded.select("doc_id", "ids").mapInArrow(run, "doc_id long, content binary")


def digest_documents(docs: DataFrame, ranks: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encode and decode every text; rows (doc_id, n_tokens, ids_sha256, decoded_sha256).

    Texts aren't shuffled: a slice's distinct pieces are, and their ids. A null text is empty: no ids, the digests of nothing.
    Repeated rows and null doc_ids are kept; an empty table gives no rows; other columns are ignored. Memory follows the slice
    of texts at hand (or one longer text) and the distinct pieces of a range, which has as many as a shuffle partition.
    """

    def emit(own: ByteCoder, doc_ids: list, ids: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
        got = [own.digest(ids[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)]
        n, coded, decoded = map(list, zip(*got, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(n, pa.int64()), pa.array(coded), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _encoded(docs, ranks, pattern, emit, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))
