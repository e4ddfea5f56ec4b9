"""Tokenising operators against the libraries, and exact round trips."""

import hashlib
import io
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from plisse.llm import byte_bpe, packing, token_files, word_tokens
from plisse.llm.common import shared_path

from .helpers import hostile, near_copies, table

BITS = ["a", "Ab", "é", "é", "ß", "  ", "\n", " ", "1", "%", "the", "日本", "🙂", "'s", "'ll", ".", ",", "İ", "ΑΣ", "<|endoftext|>", "ing", "\x1c", "ﬁ", "--", " ", "\t", " "]


def texts(seed=3, n=3000):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(n)] + [None, "", " ", "ab" * 3000, " " * 500]


@pytest.fixture(scope="module")
def word_bpe():
    return Tokenizer.from_file(word_tokens.TOKENIZER)


@pytest.fixture(scope="module")
def byte_bpe_library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(byte_bpe.RANKS), special_tokens={})


def test_word_encoder(word_bpe):
    given = texts()
    ids, ends = word_tokens.encoder(word_tokens.TOKENIZER).encode(pa.array(given))
    for i, t in enumerate(given):
        assert ids[ends[i] : ends[i + 1]].tolist() == word_bpe.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_byte_coder(byte_bpe_library):
    given = texts(4)
    coder = byte_bpe.coder(byte_bpe.RANKS, public_tokenizers.PATTERN)
    ids, ends = coder.encode(pa.array(given))
    for i, t in enumerate(given):
        own = ids[ends[i] : ends[i + 1]]
        assert own.tolist() == byte_bpe_library.encode_ordinary(t or ""), repr(t)
        assert coder.decode(own) == (t or "").encode()


def test_merge_replay_is_that_of_single_pieces(byte_bpe_library):
    rng = random.Random(8)
    replay = byte_bpe.MergeReplay(byte_bpe.load_ranks(byte_bpe.RANKS))
    pieces = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randint(1, 40))) for _ in range(2000)]
    assert replay.encode([p.encode() for p in pieces]) == [replay.alone(p.encode()) for p in pieces] == [byte_bpe_library.encode_ordinary(p) for p in pieces]


def test_byte_bpe_query(spark, byte_bpe_library):
    rows, df = hostile(spark)
    rows += [(100 + i, t) for i, t in enumerate(texts(5, 200))]
    df = df.select("doc_id", "text", "n").unionByName(table(spark, rows[10:]), allowMissingColumns=True)
    want = []
    for d, t in rows:
        ids = byte_bpe_library.encode_ordinary(t or "")
        want.append((str(d), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in byte_bpe.digest_documents(df).collect()) == sorted(want)
    coded = byte_bpe.encode_documents(df)
    assert sorted(bytes(r.content) for r in byte_bpe.decode_documents(coded).collect()) == sorted((t or "").encode() for _, t in rows)
    assert byte_bpe.digest_documents(table(spark, [])).isEmpty()


class Counting(io.BytesIO):
    """A file that tells how much was read of it."""

    taken = 0

    def size(self):
        return len(self.getvalue())

    def read(self, *a):
        out = super().read(*a)
        self.taken += len(out)
        return out


@pytest.mark.parametrize("wide", [False, True])
def test_frames_round_trip_and_only_what_is_asked_for_is_read(wide):
    rng = np.random.default_rng(2)
    docs = [(i * 2 if i >= 3 else None, rng.integers(0, 40_000 << 16 * wide, rng.integers(0, 3000))) for i in range(800)]
    sink = io.BytesIO()
    writer = token_files.FrameWriter(sink, wide=wide)
    for d, ids in docs:
        writer.add(d, ids)
    writer.close()
    source = Counting(sink.getvalue())
    reader = token_files.FrameReader(source)
    assert len(reader.frames) > 5 and [(d, x.tolist()) for d, x in reader] == [(d, x.tolist()) for d, x in docs]
    source.taken = 0
    assert [(d, x.tolist()) for d, x in reader.documents([10, 11, 1500])] == [(d, x.tolist()) for d, x in docs if d in (10, 1500)]
    assert source.taken < len(sink.getvalue()) / 2
    broken = bytearray(sink.getvalue())
    broken[40] ^= 1
    with pytest.raises(Exception, match="."):
        token_files.FrameReader(Counting(bytes(broken))).frame(0)
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(sink.getvalue()), read_across_frames=True).read()
    assert len(whole) == sum(f[1] for f in reader.frames)  # any zstandard reader takes the file, skipping what is skippable


def test_token_files(spark, word_bpe):
    rows = near_copies(n=200) + [(10_001, None), (10_002, "")]
    folder = shared_path(spark, "test-tokens")
    files = token_files.manifest(token_files.write_tokens(table(spark, rows), folder))
    want, at = {}, 0
    for d, t in sorted(rows):
        ids = np.array([*word_bpe.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want[d] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    got = token_files.read_tokens(spark, folder, files)
    assert {r.doc_id: tuple(r)[1:4] for r in got.collect()} == want
    some = token_files.read_tokens(spark, folder, files, [3, 10_001, 77]).collect()
    assert {r.doc_id: (r.start, r.n_tokens) for r in some} == {3: (None, want[3][1]), 10_001: (None, 1)}


def test_token_files_of_odd_input(spark):
    rows, df = hostile(spark)
    folder = shared_path(spark, "test-tokens")
    files = token_files.manifest(token_files.write_tokens(df, folder))
    got = token_files.read_tokens(spark, folder, files).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d) for d, _ in rows)
    first = sorted(got, key=lambda r: (r.start, r.n_tokens))[:2]
    assert [(r.doc_id, r.start) for r in first] == [(None, 0), (None, 1)] and first[0].n_tokens == 1  # the null text before the other
    empty = shared_path(spark, "test-tokens")
    assert token_files.read_tokens(spark, empty, token_files.manifest(token_files.write_tokens(table(spark, []), empty))).isEmpty()


def check_packing(rows, got, word_bpe, window=4096):
    by, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, t in rows:
        own = sorted(by[d], key=lambda r: r.start)
        ids = [*word_bpe.encode(t or "", add_special_tokens=False).ids, 2]
        assert [x for r in own for x in r.ids] == ids and all(r.doc_tokens == len(ids) for r in own)
    fills = []
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        fills.append(at)
    return fills


def test_packing(spark, word_bpe):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gam ma", "42"]) for _ in range(rng.choice([0, 5, 60, 700, 9000])))) for i in range(120)] + [(900, None)]
    fills = check_packing(rows, packing.pack(table(spark, rows, parts=2)).collect(), word_bpe)
    assert sum(f < 4096 for f in fills) <= 2
    assert packing.pack(table(spark, [])).isEmpty()


def squares(level, window):
    return int((level[1:window] ** 2).sum())


@pytest.mark.parametrize("most", [10_000, 6])
def test_sum_of_squares_places_where_the_sum_is_least(most):
    """By trying every level; with few windows allowed pieces are cut where that leaves the least sum, and none is lost."""
    rng = random.Random(6)
    packer, window = packing.SumOfSquares(50, most), 50
    sizes, placed, cuts = [rng.randint(1, 50) for _ in range(600)], {}, 0
    for k, size in enumerate(sizes):
        before = packer.level.copy()
        was = int(before[1:window].sum())
        full = packer.place(k, 0, size)
        whole, cut = [], []
        for h in range(window):
            if h and not before[h]:
                continue
            n = before.copy()
            n[h] -= h > 0
            if h + size <= window:
                n[h + size] += h + size < window
                if h or was < most or size == window:
                    whole.append(squares(n, window))
            elif was >= most:
                n[h + size - window] += 1
                cut.append(squares(n, window))
        # At the bound a piece is cut only where a new window is better than any open one, or no open one has room.
        new = before.copy()
        new[size] += size < window
        best = min(whole) if whole else None
        if cut and (best is None or best > squares(new, window)):
            cuts += 1
            best = min(cut)
        assert squares(packer.level, window) == best and packer.count == int(packer.level[1:window].sum()) <= most
        assert full is None or sum(s for _, _, s in full) == window
        for d, start, s in full or ():
            placed.setdefault(d, []).append((start, s))
    for pieces in packer.drain():
        for d, start, s in pieces:
            placed.setdefault(d, []).append((start, s))
    assert (cuts > 20) == (most == 6)
    for k, size in enumerate(sizes):
        at = 0
        for start, s in sorted(placed[k]):
            assert start == at
            at += s
        assert at == size


def test_packing_places_most_by_the_sum_of_squares(spark, word_bpe, monkeypatch):
    """Of the sequences of one task, those poured together at the end are fewer than the windows that may be open."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randint(50, 1500)))) for i in range(900)]
    got = packing.pack(table(spark, rows, parts=1)).collect()
    check_packing(rows, got, word_bpe)
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    assert len({r.sequence_id for r in got}) > 3 * packing.OPEN
    assert sum(len(p) == 1 for p in pieces.values()) > 450


def test_packing_of_odd_input(spark, word_bpe):
    rows, df = hostile(spark)
    got = packing.pack(df).collect()
    assert {str(r.doc_id) for r in got} == {str(d) for d, _ in rows}
    want = sorted((str(d), len(word_bpe.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in rows)
    # Each row begins once, whole or cut, and its lengths add up to its ids.
    assert sorted((str(r.doc_id), r.doc_tokens) for r in got if r.start == 0) == want
    assert sum(r.length for r in got) == sum(n for _, n in want)
