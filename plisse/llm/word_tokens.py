"""Batch encoding with a word-end BPE of the tokenizers library: each distinct word of a slice is encoded once."""

from __future__ import annotations

import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from .common import cache, only, spread

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Words of unusual form that a worker remembers; beyond it the memory is emptied, so that it stays bounded.
REMEMBER = 100_000
#: Bytes of text that are encoded at once: large enough that words repeat.
SLICE = 4 << 20
#: A run of Latin letters that normalisation leaves letters one by one, and after it ASCII marks: the splitter makes the run
#: one piece and the marks another. No apostrophe, which can start a piece with letters, and no '<', which can start a special token.
USUAL = r'^(?P<stem>[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{148}\x{14A}-\x{17E}]+)(?P<tail>[!"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]*)$'


#: A text of all forms that the encoder treats differently; a vocabulary by which it comes out otherwise than whole is refused.
PROBE = "The Nile's naïve 42%, (well) don't\n\tΑΣ été... UPPER-case <x> 3.14 ok!? \u65e5\u672c e\u0301"


class Ragged:
    """Many short arrays of ids, one after the other."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths, self.starts = flat, lengths, np.cumsum(lengths) - lengths

    @staticmethod
    def of(parts: list[bytes]) -> Ragged:
        return Ragged(np.frombuffer(b"".join(parts), dtype=np.uint32), np.fromiter(map(len, parts), np.int64, len(parts)) // 4)

    def take(self, codes: np.ndarray) -> np.ndarray:
        return self.flat[spread(self.starts[codes], self.lengths[codes])]


class WordEncoder:
    """Ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False).

    The normaliser turns runs of white space into one space and the splitter drops it, so no token, composition or special
    string spans ASCII white space: the ids of a text are the ids of its words one after the other. The distinct words of a
    slice are encoded once. Letters and the marks after them are separate pieces, so runs of letters are encoded many to a
    text and told apart by the ids that end a word; words of any other form are encoded one by one.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True

    def _run(self, texts: list[str]) -> list[list[int]]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for at in range(0, len(texts), 500) for e in encode(texts[at : at + 500], add_special_tokens=False)]

    def _stems(self, stems: list[str]) -> Ragged:
        groups = [stems[at : at + 512] for at in range(0, len(stems), 512)]
        flat, lengths = [], []
        for at in range(0, len(groups), 32):
            part = groups[at : at + 32]
            for group, ids in zip(part, self._run([" ".join(g) for g in part]), strict=True):
                ids = np.array(ids, dtype=np.uint32)
                n = np.diff(np.flatnonzero(self.ends_word[ids]) + 1, prepend=0)
                if len(n) != len(group):  # not as this vocabulary was expected to behave
                    ids = np.array([i for x in self._run(group) for i in x], dtype=np.uint32)
                    n = np.array([len(x) for x in self._run(group)])
                flat.append(ids)
                lengths.append(n)
        return Ragged(np.concatenate(flat), np.concatenate(lengths)) if flat else Ragged(np.zeros(0, np.uint32), np.zeros(0, np.int64))

    def _others(self, words: list[str]) -> Ragged:
        known = self.words
        if len(known) > REMEMBER:
            known.clear()
        new = [w for w in words if w not in known]
        for w, ids in zip(new, self._run(new), strict=True):
            known[w] = np.array(ids, dtype=np.uint32).tobytes()
        return Ragged.of([known[w] for w in words])

    def _distinct(self, words: pa.Array) -> Ragged:
        """The ids of each of the words."""
        split = pc.extract_regex(words, USUAL)
        usual = split.is_valid().to_numpy(zero_copy_only=False)
        split = split.filter(split.is_valid())
        stem = pc.struct_field(split, "stem")
        stem = pc.if_else(pc.string_is_ascii(stem), pc.ascii_lower(stem), stem).dictionary_encode()
        tail = pc.struct_field(split, "tail").dictionary_encode()
        parts = [(self._stems(stem.dictionary.to_pylist()), stem.indices.to_numpy()), (self._others(tail.dictionary.to_pylist()), tail.indices.to_numpy())]
        lengths = np.zeros(len(words), np.int64)
        rest = self._others(words.filter(pa.array(~usual)).to_pylist())
        sizes = [r.lengths[codes] for r, codes in parts]
        lengths[usual], lengths[~usual] = sizes[0] + sizes[1], rest.lengths
        starts = np.cumsum(lengths) - lengths
        flat = np.empty(int(lengths.sum()), np.uint32)
        flat[spread(starts[usual], sizes[0])] = parts[0][0].take(parts[0][1])
        flat[spread(starts[usual] + sizes[0], sizes[1])] = parts[1][0].take(parts[1][1])
        flat[spread(starts[~usual], rest.lengths)] = rest.flat
        return Ragged(flat, lengths)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids as uint32, one text after the other, and where each text starts and the last one ends. Null is empty."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        ends = np.asarray(split.offsets).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        words, codes = self._distinct(coded.dictionary), coded.indices.to_numpy()
        return words.take(codes), np.concatenate(([0], np.cumsum(words.lengths[codes])))[ends - ends[0]]


_encoders: dict[str, WordEncoder] = cache()


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file; it outlives the task."""
    only(_encoders)
    if path not in _encoders:
        made = WordEncoder(path)
        ids, _ = made.encode(pa.array([PROBE]))
        if ids.tolist() != made.tokenizer.encode(PROBE, add_special_tokens=False).ids:
            raise ValueError(f"{path} doesn't normalise and split as WordEncoder expects")
        _encoders[path] = made
    return _encoders[path]


def closed(ids: np.ndarray, ends: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with end_id appended to each text."""
    n = len(ends) - 1
    return np.insert(ids, ends[1:], np.uint32(end_id)), ends + np.arange(n + 1)
