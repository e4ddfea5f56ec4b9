"""Quality classifier: hashed word and character n-gram vectors, averaged, softmax output, trained by numpy SGD.

A text's features are its words, the n-grams of their characters, and its pairs of neighbouring words. A pair is hashed by its
pattern alone, whether its words are equal: most words of a new text are unknown to training, so pairs of them would be too.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cache, fresh, mix, only, slices, table, trim, widened

BUCKETS, DIM, GRAMS = 1 << 16, 16, (3, 4)
#: Rows of the embedding after those of words and characters: patterns of pairs, of different words and of equal ones.
PAIRS = 2
#: Bounds on the labelled documents that the model is trained on, and on the bytes of their texts together; passes over them.
SAMPLE_DOCS, SAMPLE_BYTES, EPOCHS, RATE = 3000, 24 << 20, 5, 0.5
FOLDS = 5
CUT = 0.3
#: Distinct words whose vectors a worker remembers (68 bytes each and the word).
REMEMBER = 120_000


def split_words(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words, the code of each word in order, and where each text's words start and the last one's end."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    ends = np.asarray(split.offsets).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    words, codes, ends = coded.dictionary.to_pylist(), coded.indices.to_numpy(), ends - ends[0]
    if "" in words:  # white space at a text's ends, or nothing else in it
        real = codes != words.index("")
        codes, ends = codes[real], np.concatenate(([0], np.cumsum(real)))[ends]
    return words, codes, ends


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every feature: the word itself and the n-grams of its characters between < and >."""
    points = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    left = ends[owner] - np.arange(len(points))  # characters from here to the word's end
    hashed = mix(points)
    out_words, out_buckets = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = mix(h * np.uint64(31) + hashed[at + k])
        out_words.append(owner[at])
        out_buckets.append(h % np.uint64(BUCKETS))
    # The whole word: the sum of its characters' hashes, each mixed with its place.
    place = lengths[owner] - left
    whole = np.add.reduceat(mix(hashed ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), ends - lengths) if len(words) else np.zeros(0, np.uint64)
    out_words.append(np.arange(len(words)))
    out_buckets.append(mix(whole) % np.uint64(BUCKETS))
    return np.concatenate(out_words), np.concatenate(out_buckets).astype(np.int64)


def repeats(codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: the number of words that differ from the word before them, and of those that repeat it."""
    same = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(np.append(False, codes[1:] == codes[:-1])[: len(codes)], out=same[1:])
    n = np.diff(ends)
    first = np.minimum(ends[:-1] + 1, ends[1:])  # a text's first word has none before it
    equal = same[ends[1:]] - same[first]
    return np.maximum(0, n - 1) - equal, equal


def _sorted_features(words: list[str], chunk: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, one word after the other, and where each starts and the last one ends."""
    buckets, sizes = [], []
    for at in range(0, len(words), chunk):
        part = words[at : at + chunk]
        fw, fb = features(part)
        order = np.argsort(fw, kind="stable")
        buckets.append(fb[order].astype(np.int32))
        sizes.append(np.bincount(fw, minlength=len(part)))
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(1, np.int64)
    return np.concatenate(buckets), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))


def train(texts: list[str | None], labels: list[int], seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Embeddings, output weights and bias by stochastic gradient descent on the softmax loss, one document at a time."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + PAIRS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    words, codes, ends = split_words(pa.array(texts, pa.string()))
    docs = []
    differ, equal = repeats(codes, ends)
    fb, starts = _sorted_features(words)
    for i in range(len(texts)):
        used, count = np.unique(codes[ends[i] : ends[i + 1]], return_counts=True)
        size = starts[used + 1] - starts[used]
        buckets = np.concatenate([fb[starts[u] : starts[u + 1]] for u in used]) if len(used) else np.zeros(0, np.int32)
        at, inverse = np.unique(buckets, return_inverse=True)
        weight = np.bincount(inverse, weights=np.repeat(count, size), minlength=len(at)).astype(np.float32)
        at, weight = np.append(at, [BUCKETS, BUCKETS + 1]).astype(np.int32), np.append(weight, [differ[i], equal[i]]).astype(np.float32)
        docs.append((at, weight / max(1.0, weight.sum())))
    steps, total = 0, max(1, EPOCHS * len(docs))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            at, weight = docs[i]
            rate = np.float32(RATE * (1 - steps / total))
            steps += 1
            hidden = weight @ emb[at]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out @ p
            out -= rate * np.outer(hidden, p)
            bias -= rate * p
            # Frequent features shouldn't be the only ones that move: the gradient is that of the average, scaled by DIM.
            emb[at] -= (rate * DIM) * weight[:, None] * back
    return emb, out, bias


class Scorer:
    """Scores texts; remembers the sum of the feature vectors, and their number, of each word it has met."""

    def __init__(self, model: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.emb, self.out, self.bias = model
        self.known: dict[str, int] = {}
        self.vectors = np.zeros((1024, DIM + 1), np.float32)

    def learn(self, words: list[str]) -> None:
        if len(self.known) > REMEMBER:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        base = len(self.known)
        while base + len(new) > len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        for at in range(0, len(new), 8192):
            part = new[at : at + 8192]
            fw, fb = features(part)
            order = np.argsort(fw, kind="stable")
            fw, fb = fw[order], fb[order]
            starts = np.searchsorted(fw, np.arange(len(part)))
            rows = self.vectors[base + at : base + at + len(part)]
            rows[:, :DIM] = np.add.reduceat(self.emb[fb], starts, axis=0)
            rows[:, DIM] = np.diff(np.append(starts, len(fw)))
        self.known.update(zip(new, range(base, base + len(new)), strict=True))

    def score(self, texts: pa.Array) -> np.ndarray:
        words, codes, ends = split_words(texts)
        self.learn(words)
        rows = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[codes] if len(words) else np.zeros(0, np.int64)
        sums = np.zeros((len(ends) - 1, DIM + 1))
        full = np.flatnonzero(np.diff(ends))
        if len(full):
            sums[full] = np.add.reduceat(self.vectors[rows], ends[:-1][full], axis=0, dtype=np.float64)
        for k, n in enumerate(repeats(codes, ends)):
            sums += n[:, None] * np.append(self.emb[BUCKETS + k], 1.0)
        z = (sums[:, :DIM] / np.maximum(1, sums[:, DIM:])) @ self.out + self.bias
        return 1 / (1 + np.exp(z[:, 0] - z[:, 1]))


_scorers: dict[str, Scorer] = cache()
_SHAPES = ((BUCKETS + PAIRS, DIM), (DIM, 2), (2,))


def _pack(model: tuple[np.ndarray, ...]) -> bytes:
    return b"".join(x.astype("<f4").tobytes() for x in model)


def _unpack(raw: bytes) -> tuple[np.ndarray, ...]:
    flat, out, at = np.frombuffer(raw, "<f4"), [], 0
    for shape in _SHAPES:
        n = int(np.prod(shape))
        out.append(flat[at : at + n].reshape(shape).copy())
        at += n
    return tuple(out)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> bytes:
    """The model, of a size that BUCKETS and DIM fix, trained on at most `sample` labelled documents of the training folds
    (those with the smallest hashes of their ids) and `most_bytes` of their whole texts.

    The ids are chosen from labels alone; their documents are found by a broadcast of at most `sample` ids, so texts aren't
    shuffled. One executor's task gets the sample and trains; the driver holds the model alone. A text that would exceed the
    bytes left is no part of the sample; none is cut. Only texts and labels reach the model. Without any label every score
    is 0.5.
    """
    chosen = labels.where("doc_id is not null and quality is not null").where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= most_bytes).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample).select("text", (F.col("quality") == 1).cast("int").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, marks, left = [], [], most_bytes
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                size = len((text or "").encode())
                if size <= left:
                    texts.append(text)
                    marks.append(label)
                    left -= size
        yield pa.RecordBatch.from_arrays([pa.array([_pack(train(texts, marks))], pa.binary())], names=["model"])
        del texts, marks
        trim()

    model = rows.coalesce(1).mapInArrow(run, "model binary").first()  # none where Spark knows that there are no rows
    return bytes(model.model) if model else _pack(train([], []))


def score_documents(docs: DataFrame, model: bytes, name: str = "score") -> DataFrame:
    """docs with a last column `name` double, the model's score of text."""
    sent, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    names = [*docs.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(_scorers)
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(_unpack(sent.value))
        own = _scorers[key]
        for b in slices(batches, limit=2 << 20):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.score(b.column("text")))], names=names)

    return docs.mapInArrow(run, widened(docs, (name, "double")))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted) of docs(doc_id, text), the classifier fitted to labels(doc_id, quality).

    A null or empty text has no features and gets the score of the output's bias; a null doc_id is never held out; repeated
    rows are scored alike; a label given twice counts as the lower one; an empty table gives no rows; other columns are
    ignored. Scores depend on the text alone.
    """
    scored = score_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), fit(docs, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, all columns kept, without the rows that the classifier, fitted to them and labels, predicts to be of quality 0.

    A null or empty text is judged by the output's bias, as in score_quality(); null doc_ids, repeated rows and ties are
    judged by their text alone; an empty table gives no rows; the score's column takes a name that docs hasn't.
    """
    (name,) = fresh(docs, "score")
    return score_documents(docs, fit(docs, labels), name).where(F.col(name) >= CUT).drop(name)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
