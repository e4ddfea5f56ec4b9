"""N-gram Jaccard join by grouped prefixes.

Sets of word shingles link at a Jaccard similarity of 0.8 or more. Such sets share a shingle within their prefixes, the first
n - ceil(0.8 n) + 1 of a set of n in an order that all documents agree on: here by document frequency, then by hash. Only
shingles of two or more documents can be shared, so a set whose prefix holds none of them has no partner and goes no further;
for the others the shared shingles alone decide the intersection. Sets equal as a whole become one, sets of equal prefix and
size one group; groups are joined by their prefix shingles, their pairs filtered by size and position, then expanded to their
members and verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange
from .common import components, drop, fresh, mix, only, save, slices, table, text_buffer, tidy
from .suffix_dedup import Rolling

WORDS = 5
#: Similarity in hundredths.
SIMILAR = 80
#: Document frequencies from which shingles rank alike, by hash alone. A task sends a shingle that is this frequent in what it gathered
#: as a count, not as so many entries: its documents know the rank already.
FREQUENT = 64
#: Bytes of text made into shingles at once; shingles that a map task gathers before it sends them; entries that a reducing task
#: sorts at once (one document's at least).
SLICE, GATHER, SORTED = 1 << 20, 750_000, 400_000
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ODD = mix(np.arange(1, WORDS + 1, dtype=np.uint64)) | _U(1)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, shingle hash), distinct and sorted, of all texts; a text of fewer than WORDS words is one shingle."""
    data, ends = text_buffer(texts)
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data = _LOWER[data]
    letter = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    start = np.flatnonzero(letter & (edge[:-1] | np.append(True, ~letter[:-1])))
    stop = np.flatnonzero(letter & (edge[1:] | np.append(~letter[1:], True))) + 1
    word = Rolling(data).of(start, stop)
    text = np.searchsorted(ends, start, "right") - 1
    n = np.bincount(text, minlength=len(ends) - 1)
    begin = np.cumsum(n) - n
    place = np.arange(len(word)) - begin[text]
    # A shingle begins at each word that has WORDS - 1 after it, or at the first word of a short text.
    size = np.minimum(n, WORDS)
    at = np.flatnonzero(place <= (n - size)[text])
    h = np.zeros(len(at), np.uint64)
    for k in range(WORDS):
        has = k < size[text[at]]
        h[has] += word[at[has] + k] * _ODD[k]
    h = mix(h ^ size[text[at]].astype(np.uint64))
    owner = text[at]
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.append(True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])) if len(h) else np.zeros(0, bool)
    return owner[new], h[new]


def _low(x: np.ndarray) -> np.ndarray:
    """The low six bytes; the range that an entry goes to stands for the high ones, so 48 bits and those of its number remain."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])


def _widen(raw: np.ndarray, part: int) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view("<u8").ravel() | _U((part & 0xFFFF) << 48)


def _reduced(x: np.ndarray, parts: int) -> np.ndarray:
    """The same of a full hash."""
    return (x & _U((1 << 48) - 1)) | ((exchange.part_of(x, parts).astype(np.uint64) & _U(0xFFFF)) << _U(48))


def _steps(x: np.ndarray) -> np.ndarray:
    """Bytes of the differences of ascending numbers below 2**32, by significance: most are zero and compress away."""
    return np.ascontiguousarray(np.diff(x, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T)


def _unsteps(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(raw.reshape(4, -1).T).view("<u4").ravel().astype(np.int64))


def _doc_rows(uid: np.ndarray, doc: pa.Array, n: np.ndarray, *prints: np.ndarray) -> bytes:
    null = doc.is_null().to_numpy(zero_copy_only=False)
    return b"\2" + exchange.pack([uid, np.asarray(doc.fill_null(0)).astype(np.int64), null.astype(np.uint8), n.astype(np.int64), *prints])


DOC_KINDS = ["<i8", "<i8", "u1", "<i8", "<u8", "<u8", "<i8", "<i8"]
SHARED_KINDS = ["<i8", "<u8", "u1"]


def _index(parts: int):
    """Map side: documents, locally frequent shingles settled, and the rest by range of hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        base = first = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        size = 0
        for b in slices(batches, limit=SLICE):
            owner, h = shingle_sets(b.column("text"))
            n = np.bincount(owner, minlength=b.num_rows)
            f1, f2 = np.zeros(b.num_rows, np.uint64), np.zeros(b.num_rows, np.uint64)
            if len(h):
                full = np.flatnonzero(n)
                begin = (np.cumsum(n) - n)[full]
                f1[full] = np.add.reduceat(mix(h), begin)
                f2[full] = np.add.reduceat(mix(h ^ _U(0x5851F42D4C957F2D)), begin)
            keys = [b.column(k).to_numpy() for k in ("k1", "k2")]
            held.append((owner + (base - first), h, np.arange(base, base + b.num_rows), b.column("doc_id"), n, f1, f2, *keys))
            base += b.num_rows
            size += len(h)
            if size > GATHER:
                yield from exchange.batches(send(first, held))
                first, size = base, 0
        if held:
            yield from exchange.batches(send(first, held))

    def send(first: int, held: list[tuple]) -> Iterator[tuple[int, bytes]]:
        """Rows of what is held, which is emptied first."""
        owner, h, uid, n, f1, f2, k1, k2 = (np.concatenate([x[i] for x in held]) for i in (0, 1, 2, 4, 5, 6, 7, 8))
        doc = pa.concat_arrays([x[3] for x in held])
        held.clear()
        for part, cols in _by_uid(uid, [uid, doc, n, f1, f2, k1, k2], parts):
            yield part, _doc_rows(*cols)
        if not len(h):
            return
        kinds, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        hot = count >= FREQUENT
        often = hot[inverse]
        del inverse
        if often.any():
            cols = [_reduced(kinds[hot], parts), count[hot].astype(np.int64)]
            for p, c in exchange.split(exchange.part_of(kinds[hot], parts), cols):
                yield p, b"\3" + exchange.pack(c)
            cols = [owner[often] + first, _reduced(h[often], parts), np.full(int(often.sum()), FREQUENT, np.uint8)]
            for p, c in _by_uid(cols[0], cols, parts):
                yield p, b"\1" + exchange.pack(c)
            owner, h = owner[~often], h[~often]
        del kinds, count, hot, often
        for p, (local, own) in exchange.split(exchange.part_of(h, parts), [owner, h]):
            yield p, b"\0" + first.to_bytes(8, "little") + len(own).to_bytes(8, "little") + _steps(local).tobytes() + _low(own).tobytes()

    return run


def _by_uid(uid: np.ndarray, columns: list, parts: int) -> Iterator[tuple[int, list]]:
    if not len(uid):
        return
    part = (mix(uid.astype(np.uint64)) % _U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(part[order]) != 0))
    for a, z in zip(cuts, [*cuts[1:], len(part)], strict=True):
        at = order[a:z]
        yield int(part[at[0]]), [c.take(pa.array(at)) if isinstance(c, pa.Array) else c[at] for c in columns]


def _count(parts: int):
    """First exchange, by shingle: counts documents and sends shared shingles on to their documents.

    A range's entries wait in the packed form in which they came, and are sorted and counted a stretch of hashes at a time.
    """

    def run(groups: Iterator[tuple[int, Iterator[bytes]]]) -> Iterator[pa.RecordBatch]:
        for part, payloads in groups:
            entries: list[tuple[int, np.ndarray, np.ndarray]] = []
            hot, counts = [], []

            def passed(payloads=payloads, part=part, entries=entries, hot=hot, counts=counts) -> Iterator[tuple[int, bytes]]:
                for x in payloads:
                    if x[0] in (1, 2):
                        yield part, x
                    elif x[0] == 3:
                        a, c = exchange.unpack(x[1:], ["<u8", "<i8"])
                        hot.append(a)
                        counts.append(c)
                    else:
                        n = int.from_bytes(x[9:17], "little")
                        entries.append((int.from_bytes(x[1:9], "little"), np.frombuffer(x, np.uint8, 4 * n, 17), np.frombuffer(x, np.uint8, 6 * n, 17 + 4 * n).reshape(n, 6)))

            yield from exchange.batches(passed())
            extra_t, extra = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if hot:
                extra_t, inverse = np.unique(np.concatenate(hot), return_inverse=True)
                extra = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)
            yield from exchange.batches(shared(part, entries, extra_t, extra))

    def shared(part: int, entries: list[tuple[int, np.ndarray, np.ndarray]], extra_t: np.ndarray, extra: np.ndarray) -> Iterator[tuple[int, bytes]]:
        stretches = min(256, 1 + sum(len(x[2]) for x in entries) // SORTED)
        for s in range(stretches):
            low, uid = [], []
            for first, step, raw in entries:
                own = raw[:, 5].astype(np.int64) * stretches >> 8 == s
                low.append(raw[own].ravel())
                uid.append(first + _unsteps(step)[own])
            if not sum(map(len, uid)):
                continue
            token, uid = _widen(np.concatenate(low), part), np.concatenate(uid)
            order = np.argsort(token)
            token, uid = token[order], uid[order]
            head = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            n = np.diff(np.append(head, len(token)))
            n_all = n
            if len(extra_t):
                at = np.minimum(np.searchsorted(extra_t, token[head]), len(extra_t) - 1)
                n_all = n + np.where(extra_t[at] == token[head], extra[at], 0)
            frequency = np.repeat(n_all, n)
            keep = frequency >= 2
            cols = [uid[keep], token[keep], np.minimum(frequency[keep], FREQUENT).astype(np.uint8)]
            del low, uid, token, order, frequency, keep
            for p, c in _by_uid(cols[0], cols, parts):
                yield p, b"\1" + exchange.pack(c)

    return run


def _gather(groups: Iterator[tuple[int, Iterator[bytes]]]) -> Iterator[pa.RecordBatch]:
    """Second exchange, by document: its size and, if its prefix reaches one, its shared shingles in the common order; some
    documents at a time, of SORTED shared shingles together."""
    for _, payloads in groups:
        docs, shared = [], []
        for x in payloads:
            (docs if x[0] == 2 else shared).append(exchange.unpack(x[1:], DOC_KINDS if x[0] == 2 else SHARED_KINDS))
        table = [np.concatenate(c) for c in zip(*docs, strict=True)]
        order = np.argsort(table[0])
        table = [c[order] for c in table]
        known = np.zeros(len(order), np.int64)
        for x in shared:
            known += np.bincount(np.searchsorted(table[0], x[0]), minlength=len(known))
        reach = np.cumsum(known)
        at = 0
        while at < len(order):
            stop = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + SORTED, "right")))
            yield _sets([c[at:stop] for c in table], known[at:stop], shared)
            at = stop


def _sets(table: list[np.ndarray], known: np.ndarray, shared: list[list[np.ndarray]]) -> pa.RecordBatch:
    """The rows of some documents, ascending in number."""
    uid, doc, null, n, f1, f2, k1, k2 = table
    lists = pa.nulls(len(uid), pa.list_(pa.int64()))
    if known.any():
        own = [(x[0] >= uid[0]) & (x[0] <= uid[-1]) for x in shared]
        su, st, sf = (np.concatenate([x[i][m] for x, m in zip(shared, own, strict=True)]) for i in range(3))
        order = np.lexsort((st, sf, su))
        su, st = su[order], st[order]
        able = n - known < prefix(n)
        take = able[np.searchsorted(uid, su)]
        ends = np.concatenate(([0], np.cumsum(np.where(able, known, 0))))
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(st[take].view(np.int64)))
        lists = pc.if_else(pa.array(able & (known > 0)), lists, pa.nulls(len(uid), lists.type))
    ids = pa.array(doc, pa.int64(), mask=null.astype(bool))
    return pa.RecordBatch.from_arrays([pa.array(uid), ids, pa.array(n), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array(k1), pa.array(k2), pa.array(n - known), lists], names=["uid", "doc_id", "n", "f1", "f2", "k1", "k2", "alone", "shared"])


def prefix(n):
    """Length of the prefix of a set of n: two similar sets share one of these."""
    return n - -(-SIMILAR * n // 100) + 1


SETS = "uid long, doc_id long, n long, f1 long, f2 long, k1 long, k2 long, alone long, shared array<long>"


def _keys() -> tuple[Column, Column]:
    """Two fingerprints of a row's doc_id and text, by which it is found again."""
    row = F.col("doc_id").cast("long"), F.col("text").cast("string")
    return F.xxhash64(*row), F.xxhash64(F.lit(1), *row)


def prefix_sets(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text): size of its set, two fingerprints of it and of the row, number of shingles that no other
    document has, and, unless its prefix consists of those, the others in the common order."""
    parts = exchange.ranges(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(k.alias(n) for k, n in zip(_keys(), ("k1", "k2"), strict=True)))
    counted = exchange.deal(texts.mapInArrow(tidy(_index(parts)), exchange.SCHEMA), _count(parts), exchange.SCHEMA)
    return exchange.deal(counted, _gather, SETS)


def _bound(a: str, b: str):
    """From the places of a common shingle, the first of a pair: the intersection it still allows is large enough."""
    most = F.least(F.col(f"{a}.known") - F.col(f"{a}.pos"), F.col(f"{b}.known") - F.col(f"{b}.pos"))
    n = F.col(f"{a}.n") + F.col(f"{b}.n")
    close = 100 * F.least(f"{a}.n", f"{b}.n") >= SIMILAR * F.greatest(f"{a}.n", f"{b}.n")
    return close & (most * (100 + SIMILAR) >= SIMILAR * n)


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of rows' numbers whose sets are similar, by the exact sizes of their intersections."""
    side = sets.where("shared is not null")
    a = side.select(F.col("uid").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    b = side.select(F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(a, "a").join(b, "b").where((100 + SIMILAR) * common >= SIMILAR * (F.col("na") + F.col("nb"))).select("a", "b")


def _links(sets: DataFrame, scratch: list[str]) -> DataFrame:
    """Links (a, b) between rows' numbers of distinct sets: not all of them, but enough that their components are exact.

    First each shingle's most connected group (the one with the fewest shingles of its own) is verified against the others of
    that shingle, which unites large groups of near copies by a star each; then all remaining group pairs, but only members
    of components not united yet. Every pair of different components that could be similar is verified.
    """
    first = sets.where("shared is not null").groupBy("n", "f1", "f2").agg(F.min("uid").alias("uid"))
    reach = (prefix_length(F.col("n")) - F.col("alone")).cast("int")
    base = sets.where("shared is not null").select("uid", "n", F.size("shared").alias("known"), F.slice("shared", F.lit(1), reach).alias("prefix"))
    base = base.join(first.select("uid"), "uid", "left_semi").select("*", F.xxhash64("n", "prefix").alias("g1"), F.xxhash64(F.lit(1), "n", "prefix").alias("g2"))
    base = save(base, "prefixes", scratch)
    groups = base.groupBy("g1", "g2").agg(F.min("uid").alias("gid"), F.max("known").alias("known"), F.max(F.struct("known", "uid"))["uid"].alias("middle"), F.count("*").alias("members"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    groups = save(groups, "prefix-groups", scratch)
    members = save(base.select("uid", "n", "known", "g1", "g2").join(groups.select("g1", "g2", "gid"), ["g1", "g2"]).drop("g1", "g2"), "group-members", scratch)
    entries = groups.select("gid", "middle", "n", "known", F.posexplode("prefix").alias("pos", "shingle"))

    best = F.max(F.struct((F.col("known") / F.col("n")).alias("share"), "gid", "middle", "n", "known", "pos")).alias("p")
    pivots = entries.groupBy("shingle").agg(best, F.count("*").alias("groups")).where("groups > 1").select("shingle", "p.*")
    stars = entries.alias("e").join(pivots.alias("p"), "shingle").where(_bound("e", "p") & (F.col("e.gid") != F.col("p.gid"))).select(F.col("p.middle").alias("a"), F.col("e.gid").alias("gid")).distinct()
    own = groups.where("members > 1").select(F.col("middle").alias("a"), "gid")
    stars = stars.union(own).join(members, "gid").where("a != uid").select("a", F.col("uid").alias("b"))
    one = save(_verify(stars, sets), "links-star", scratch)

    united = components(one, scratch=scratch)
    members = save(members.join(united, members["uid"] == united["node"], "left").select("uid", "gid", "n", "known", F.coalesce("component", "uid").alias("component")), "members-united", scratch)
    range_of = members.groupBy("gid").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"))
    e = entries.join(range_of, "gid").select("shingle", "gid", "n", "known", "pos", "lo", "hi")
    apart = ~((F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi")) & (F.col("x.lo") == F.col("x.hi")))
    pairs = e.alias("x").join(e.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.gid") < F.col("y.gid")) & _bound("x", "y") & apart).select(F.col("x.gid").alias("gx"), F.col("y.gid").alias("gy")).distinct()
    within = range_of.where("lo < hi").select(F.col("gid").alias("gx"), F.col("gid").alias("gy"))
    x = members.select(F.col("gid").alias("gx"), F.col("uid").alias("a"), F.col("n").alias("n1"), F.col("known").alias("k1"), F.col("component").alias("c1"))
    y = members.select(F.col("gid").alias("gy"), F.col("uid").alias("b"), F.col("n").alias("n2"), F.col("known").alias("k2"), F.col("component").alias("c2"))
    enough = (100 + SIMILAR) * F.least("k1", "k2") >= SIMILAR * (F.col("n1") + F.col("n2"))
    rest = pairs.union(within).join(x, "gx").join(y, "gy").where((F.col("c1") != F.col("c2")) & enough & ((F.col("gx") != F.col("gy")) | (F.col("a") < F.col("b")))).select("a", "b")
    two = save(_verify(rest, sets), "links-rest", scratch)
    return one.union(two)


def prefix_length(n):
    """prefix() of a column."""
    return n - F.ceil(SIMILAR * n / 100) + 1


def _classes(sets: DataFrame, scratch: list[str]) -> DataFrame:
    """(n, f1, f2, c): each distinct set that isn't empty, and the number of its component. The tables made on the way are
    deleted, but for one that is added to scratch."""
    own: list[str] = []
    linked = components(_links(sets, own), scratch=scratch)
    drop(sets.sparkSession, own)
    whole = sets.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("uid").alias("uid"))
    return whole.join(linked, whole["uid"] == linked["node"], "left").select("n", "f1", "f2", F.coalesce("component", "uid").alias("c"))


def similar_documents(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each row of docs(doc_id, text).

    A null text, an empty one and one of white space alone have no shingles and are linked with nothing. Rows of equal sets,
    repeated rows among them, are linked. A null doc_id is linked like any other; it is the smallest of none. An empty table
    gives no rows; other columns are ignored. Whole texts are read, however long.
    """
    scratch: list[str] = []
    sets = save(prefix_sets(docs), "shingle-sets")
    rows = sets.select("doc_id", "n", "f1", "f2")
    least = rows.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("least"))
    whole = save(_classes(sets, scratch).join(least, ["n", "f1", "f2"]), "set-classes")
    drop(docs.sparkSession, scratch)
    whole = whole.join(whole.groupBy("c").agg(F.min("least").alias("component_id")), "c").select("n", "f1", "f2", "component_id")
    out = rows.where("n > 0").join(whole, ["n", "f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.union(rows.where("n = 0").select("doc_id", "n", "doc_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs, all columns kept, with one row of each component of similar_documents(): that of the smallest doc_id, null after
    all others, and of several such rows one. Rows without words are linked with nothing and all stay, null texts too; an
    empty table gives no rows; columns may have any names."""
    k1, k2 = fresh(docs, "k1", "k2")
    scratch: list[str] = []
    sets = save(prefix_sets(docs), "shingle-sets", scratch)
    rows = sets.where("n > 0").select("n", "f1", "f2", F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    best = rows.groupBy("n", "f1", "f2").agg(F.min(F.struct("none", "doc_id", "k1", "k2")).alias("best"))
    best = best.join(_classes(sets, scratch), ["n", "f1", "f2"]).groupBy("c").agg(F.min("best").alias("best"))
    best = save(best, "set-classes", scratch)
    kept = best.select(F.col("best.k1").alias(k1), F.col("best.k2").alias(k2))
    key = [k.alias(n) for k, n in zip(_keys(), (k1, k2), strict=True)]
    keyed = docs.select("*", *key)
    wordless = F.coalesce(~F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    # A row given several times is kept once; such keys are few, so the rest needn't be looked through for them.
    again = save(rows.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.count("*").alias("n")).where("n > 1").select(k1, k2).join(kept, [k1, k2], "left_semi"), "rows-repeated")
    kept = save(kept.join(again, [k1, k2], "left_anti"), "rows-kept")
    drop(docs.sparkSession, scratch)
    out = docs.where(wordless).unionByName(keyed.where(~wordless).join(kept, [k1, k2], "left_semi").select(*docs.columns))
    if again.isEmpty():
        return out
    return out.unionByName(keyed.where(~wordless).join(again, [k1, k2], "left_semi").dropDuplicates([k1, k2]).select(*docs.columns))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))
