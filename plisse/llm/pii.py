"""Personal data: fixed patterns, and terms whose co-occurrence with a protected value gives it away."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, only, save, slices, table, tidy, widened
from .quality import split_words

#: Fixed patterns and kinds of the contract, in its order.
KINDS = ("email", "ip", "card", "phone", "term")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match begins where its digits do, since greedy ones end at the end of theirs; said here, or long runs would be tried digit by digit.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
WORD = re.compile(r"[^\W\d_]+")
#: Runs of scripts that put no space between words: their pairs and triples of characters are terms too.
UNSPACED = re.compile("[\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]{2,}")
#: Short words of grammar, which name nobody; only as written here, so that a capitalised name of the same letters is a term.
GRAMMAR = frozenset("a all am an and any are as at be but by can did do for get go got had has he her him his how i if in is it its let may me my no nor not now of off on or our out own per she so the to too up us was we who why yes yet you".split())
#: Documents in which a term must stand with a value; share of the value's information content that a term must reveal to be
#: taken out; terms, and pairs of value and term, that are sent to every task at most; pairs that a task adds up at a time.
SUPPORT, DISCLOSED, BROADCAST_TERMS, GATHER = 2, 0.9, 200_000, 200_000


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, sorted: per kind leftmost, not overlapping, failing matches dropped."""
    found: list[tuple[int, int, int]] = []
    at, end = text.find("@"), 0
    while at >= 0:
        # The first part is the whole run of its characters before the sign, back to the last match at most.
        start = at
        while start > end and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, 0, end))
        at = text.find("@", at + 1)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


def key64(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def words_of(text: str) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of every word of a text in lower case, and of pairs and triples of characters in unspaced scripts."""
    for m in WORD.finditer(text):
        word, at = m[0], m.start()
        if word not in GRAMMAR:
            yield word.lower(), at, m.end()
        if not word.isascii():
            for run in UNSPACED.finditer(word):
                for n in (2, 3):
                    if n < len(word):
                        for k in range(run.start(), run.end() - n + 1):
                            yield word[k : k + n].lower(), at + k, at + k + n


def terms_beside(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """words_of the whole text without those that touch one of the sorted spans (start, end)."""
    free = bytearray(len(text) + 1)
    for start, end in spans:
        free[start:end] = b"\1" * (end - start)
    return (x for x in words_of(text) if not free.find(1, x[1], x[2]) >= 0)


class Keys(dict):
    """key64 of terms, remembered for a bounded number of them."""

    def __missing__(self, term: str) -> int:
        if len(self) > 150_000:
            self.clear()
        out = self[term] = key64(term)
        return out


SPAN = "array<struct<start:int,kind:int,end:int>>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))


#: What find() adds to its input; where a column has the name already, underscores go before it.
INNER = ("_row", "_base", "_values", "_spans")


def locate(docs: DataFrame) -> DataFrame:
    """docs with INNER's row long, base (the fixed spans) and values (the distinct keys of their values)."""
    row_name, base, held, _ = fresh(docs, *INNER)
    names = [*docs.columns, row_name, base, held]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        row = TaskContext.get().partitionId() << 40
        for b in slices(batches):
            spans, values = [], []
            for text in b.column("text").to_pylist():
                s = base_spans(text or "")
                spans.append([{"start": x[0], "kind": x[1], "end": x[2]} for x in s])
                values.append(list({key64(f"{KINDS[kind]}:{text[start:end].lower()}") for start, kind, end in s}))
            rows = pa.array(np.arange(row, row + b.num_rows))
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, rows, pa.array(spans, SPANS), pa.array(values, pa.list_(pa.int64()))], names=names)

    return docs.mapInArrow(run, widened(docs, (row_name, "long"), (base, SPAN), (held, "array<long>")))


def term_counts(docs: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """(term, n): in how many documents each term stands, over whole texts; only the wanted terms, or all where it is null.

    Each task adds up its slices before the shuffle, flushing at a bounded number of terms.
    """

    def send(held: dict[int, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        keep = None if wanted is None else np.sort(wanted)
        known: dict[str, tuple[int, ...]] = {}
        held: dict[int, int] = {}
        for b in slices(batches, limit=2 << 20):
            words, codes, ends = split_words(b.column("text"))
            if len(known) > 150_000:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = tuple({key64(x[0]) for x in words_of(w)})
            sizes = np.fromiter((len(known[w]) for w in words), np.int64, len(words))
            flat = np.fromiter((t for w in words for t in known[w]), np.int64, int(sizes.sum()))
            ok = np.ones(len(flat), bool) if keep is None else np.isin(flat, keep)
            if not ok.any():
                continue
            terms, code = np.unique(flat[ok], return_inverse=True)
            word = np.repeat(np.arange(len(words)), sizes)[ok]
            doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
            # Words with a kept term, joined to the places where they stand.
            has = np.bincount(word, minlength=len(words))
            at = np.flatnonzero(has[codes])
            first = np.searchsorted(word, np.arange(len(words)))
            n = has[codes[at]]
            index = np.repeat(first[codes[at]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            pairs = np.unique(np.repeat(doc[at], n) * len(terms) + code[index])
            counts = np.bincount(pairs % len(terms), minlength=len(terms))
            for t, n in zip(terms.tolist(), counts.tolist(), strict=True):
                held[t] = held.get(t, 0) + n
            if len(held) > 200_000:
                yield send(held)
                held = {}
        if held:
            yield send(held)

    return docs.select("text").mapInArrow(tidy(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """The given columns of each row, and its terms as an iterator of (term, start, end)."""
    for b in slices(batches):
        for text, base, *rest in zip(b.column("text").to_pylist(), b.column("base").to_pylist(), *(b.column(c).to_pylist() for c in columns), strict=True):
            yield *rest, terms_beside(text or "", [(x["start"], x["end"]) for x in base])


def pair_counts(asked: DataFrame) -> DataFrame:
    """(value, term, n): in how many of the rows (text, base, held) a held value and a term stand; each task adds up first."""

    def send(held: dict[int, Counter]) -> pa.RecordBatch:
        value = np.repeat(np.array(list(held), np.int64), [len(c) for c in held.values()])
        return pa.RecordBatch.from_arrays([pa.array(value), pa.array([t for c in held.values() for t in c], pa.int64()), pa.array([n for c in held.values() for n in c.values()], pa.int64())], names=["value", "term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, held, size = Keys(), {}, 0
        for values, words in _rows(batches, "held"):
            terms = {keys[x[0]] for x in words}
            for v in values:
                c = held.setdefault(v, Counter())
                size -= len(c)
                c.update(terms)
                size += len(c)
                if size > GATHER:
                    yield send(held)
                    held, size = {}, 0
        if held:
            yield send(held)

    return asked.select("text", "base", "held").mapInArrow(tidy(run), "value long, term long, n long").groupBy("value", "term").agg(F.sum("n").alias("n_both"))


def disclosing(located: DataFrame, docs: DataFrame, disclosed: float = DISCLOSED, support: int = SUPPORT) -> DataFrame:
    """(value, term) pairs whose pointwise mutual information reaches `disclosed` of the value's information content.

    located has text, row, base and values. N documents; c(v), c(t), c(t,v) documents with the value, the term, both, wherever
    in the text they stand. The value's information content is log2(N / c(v)); the term reveals log2(N c(t,v) / (c(v) c(t)))
    of it. Terms seen with a value in fewer than `support` documents prove nothing, so only documents of values that occur in
    as many are expanded. Counts are over all documents. Up to BROADCAST_TERMS, terms go to all tasks as an array, and only
    they are counted; beyond it all terms are. The result is the same.
    """
    holds = located.where(F.size("values") > 0)
    each = holds.select("row", F.explode("values").alias("value"))
    total = located.count()
    values = save(each.groupBy("value").agg(F.count("*").alias("n_value")).where((F.col("n_value") >= support) & (F.col("n_value") < total)), "pii-values")
    held = each.join(values, "value").groupBy("row").agg(F.collect_list("value").alias("held"))  # within one document
    pairs = save(pair_counts(holds.join(held, "row")).where(F.col("n_both") >= support), "pii-pairs")
    terms = save(pairs.select("term").distinct(), "pii-terms")
    few = terms.count() <= BROADCAST_TERMS
    counts = term_counts(docs, _column(terms, "term") if few else None)
    n = F.lit(float(max(1, total)))
    content = F.log2(n / F.col("n_value"))
    revealed = F.log2(n * F.col("n_both") / (F.col("n_value") * F.greatest("n", "n_both")))
    return pairs.join(values, "value").join(counts, "term").where(revealed >= disclosed * content).select("value", "term")


def _column(df: DataFrame, name: str) -> np.ndarray:
    """A column of a table of at most BROADCAST_TERMS rows, as an array."""
    return df.select(name).toArrow().column(0).to_numpy()


def _of(pairs: tuple[np.ndarray, np.ndarray], value: int) -> list[int]:
    """The terms of a value, from pairs sorted by value."""
    return pairs[1][np.searchsorted(pairs[0], value, "left") : np.searchsorted(pairs[0], value, "right")].tolist()


def find(docs: DataFrame, disclosed: float = DISCLOSED, carry: bool = True) -> DataFrame:
    """docs(doc_id, text, ...) with INNER's base and spans: the spans of the fixed patterns, and these with every place of the
    terms that disclose a value of the document, sorted by start and kind.

    Offsets are code points, the end exclusive. A null text is empty, an empty table gives no rows; null doc_ids and repeated
    rows are searched like any other; columns may have any names. The table of located spans is written once; only rows with
    a value are looked through for terms, the others pass by. Up to BROADCAST_TERMS, pairs that disclose are sent to every
    task as arrays, beyond it each document's own terms and values are joined to them, with the same result. Without carry
    that table has only the texts with a value, and the result none.
    """
    row_name, base_name, values_name, spans_name = fresh(docs, *INNER)
    located = locate(docs)
    some = F.size(values_name) > 0
    located = save(located if carry else located.withColumn("text", F.when(some, F.col("text"))), "pii-spans")
    core = located.select("text", F.col(row_name).alias("row"), F.col(base_name).alias("base"), F.col(values_name).alias("values"))
    flagged = save(disclosing(core, docs, disclosed), "pii-disclosing")
    holds = located.where(some)
    names = [*located.columns, spans_name]
    pairs: tuple[np.ndarray, np.ndarray] | None = None
    if flagged.count() <= BROADCAST_TERMS:
        found = flagged.toArrow()  # one row a pair, so that the columns belong together
        value, term = (found.column(c).to_numpy() for c in ("value", "term"))
        order = np.argsort(value, kind="stable")
        pairs = value[order], term[order]
    else:

        def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys = Keys()
            for row, values, words in _rows(batches, "row", "values"):
                terms = np.fromiter({keys[x[0]] for x in words}, np.int64)
                for v in values:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), row)), pa.array(np.full(len(terms), v)), pa.array(terms)], names=["row", "value", "term"])

        own = core.where(F.size("values") > 0).mapInArrow(triples, "row long, value long, term long")
        own = own.join(flagged, ["value", "term"]).groupBy(F.col("row").alias(row_name)).agg(F.collect_set("term").alias(spans_name))  # within one document
        terms = F.coalesce(spans_name, F.array().cast("array<long>"))
        holds = holds.join(own, row_name, "left").withColumn(values_name, terms).drop(spans_name).select(*located.columns)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = Keys()
        for b in slices(batches):
            out = []
            for text, base, values in zip(b.column("text").to_pylist(), b.column(base_name).to_pylist(), b.column(values_name).to_pylist(), strict=True):
                terms = set(values) if pairs is None else {t for v in values for t in _of(pairs, v)}
                if terms:
                    hits = terms_beside(text, [(x["start"], x["end"]) for x in base])
                    base = sorted(base + [{"start": s, "kind": len(KINDS) - 1, "end": e} for w, s, e in hits if keys[w] in terms], key=lambda x: (x["start"], x["kind"], x["end"]))
                out.append(base)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, SPANS)], names=names)

    plain = located.where(~some).withColumn(spans_name, F.col(base_name))
    found = holds.mapInArrow(mark, widened(located, (spans_name, SPAN))).unionByName(plain).drop(row_name, values_name)
    return found if carry else found.drop("text")


def _text(column: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of find(), given docs(doc_id, text)."""
    n = [F.size(F.array_remove(F.transform("_base", lambda x: x["kind"]), k)) for k in range(4)]
    n = [(F.size("_base") - left).cast("long").alias(f"n_{KINDS[k]}") for k, left in enumerate(n)]
    return found.select("doc_id", *n, F.sha2(_text("_base").cast("binary"), 256).alias("base_sha256"), _text("_spans").alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...), all columns kept, each span of find() replaced by its kind in angle brackets.

    Values are generalised to their kind, disclosing terms removed the same way. Overlapping spans become one, of the kind of
    the first. Rows, null and empty texts, repeats and the order of columns stay; an empty table gives no rows; columns may
    have any names.
    """
    names, column = docs.columns, fresh(docs, *INNER)[3]
    found = find(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column("text").to_pylist()
            for i, spans in enumerate(b.column(column).to_pylist()):
                if spans:
                    out, at, text = [], 0, texts[i]
                    for s in spans:
                        if s["start"] >= at:
                            out += [text[at : s["start"]], f"<{KINDS[s['kind']].upper()}>"]
                        at = max(at, s["end"])
                    texts[i] = "".join(out) + text[at:]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else b.column(n) for n in names], names=names)

    return found.select(*names, column).mapInArrow(run, docs.schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), one for each row of documents."""
    docs = table(spark, sf_dir, "documents")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return digest(find(texts, carry=False))
