"""Jaccard join, suffix-array dedup and personal data against brute force."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from plisse.llm import jaccard_join, pii, suffix_dedup
from plisse.llm.common import components

from .helpers import hostile, joined, near_copies, shingles, table


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r.node: r.component for r in components(table(spark, pairs, "a long, b long")).collect()}
    want = joined(pairs, {x for p in pairs for x in p if p[0] != p[1]})
    assert got == want
    far = {r.node: r.component for r in components(table(spark, pairs, "a long, b long"), alone=0).collect()}
    assert far == want
    assert components(table(spark, [], "a long, b long")).isEmpty()


def similar(rows):
    sets = {d: shingles(t) for d, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    low = joined(pairs, sets)
    return {d: (len(sets[d]), low[d]) for d in sets}


@pytest.mark.parametrize("seed", [2, 3])
def test_jaccard_join(spark, seed):
    rows = near_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(table(spark, rows)).collect()}
    assert got == similar(rows)


def test_jaccard_join_of_many_copies(spark):
    """More documents with a shingle than a task sends singly, and a large group of near copies around one text."""
    rng = random.Random(9)
    words = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(400):
        w = list(words)
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join([f"own{i}n{k}" for k in range(60)] + words[:40])) for i in range(150)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_documents(table(spark, rows, parts=2)).collect()}
    assert got == similar(rows)


def test_jaccard_join_of_odd_input(spark):
    rows, df = hostile(spark)
    got = jaccard_join.similar_documents(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[7] == (0, 7) and by[5] == (2, 4) and by[4] == (2, 4) and by[8] == (1, 8)
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 7, 8, None, None]))
    a, b = ("one text of six words here", "another text of quite other words")
    rows = [(5, a), (5, b), (3, b), (None, a), (None, a + " tail"), (9, ""), (9, ""), (6, b), (6, b)]
    kept = jaccard_join.keep_one(table(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("5", a), ("3", b), ("None", a + " tail"), ("9", ""), ("9", "")])
    alone = [(None, a), (None, a), (7, b), (7, b)]
    assert sorted((str(r.doc_id), r.text) for r in jaccard_join.keep_one(table(spark, alone)).collect()) == [("7", b), ("None", a)]
    assert jaccard_join.keep_one(table(spark, [])).isEmpty()
    assert jaccard_join.similar_documents(table(spark, [])).isEmpty()


def covered(rows):
    """Per document, which of its bytes a 100-byte string covers that starts earlier too."""
    seen, out = set(), {}
    for d, t in rows:
        raw = (t or "").encode()
        cover = np.zeros(len(raw) + 1, int)
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                cover[k] += 1
                cover[k + 100] -= 1
            seen.add(raw[k : k + 100])
        out[d] = np.cumsum(cover)[: len(raw)] > 0
    return out


def removed(rows):
    out = {}
    for (d, t), gone in zip(rows, covered(rows).values(), strict=True):
        raw = (t or "").encode()
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        out[d] = (len(raw), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def passages(seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abé \n") for _ in range(rng.choice([50, 120, 400, 3000]))) for _ in range(40)]
    rows = []
    for i in range(250):
        t = "".join(rng.choice(base)[rng.randint(0, 60) :][: rng.randint(10, 900)] for _ in range(rng.randint(0, 4)))
        t = "ab" * rng.randint(0, 300) if i % 17 == 0 else "x" * rng.randint(90, 2000) if i % 19 == 0 else t
        rows.append((i * 2, None if i % 50 == 7 else t))
    return rows


@pytest.mark.parametrize(("seed", "many", "gather"), [(5, 256, 1_000_000), (6, 2, 400)])
def test_suffix_dedup(spark, monkeypatch, seed, many, gather):
    """With small bounds the crowded and the flushed ways are taken too: repeats() reads them and takes them to the tasks."""
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "GATHER", gather)
    rows = passages(seed)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(table(spark, rows)).collect()}
    assert got == removed(rows)
    cut = {r.doc_id: r.text for r in suffix_dedup.without_repeats(table(spark, rows)).collect()}
    covers = covered(rows)
    for d, t in rows:
        assert cut[d] == (None if t is None else whole_characters(t, covers[d]))


def whole_characters(text, gone):
    """The characters of which a byte stays."""
    out, at = [], 0
    for c in text:
        size = len(c.encode())
        if not gone[at : at + size].all():
            out.append(c)
        at += size
    return "".join(out)


def crowds(seed, n, partners):
    """Two tasks' rows: a line in n contexts, and in a few that each share bytes at one side with one of those, before or after it in order."""
    rng = random.Random(seed)
    noise = lambda k: "".join(rng.choice("abcdefghijklmnop ") for _ in range(k))
    line = noise(90)
    heads, tails = ([noise(80) for _ in range(n)] for _ in range(2))
    many = [(1000 + i, heads[i] + line + tails[i]) for i in range(n)]
    few = []
    for k in range(partners):
        i = rng.randrange(n)
        text = noise(60) + heads[i][-25:] + line + noise(70) if k % 2 else noise(70) + line + tails[i][:25] + noise(60)
        few.append((k if k % 4 < 2 else 5000 + k, text))
    return many, few


def test_suffix_dedup_of_a_line_crowded_in_one_task_only(spark):
    many, few = crowds(8, 400, 24)
    two = spark.sparkContext.union([spark.sparkContext.parallelize(rows, 1) for rows in (many, few)])  # a task each
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(spark.createDataFrame(two, "doc_id long, text string")).collect()}
    want = {d: x[:4] for d, x in removed(sorted(many + few)).items()}
    assert sum(x[1] > 0 for x in want.values()) >= 24
    assert got == want


@pytest.mark.parametrize(("many", "gather"), [(3, 1_000_000), (3, 40), (1, 1)])
def test_suffix_dedup_takes_its_bounds_to_the_tasks(spark, many, gather):
    """One task is crowded for a seed and another isn't, at small bounds; as brute force finds."""
    crowd, few = crowds(11, 12, 6)
    rows = crowd + few[:3], few[3:]
    two = spark.sparkContext.union([spark.sparkContext.parallelize(x, 1) for x in rows])
    docs = spark.createDataFrame(two, "_ord long, text string")
    got = {}
    for r in suffix_dedup.repeats(docs, many, gather).collect():
        got.setdefault(r.doc, set()).update(range(r.start, r.stop))
    want = {d: x[1] for d, x in removed(sorted(crowd + few)).items() if x[1]}
    assert want and {d: len(x) for d, x in got.items()} == want


def test_suffix_dedup_of_odd_input(spark):
    rows, df = hostile(spark)
    got = suffix_dedup.remove_repeats(df).collect()
    assert len(got) == len(rows)
    assert sorted((str(r.doc_id), r.n_bytes) for r in got) == sorted((str(d), len((t or "").encode())) for d, t in rows)
    want = {d: x[:4] for d, x in removed(sorted([(d, t) for d, t in rows if d not in (None, 5)], key=lambda r: r[0])).items()}
    assert {r.doc_id: tuple(r)[1:] for r in got if r.doc_id not in (None, 5)} == want and want[8][1] > 400
    assert suffix_dedup.without_repeats(df).columns == df.columns
    twice = table(spark, [(1, "q" * 50 + "".join(map(str, range(200))))] * 2)
    assert sorted(r.n_removed > 0 for r in suffix_dedup.remove_repeats(twice).collect()) == [False, True]
    assert suffix_dedup.remove_repeats(table(spark, [])).isEmpty()


def test_level_family():
    """Levels stay few and hold each key once, at its earliest place."""
    rng = np.random.default_rng(1)
    family, first, later = suffix_dedup.LevelFamily(), {}, 0
    n = 0
    for b in range(64):
        key = rng.integers(0, 900, 100).astype(np.uint64)
        doc, p = rng.integers(0, 50, 100), rng.permutation(100).astype(np.int32)
        later += len(family.add(suffix_dedup.Run([key, key, doc, p + 1000 * b])))
        n += 100
        for k, d, x in zip(key.tolist(), doc.tolist(), (p + 1000 * b).tolist(), strict=True):
            first[k] = min(first.get(k, (d, x)), (d, x))
    run = family.entries()
    assert later + len(run) == n and len(family.levels) <= 8
    assert {k: (d, x) for k, d, x in zip(*(run.columns[i].tolist() for i in (0, 2, 3)), strict=True)} == first


def base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_long_runs_of_digits_take_no_long_time():
    """A megabyte of digits, of digits and dots, and of other runs that a pattern begins with."""
    began = time.monotonic()
    assert [k for _, k, _ in pii.base_spans("7" * 1_000_000)] == []
    assert pii.base_spans("1." * 500_000)[0] == (0, 1, 7)
    for t in ("a" * 500_000 + "@" + "b" * 500_000, "+1" + "(" * 1_000_000, "1 " * 500_000, "9." * 3 + "9" * 1_000_000):
        pii.base_spans(t)
    assert time.monotonic() - began < 10


def test_base_spans():
    rng = random.Random(7)
    bits = ["a", "@", ".", "-", "9", "12", "255", "256", " ", "+1", "(", ")", "x@y.z", "4111 1111 1111 1111", "4111-1111-1111-1111", "10.0.0.1", "+44 (0) 20 7946 0958", "é", "\n", "@@", "%_", "0000"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(t) == base(t), t


def test_pii(spark):
    """A value that stands beside one rare name wherever it occurs gives the name away; a common word beside it doesn't."""
    rows = [(i, f"please contact Quillfeather about it at quill.{0}@mail.example today") for i in range(4)]
    rows += [(10 + i, f"please contact support about case {i} today") for i in range(60)]
    got = {r.doc_id: r for r in pii.digest(pii.find(table(spark, rows), carry=False)).collect()}
    assert got[0].n_email == 1 and "email:" in got[0].spans and "term:15:27" in got[0].spans and got[0].spans.count("term") == 1
    assert all(got[10 + i].spans == "" for i in range(60))
    assert got[10].base_sha256 == hashlib.sha256(b"").hexdigest()
    clean = {r.doc_id: r.text for r in pii.sanitise(table(spark, rows)).collect()}
    assert clean[0] == "please contact <TERM> about it at <EMAIL> today" and clean[10] == rows[4][1]


@pytest.mark.parametrize("bound", [200_000, 0])
def test_pii_terms_anywhere_in_the_document(spark, monkeypatch, bound):
    """On another line, far off, short, in a script without spaces, and every time again, but not where the value isn't."""
    monkeypatch.setattr(pii, "BROADCAST_TERMS", bound)
    far = " ".join(f"filler{i}" for i in range(40))
    rows = [(i, f"Name: Oddvarsen\nEmail: who.{0}@mail.example\n{far} Xu {far}\n我們的張偉明在\nOddvarsen filler1") for i in range(3)]
    rows += [(10 + i, f"Name: filler\nEmail: me.{i}@mail.example\n{far} 我們的在") for i in range(60)]
    rows += [(90, "Oddvarsen alone")]
    clean = {r.doc_id: r.text for r in pii.sanitise(table(spark, rows)).collect()}
    assert clean[0].startswith("Name: <TERM>\nEmail: <EMAIL>\nfiller0") and clean[0].endswith("\n<TERM> filler1")
    assert f"\n{far} <TERM> {far}\n" in clean[0] and not {"張", "偉", "明"} & set(clean[0])
    assert clean[10] == rows[3][1].replace("me.0@mail.example", "<EMAIL>") and clean[90] == "Oddvarsen alone"


def test_pii_counts_all_terms_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = [(i, f"ask Marrowby via m{0}@x.example now") for i in range(3)] + [(9 + i, "ask anyone now") for i in range(30)]
    small = {r.doc_id: r.spans for r in pii.digest(pii.find(table(spark, rows), carry=False)).collect()}
    monkeypatch.setattr(pii, "BROADCAST_TERMS", 0)
    assert {r.doc_id: r.spans for r in pii.digest(pii.find(table(spark, rows), carry=False)).collect()} == small and "term" in small[0]


def test_pii_of_odd_input(spark):
    rows, df = hostile(spark)
    got = pii.digest(pii.find(df.select("doc_id", "text"))).collect()
    assert len(got) == len(rows) and all(r.spans == "" for r in got)
    out = pii.sanitise(df)
    assert out.columns == df.columns and sorted(map(str, (r.text for r in out.collect()))) == sorted(map(str, (t for _, t in rows)))
    assert pii.digest(pii.find(table(spark, []))).isEmpty()
