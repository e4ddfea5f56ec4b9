"""Fixtures and brute-force versions shared by the operators' tests."""

import random
import re

import numpy as np

DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, schema="doc_id long, text string", parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts) if rows else spark.createDataFrame([], schema)


def hostile(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns of all names that the operators use or have used."""
    long = " ".join(f"word{i % 997}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, long), (4, "same text here, of six words"), (5, "same text here, of six words"), (5, "same text here, of six words"), (None, "no id"), (None, None), (7, " \n\t "), (8, "é" * 300)]
    df = table(spark, rows)
    from pyspark.sql import functions as F

    extra = {c: F.lit("x") for c in ("ord", "_ord", "doc", "_Doc", "least", "row", "_row", "base", "_base", "values", "_values", "ctx", "_ctx", "spans", "_Spans", "repeats", "_repeats", "score", "_score", "uid", "n", "f1", "k1", "K2", "_k1", "part", "payload", "_kept", "_rows", "rows", "component_id", "c", "ids", "label", "model")}
    return rows, df.withColumns(extra)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set() if not w else {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def joined(pairs, ids):
    """The smallest id of each one's component."""
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def near_copies(seed=2, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [[rng.choice(words) for _ in range(rng.choice([3, 8, 30, 80]))] for _ in range(25)]
    rows = []
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(words).upper()
        rows.append((i * 3, rng.choice([" ", "\n", "  \t"]).join(w[: rng.randint(0, len(w))] if rng.random() < 0.2 else w)))
    return rows


def vectors(seed=0, n=400, dim=24, copies=40):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for i in range(copies):
        x[n - 1 - i] = x[i % 9] + rng.standard_normal(dim) * rng.choice([0.0, 0.05, 0.1])
    return x
