"""The classifier's held-out accuracy, and the URL filter against SQL and a plain version of its rules."""

import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa

from plisse.llm import quality, url_filter

from .helpers import hostile, table


def corpus(n=700, seed=5):
    rng = random.Random(seed)
    parts = ["than", "ing", "er", "tion", "on", "the", "es", "re"]
    word = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 3)))
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.75
        words = [word() for _ in range(rng.randint(20, 120))]
        if not good:
            kind = rng.randint(0, 2)
            words = [w + rng.choice(["%%%", "###", "$$$"]) for w in words] if kind == 0 else [w for w in words[:15] for _ in range(8)] if kind == 1 else [x for w in words for x in (w, "|")]
        docs.append((i, " ".join(words)))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    got = quality.score_quality(table(spark, docs), table(spark, labels, "doc_id long, quality int, toxic int")).toPandas().merge(pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]))
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    held = got[got.held_out]
    assert len(held) > 100 and (held.predicted == held.quality).mean() > 0.97 and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.3)).all()


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = corpus(200)
    spoilt = [(d, 1 - q if zlib.crc32(str(d).encode()) % 5 == 0 else q, t) for d, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a, b = (quality.score_quality(table(spark, docs), table(spark, x, schema)).orderBy("doc_id").collect() for x in (labels, spoilt))
    assert a == b


def test_scores_by_hand():
    docs, labels = corpus(60)
    model = quality.train([t for _, t in docs], [q for _, q, _ in labels])
    texts = [t for _, t in docs] + ["", None, "é é é x"]
    one = quality.Scorer(model).score(pa.array(texts))
    emb, out, bias = model
    for t, s in zip(texts, one, strict=True):
        words = (t or "").split()
        rows = []
        for w in words:
            _, b = quality.features([w])
            rows += [emb[k] for k in b]
        total, n = sum(rows, 0 * emb[0].astype(float)), len(rows)
        for x, y in zip(words, words[1:], strict=False):
            total, n = total + emb[quality.BUCKETS + (x == y)], n + 1
        z = total / max(1, n) @ out + bias
        assert abs(s - 1 / (1 + np.exp(z[0] - z[1]))) < 1e-4


def test_quality_of_odd_input(spark):
    rows, df = hostile(spark)
    labels = table(spark, [(3, 1, 0), (3, 0, 0), (None, 1, 0), (4, None, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert not next(r for r in got if r.doc_id is None).held_out
    none = quality.score_quality(df, table(spark, [], "doc_id long, quality int, toxic int")).collect()
    assert all(r.score == 0.5 for r in none)
    assert quality.keep_good(df, labels).columns == df.columns
    assert quality.score_quality(table(spark, []), labels).isEmpty()


PAGE = "page_id long, url string, html string"


def urls(n=600, seed=2):
    rng = random.Random(seed)
    hosts = [f"{s}{d}.{t}" for s in ("", "www.", "m.") for d in ("example", "other", "adult-x.example", "b") for t in ("com", "net", "org", "de")]
    rows = [(i, rng.choice(["http://", "HTTPS://"]) + rng.choice([str.upper, str])(rng.choice(hosts)) + rng.choice(["", "/", "/en/1", "/es/2?x=//", "/fr/", "#t", "?q=/en/"]), None) for i in range(n)]
    return rows + [(9001, None, None), (9002, "", "x"), (9003, "no scheme/at/all", None), (9004, "a://b://c/es/", None), (9005, "x://\n.net/es/", None), (None, "http://example.net/es/1", None), (1, rows[1][1], None)]


def test_url_filter_agrees_with_sql(spark):
    rows = urls()
    df = url_filter.url_filter(table(spark, rows, PAGE))
    got = df.collect()
    c = duckdb.connect()
    c.register("pages", pa.table({"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": pa.array([r[1] for r in rows], pa.string())}))
    want = c.execute(f"select {', '.join(df.columns)} from ({url_filter.ORACLE})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r.verdict for r in got} == {"allow", "block"}


def test_url_parts_and_rules(spark):
    rows = [(1, "http://WWW.Example.com/en/x"), (2, "http://example.com/en"), (3, "http://a.example.com/en/"), (4, "http://example.com"), (5, "ftp://notexample.com/en/?y"), (6, "http://x.net/fr/#z"), (7, "http://é.NET/es/")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(table(spark, rows, "page_id long, url string")).collect()}
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2][1:] == ("/en", "com/", "allow") and got[3][2:] == ("example.com/en/", "block")
    assert got[4][1:3] == ("", None) and got[5][2:] == ("com/", "allow") and got[6][1:] == ("/fr/", "net/fr/", "block")
    assert got[7][0] == "é.net" and got[7][2] == "net/es/"


def test_reputation_shrinks(spark):
    """A host with many blocked pages is blocked elsewhere too, one with a single blocked page of a good domain isn't."""
    rules = (("allow", "a.example/ok/"), ("block", "a.example/no/"), ("block", "bad.example/no/"))
    rows = [(i, f"http://h{i % 9}.a.example/ok/{i}") for i in range(900)] + [(1000, "http://h1.a.example/no/1")]
    rows += [(2000 + i, f"http://w{i % 5}.bad.example/no/{i}") for i in range(500)]
    rows += [(3000, "http://h1.a.example/x"), (3001, "http://w1.bad.example/x"), (3002, "http://new.bad.example/x"), (3003, "http://elsewhere.test/")]
    got = {r.page_id: r.verdict for r in url_filter.url_filter(table(spark, rows, "page_id long, url string"), rules).collect()}
    assert [got[i] for i in (3000, 3001, 3002, 3003)] == ["allow", "block", "block", "allow"]


def test_url_filter_of_none(spark):
    assert url_filter.url_filter(table(spark, [], PAGE)).isEmpty()
    assert [r.verdict for r in url_filter.url_filter(table(spark, [(1, "http://q.org/", "x")], PAGE)).collect()] == ["allow"]
    plan = url_filter.url_filter(table(spark, urls(20), PAGE))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
