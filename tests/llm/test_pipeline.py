"""The corpus pipeline on a small corpus: each stage on all that the one before kept."""

import random

import pytest

import corpus_pipeline
from plisse.llm import registry

from .helpers import DOCUMENT, hostile, table


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["than", "ing", "er", "tion", "on", "the", "es", "re"]) for _ in range(rng.randint(1, 4)))
    passage = " ".join(word() for _ in range(60))
    docs = [" ".join(word() for _ in range(90)) for _ in range(150)]
    docs += [docs[0], docs[1].replace(docs[1].split()[5], "changed"), passage + " " + docs[2][:200], docs[3][:200] + " " + passage + " tail", "write to some.one@mail.example now, card 4111 1111 1111 1111", "", None]
    docs += [" ".join(word() + "###" for _ in range(80)) for _ in range(40)]
    d = tmp_path_factory.mktemp("corpus")
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(docs)]
    table(spark, rows, DOCUMENT).write.parquet(f"{d}/documents.parquet")
    table(spark, [(i, int("###" not in (t or "")), 0) for i, t in enumerate(docs)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), docs, passage


def test_stages(spark, folder):
    d, docs, passage = folder
    at = spark.read.parquet(f"{d}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.save(stage(spark, at, d), name)
        kept.append({r.doc_id: r for r in at.collect()} if "text" in at.columns else at.collect())
        if "text" in at.columns:
            assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    good, single, cut, clean, packed = kept
    assert set(good) == {i for i, t in enumerate(docs) if "###" not in (t or "")}
    assert set(good) - set(single) == {150, 151}
    assert passage in cut[152].text and passage not in cut[153].text and cut[153].text.startswith(docs[153][:150]) is False
    assert clean[154].text == "write to <EMAIL> now, card <CARD>" and clean[154].n_chars == len(clean[154].text)
    assert clean[155].text == "" and clean[156].text is None
    assert {r.doc_id for r in packed} == set(clean)
    assert sorted(map(tuple, corpus_pipeline.run(spark, d).drop("sequence_id").collect())) == sorted(map(tuple, at.drop("sequence_id").collect()))


def test_stages_keep_odd_rows_and_columns_of_any_name(spark, folder):
    """Nulls, empty and very long texts, repeated rows and clashing columns go through every stage; what stays is whole."""
    d = folder[0]
    rows, at = hostile(spark)
    names = at.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = corpus_pipeline.save(stage(spark, at, d), f"odd-{name}")
        assert at.columns == names and all(set(r[2:]) == {"x"} for r in at.collect())
    texts = {(r.doc_id, r.text) for r in at.collect()}
    # The classifier knows no such texts; what it keeps loses copies alone.
    kept = {(r.doc_id, r.text) for r in corpus_pipeline.keep_good(spark, hostile(spark)[1], d).collect()}
    assert kept <= {(i, t) for i, t in rows} and {i for i, _ in kept} - {i for i, _ in texts} <= {5}
    packed = corpus_pipeline.pack(spark, at, d).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in texts}


def test_stages_of_an_empty_table(spark, folder):
    at = table(spark, [], DOCUMENT)
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.save(stage(spark, at, folder[0]), f"none-{name}")
        assert at.isEmpty()


def test_rows_repeated_under_one_id(spark, folder):
    """Copies under one doc_id, or none, leave one row; a text is never kept under an id that has another."""
    a, b = ("one text of eight words is given here", "another text of quite other words goes there")
    rows = [(5, a, "en", "s", 37), (5, b, "en", "s", 44), (3, b, "en", "t", 44), (None, a, "en", "s", 37), (5, a, "en", "s", 37)]
    got = corpus_pipeline.keep_one(spark, table(spark, rows, DOCUMENT), folder[0]).collect()
    assert sorted((r.doc_id, r.text, r.source) for r in got) == [(3, b, "t"), (5, a, "s")]


def test_names():
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
