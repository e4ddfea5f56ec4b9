"""Corpus pipeline: quality, near copies, repeated passages, personal data, packing.

Every stage takes and returns the columns of documents, whatever others there are and whatever their names, but for the last,
which returns pieces. Null and empty texts and null doc_ids go through all of them: they are judged by the classifier's bias,
have no copies and no passages, hold no personal data, and are packed as an end id. An empty table stays empty. Where rows or
ids repeat, near_copies decides by the row (one of a class stays) and repeats by doc_id (null first) and text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plisse.llm import jaccard_join, packing, pii, quality, suffix_dedup
from plisse.llm.common import drop, save, table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars of a text that a stage may have changed."""
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; equal texts are judged alike."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the one with the smallest doc_id, null after all others; rows without words
    have no copies and all stay."""
    return jaccard_join.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand earlier in the corpus are cut; a document stays even if nothing is left of its text, a null text null."""
    return _counted(suffix_dedup.without_repeats(docs))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that give it away are replaced by their kind; a null text stays null."""
    return _counted(pii.sanitise(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left is packed, a null or empty one too; one row a piece."""
    return packing.pieces(docs)


STAGES = [("quality", keep_good), ("near_copies", keep_one), ("repeats", cut_repeats), ("pii", sanitise), ("packing", pack)]
#: SQL can't express the classifier or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder, read by the next, and deleted after that. The
    last one's input stays, as the result reads it."""
    docs, read = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        written: list[str] = []
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}", written)
        drop(spark, read)
        read = written
    return STAGES[-1][1](spark, docs, sf_dir)
