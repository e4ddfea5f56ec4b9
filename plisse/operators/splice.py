"""Markers, and the payload with them in place of the removed bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plisse.functions import text as T
from plisse.functions.hashes import marker_checksums, restore_id

_FIELDS = "struct<removed_start:int,removed_end:int,anchor_start:int,anchor_end:int,span_no:int,style:string,kind:string,count:bigint,first:int,last:int,marker:string>"


def by_payload(found: DataFrame) -> Column:
    """An aggregate of find_groups(): all commits of a payload's spans, in order, those of degraded spans left out."""
    one = F.transform("commits", lambda c: F.struct(c["removed_start"], c["removed_end"], c["anchor_start"], c["anchor_end"], F.col("span_no"), F.col("style"), c["kind"], c["count"], c["first"], c["last"], F.lit(None).cast("string")).cast(_FIELDS))
    spans = F.collect_list(F.when(~F.col("degraded"), F.struct("span_no", one.alias("c"))))  # one payload's
    return F.flatten(F.transform(F.array_sort(spans), lambda x: x["c"]))


def splice(payloads: DataFrame) -> DataFrame:
    """payloads(body, commits, ...) with each commit's marker filled in, and out, the body after them.

    The pieces between the removed ranges are joined once, so the work is linear in the payload, however many commits it has.
    """
    some = F.size("commits") > 0
    anchors = F.transform("commits", lambda c: F.substring(F.col("body"), c["anchor_start"] + 1, c["anchor_end"] - c["anchor_start"]))
    p = payloads.withColumn("_k", F.when(some, marker_checksums(anchors)))
    marked = F.transform("commits", lambda c, i: c.withField("marker", F.concat(T.marker_core(c["style"], c["kind"], c["count"]), F.get("_k", i), T.marker_close(c["style"]))))
    p = p.withColumn("commits", F.when(some, marked).otherwise(F.array().cast(f"array<{_FIELDS}>")))
    part = lambda begin, size: T.latin1(F.substring("body", begin + 1, size))  # noqa: E731  of bytes, which takes no search

    def piece(c, i):
        begin = F.when(i == 0, 0).otherwise(F.get("commits", i - 1)["removed_end"])
        return F.concat(part(begin, c["anchor_end"] - begin), c["marker"])

    joined = F.concat(F.array_join(F.transform("commits", piece), ""), part(F.element_at("commits", -1)["removed_end"], F.octet_length("body")))
    return p.withColumn("out", F.when(some, T.to_bytes(joined)).otherwise(F.col("body"))).drop("_k")


def spliced_length(body: Column, commits: Column) -> Column:
    """Bytes of the result, from the commits alone."""
    return F.octet_length(body) + F.aggregate(commits, F.lit(0), lambda n, c: n - (c["removed_end"] - c["anchor_end"]) + T.marker_length(c["style"], c["kind"], c["count"]))


def originals(spliced: DataFrame) -> DataFrame:
    """(payload_id, seq, restore_id, original, marker) of every commit, in output order: what the restore store takes."""
    c = spliced.select("payload_id", "body", F.posexplode_outer("commits").alias("seq", "c")).where("seq is not null")
    c = c.select("payload_id", "seq", F.substring("body", F.col("c.removed_start") + 1, F.col("c.removed_end") - F.col("c.removed_start")).alias("original"), T.to_bytes(F.col("c.marker")).alias("marker"))
    return c.withColumn("restore_id", restore_id(F.col("original")))
