"""The compaction of payloads: locate, split, five detectors, splice, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plisse.functions import text as T
from plisse.operators.detect import find_groups
from plisse.operators.splice import by_payload, originals, splice
from plisse.operators.units import explode_spans, split_pieces, split_units
from plisse.plans.options import ALGO_VERSION, TABLE_KEYS, Options
from plisse.sources.locate import locate_column, mismatch

COUNTERS = {"exact_runs": "exact_run", "ws_runs": "ws_run", "block_repeats": "block", "template_groups": "template_group", "templated_blocks": "templated_block"}


def locate_payloads(payloads: DataFrame, options: Options) -> DataFrame:
    """payloads(payload_id, body) with schema, noop_reason, spans; no shuffle."""
    at = locate_column(F.col("body"), options.scope_policy, options.content_type, options.strict_validate)
    return payloads.select("payload_id", "body").withColumn("_l", at).select("payload_id", "body", F.col("_l.schema").alias("schema"), F.col("_l.noop_reason").alias("noop_reason"), F.col("_l.spans").alias("spans"))


def units_of(payloads: DataFrame, options: Options = Options()) -> DataFrame:
    return split_units(explode_spans(locate_payloads(payloads, options), options.marker_style))


def compress(payloads: DataFrame, options: Options = Options(), table_keys: int = TABLE_KEYS) -> DataFrame:
    """Compact payloads(payload_id, body): (payload_id, body, out, commits, and the statistics).

    Bytes outside the commits stay as they are. A payload of unknown schema or that doesn't parse passes through, and so does
    a span of more than table_keys different forms. Texts are shuffled once, by span, and split, compared and folded in that
    one stage; bodies once, to meet their commits. Null bodies count as empty; payload_ids are expected to be unique.
    """
    spans = explode_spans(locate_payloads(payloads, options), options.marker_style, keep_all=True).drop("class")
    found = find_groups(split_pieces(spans), options, table_keys=table_keys)
    kept = F.when(~F.col("degraded"), F.col("record_splits")).otherwise(0)
    per = found.groupBy(F.col("payload_id").alias("_id")).agg(F.first("schema").alias("schema"), F.first("noop_reason").alias("noop_reason"), F.max("degraded").alias("_degraded"), F.sum(kept).alias("record_splits"), by_payload(found).alias("commits"))
    bodies = payloads.select("payload_id", F.coalesce("body", F.lit(b"")).alias("body"))
    out = splice(bodies.join(per, F.col("payload_id").eqNullSafe(F.col("_id"))).drop("_id"))
    count = {name: _count(kind) for name, kind in COUNTERS.items()}
    n_in, n_out = F.octet_length("body").cast("long"), F.octet_length("out").cast("long")
    stats = {
        "bytes_in": n_in, "bytes_out": n_out, "approx_tokens_in": T.approx_tokens(n_in), "approx_tokens_out": T.approx_tokens(n_out), "groups_collapsed": F.size("commits").cast("long"), **count,
        "record_splits": F.col("record_splits"), "degraded": F.col("noop_reason").isNotNull() | F.col("_degraded"), "algo_version": F.lit(ALGO_VERSION), "options_echo": F.lit(options.echo()),
    }
    out = out.withColumns(stats).drop("_degraded")
    if options.reversible:
        ids = originals(out).groupBy("payload_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "restore_id"))), lambda x: x["restore_id"]).alias("restore_ids"))
        return out.join(ids, "payload_id", "left").withColumn("restore_ids", F.coalesce("restore_ids", F.array().cast("array<string>")))
    return out.withColumn("restore_ids", F.array().cast("array<string>"))


def _count(kind: str):
    return F.size(F.filter("commits", lambda c: c["kind"] == kind)).cast("long")


def check_pin(payloads: DataFrame, pinned: str) -> DataFrame:
    """(payload_id, content_type_mismatch) for a pinned schema: detected otherwise, or pinned and not readable."""
    free = locate_column(F.col("body"))
    held = locate_column(F.col("body"), pinned=pinned)
    kinds = [k for k in ("chat", "responses", "messages", "text") if mismatch(pinned, k)]
    wrong = free["schema"].isin(kinds) | (free["schema"].isNull() & F.lit(mismatch(pinned, None)))
    return payloads.select("payload_id", (F.coalesce(wrong, F.lit(False)) | F.coalesce(held["noop_reason"] == "malformed", F.lit(False))).alias("content_type_mismatch"))
