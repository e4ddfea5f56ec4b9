"""What leaves the engine beside the payloads: statistics as headers, JSON and counters, and the envelope form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plisse.functions.text import latin1
from plisse.plans.options import ALGO_VERSION, BODY_LIMIT

#: Names in the order in which they are written. Fixed formats.
HEADERS = ("bytes_in", "bytes_out", "approx_tokens_in", "approx_tokens_out", "groups_collapsed", "exact_runs", "ws_runs", "block_repeats", "template_groups", "templated_blocks", "record_splits", "degraded", "algo_version")
STATS = (*HEADERS[:9], "degraded", "noop_reason", "algo_version", "templated_blocks", "options_echo", "record_splits", "restore_ids")
OPTIONS = T.StructType([T.StructField("scope_policy", T.StringType()), T.StructField("min_group_size", T.LongType()), T.StructField("normalize_ws", T.BooleanType()), T.StructField("template_dedup", T.BooleanType()), T.StructField("marker_style", T.StringType()), T.StructField("reversible", T.BooleanType())])
ENVELOPE = T.StructType([T.StructField("payload", T.StringType()), T.StructField("content_type", T.StringType()), T.StructField("options", OPTIONS)])


def stats_headers(compressed: DataFrame) -> DataFrame:
    """(payload_id, headers map<string,string>): the statistics as x-stats-* headers, the noop reason only where there is one."""
    pairs = [x for n in HEADERS for x in (F.lit("x-stats-" + n.replace("_", "-")), F.col(n).cast("string"))]
    base = F.create_map(*pairs)
    noop = F.when(F.col("noop_reason").isNotNull(), F.create_map(F.lit("x-stats-noop-reason"), F.col("noop_reason"))).otherwise(F.create_map().cast("map<string,string>"))
    return compressed.select("payload_id", F.map_concat(base, noop).alias("headers"))


def stats_json(compressed: DataFrame) -> DataFrame:
    """(payload_id, stats_json), nulls written out."""
    return compressed.select("payload_id", F.to_json(F.struct(*STATS), {"ignoreNullFields": "false"}).alias("stats_json"))


def within_limit(payloads: DataFrame, limit: int = BODY_LIMIT) -> Column:
    return F.octet_length(payloads["body"]) <= limit


def open_envelopes(requests: DataFrame) -> DataFrame:
    """requests(payload_id, body) in envelope form → (payload_id, body, content_type, options, valid).

    valid is false where the body isn't a JSON object with a payload, or has unknown fields on either level.
    """
    text = F.decode("body", "UTF-8")
    e = F.from_json(text, ENVELOPE)
    known = lambda keys, names: F.coalesce(F.size(F.array_except(keys, F.array(*map(F.lit, names)))) == 0, F.lit(True))
    top = F.json_object_keys(text)
    inner = F.json_object_keys(F.get_json_object(text, "$.options"))
    ok = F.coalesce(top.isNotNull() & e["payload"].isNotNull() & known(top, ENVELOPE.names) & known(inner, OPTIONS.names), F.lit(False))
    return requests.select("payload_id", F.encode(e["payload"], "UTF-8").alias("body"), e["content_type"].alias("content_type"), e["options"].alias("options"), ok.alias("valid"))


def close_envelopes(compressed: DataFrame) -> DataFrame:
    """(payload_id, response): {"payload": ..., "stats": {...}}."""
    return compressed.select("payload_id", F.to_json(F.struct(F.decode("out", "UTF-8").alias("payload"), F.struct(*STATS).alias("stats")), {"ignoreNullFields": "false"}).alias("response"))


def request_metrics(log: DataFrame) -> DataFrame:
    """log(route, status) counted: (route, status, requests, line), the line being that of a text exposition."""
    n = log.groupBy("route", "status").agg(F.count("*").alias("requests"))
    return n.withColumn("line", F.format_string('http_requests_total{route="%s",status="%s"} %d', "route", F.col("status").cast("string"), "requests"))


def transfer_metrics(compressed: DataFrame) -> DataFrame:
    """One row: bytes in and out, and degraded payloads."""
    return compressed.agg(F.coalesce(F.sum("bytes_in"), F.lit(0)).alias("bytes_in_total"), F.coalesce(F.sum("bytes_out"), F.lit(0)).alias("bytes_out_total"), F.count_if("degraded").alias("degraded_total"))


#: Families of the exposition: name, kind, help. Fixed format.
FAMILIES = (
    ("http_requests_total", "counter", "Requests served, by route and status."),
    ("payload_bytes_total", "counter", "Payload bytes handled, by direction."),
    ("pass_through_total", "counter", "Responses that passed a payload through untouched."),
    ("build_info", "gauge", "Algorithm version and build flags."),
)


def exposition(log: DataFrame, compressed: DataFrame, reversible: bool = True) -> DataFrame:
    """(place, line): the four metric families as lines of a text exposition, each after its HELP and TYPE, in order of place."""
    head = lambda k: [(k, 0, "", f"# HELP {FAMILIES[k][0]} {FAMILIES[k][2]}"), (k, 1, "", f"# TYPE {FAMILIES[k][0]} {FAMILIES[k][1]}")]
    schema = "family int, part int, key string, line string"
    fixed = log.sparkSession.createDataFrame([x for k in range(4) for x in head(k)] + [(3, 2, "", f'build_info{{algo_version="{ALGO_VERSION}",reversible="{str(reversible).lower()}"}} 1')], schema)
    requests = request_metrics(log).select(F.lit(0).alias("family"), F.lit(2).alias("part"), F.concat_ws(" ", "route", F.lpad(F.col("status").cast("string"), 5, "0")).alias("key"), "line")
    t = transfer_metrics(compressed)
    values = [(1, 2, 'payload_bytes_total{direction="in"} %d', "bytes_in_total"), (1, 3, 'payload_bytes_total{direction="out"} %d', "bytes_out_total"), (2, 2, "pass_through_total %d", "degraded_total")]
    each = F.explode(F.array(*[F.struct(F.lit(a).alias("family"), F.lit(b).alias("part"), F.lit("").alias("key"), F.format_string(f, n).alias("line")) for a, b, f, n in values]))
    lines = fixed.unionByName(requests).unionByName(t.select(each.alias("x")).select("x.*"))
    return lines.select(F.struct("family", "part", "key").alias("place"), "line")


def preview(body: Column, n: int = 80) -> Column:
    return F.substring(latin1(body), 1, n)
