"""Named queries of the engine over the tables of a scale-factor folder, and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plisse.functions import text as T
from plisse.functions.tables import materialize
from plisse.operators import restore as R
from plisse.operators.detect import block_starts, find_groups
from plisse.operators.splice import originals, spliced_length
from plisse.operators.units import explode_spans, split_pieces, split_units
from plisse.plans import evaluation as E
from plisse.plans.compress import check_pin, compress, units_of
from plisse.plans.options import Options
from plisse.plans.oracles import NOTE, ORACLES
from plisse.sources import corpus, reports
from plisse.sources.locate import detect, locate_column

STATS = ("payload_id", "bytes_in", "bytes_out", "approx_tokens_in", "approx_tokens_out", "groups_collapsed", "exact_runs", "ws_runs", "block_repeats", "template_groups", "templated_blocks", "record_splits", "degraded", "noop_reason")


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spans(df: DataFrame, key: str, text) -> DataFrame:
    """Spans straight from a text column: one a row, real line feeds as escapes."""
    escaped = F.replace(text, F.lit("\n"), F.lit("\\n"))
    s = df.select(F.col(key).alias("payload_id"), F.lit(0).alias("span_no"), F.lit(0).alias("base"), F.lit("user").alias("class"), F.decode(F.encode(escaped, "UTF-8"), "ISO-8859-1").alias("text"), *[c for c in ("lang",) if c in df.columns])
    return s.withColumn("style", T.resolve_style("auto", F.col("text")))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(_read(spark, sf_dir, "documents").where("text is not null"), "doc_id", F.col("text"))


def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = split_units(_documents(spark, sf_dir))
    return u.groupBy(F.col("payload_id").alias("doc_id")).agg(F.count("*").alias("n_units"), F.sum(F.length("raw")).alias("unit_bytes"), F.max("end").cast("long").alias("last_end"))


def _commits(found: DataFrame) -> DataFrame:
    """The commits of find_groups(), one a row, with their span's columns."""
    return found.select("payload_id", "style", F.explode("commits").alias("c")).select("payload_id", "style", "c.*")


def exact_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _commits(find_groups(split_pieces(_documents(spark, sf_dir)), stages=("exact_run",)))
    core = F.decode(T.to_bytes(T.marker_core(F.col("style"), F.col("kind"), F.col("count"))), "UTF-8")
    return c.select(F.col("payload_id").alias("doc_id"), F.col("first").cast("long").alias("first_unit"), F.col("count").alias("copies_omitted"), (F.col("anchor_end") - F.col("anchor_start")).cast("long").alias("anchor_bytes"), (F.col("removed_end") - F.col("removed_start")).cast("long").alias("removed_bytes"), core.alias("marker_core"))


def ws_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = split_units(_documents(spark, sf_dir))
    return u.select(F.col("payload_id").alias("doc_id"), F.col("unit_no").cast("long").alias("unit_no"), F.length(T.normalize_ws(F.col("raw"))).cast("long").alias("ws_bytes"))


def ws_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _commits(find_groups(split_pieces(_documents(spark, sf_dir)), stages=("exact_run", "ws_run")))
    return c.groupBy(F.col("payload_id").alias("doc_id")).agg(F.count_if(F.col("kind") == "exact_run").alias("exact_runs"), F.count_if(F.col("kind") == "ws_run").alias("ws_runs"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces straight from events: one a row, in the order of each user's log."""
    e = _read(spark, sf_dir, "events").repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id")
    no = F.lit(False)
    return e.select(F.col("user_id").alias("payload_id"), F.lit(0).alias("span_no"), F.lit("ascii").alias("style"), F.lit(0).alias("base"), no.alias("over_cap"), no.alias("head"), F.lit(2).alias("gap"), F.lit(True).alias("eligible"), corpus.event_line().alias("raw"))


def mask_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", T.mask(T.normalize_ws(corpus.event_line())).alias("masked"))


def template_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _commits(find_groups(_events(spark, sf_dir), stages=("template_group",)))
    return c.select(F.col("payload_id").alias("user_id"), F.col("first").cast("long").alias("first_unit"), F.col("count").alias("copies_omitted"), (F.col("removed_end") - F.col("removed_start")).cast("long").alias("removed_bytes"))


def block_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest repeated block of event templates at each start, before any is chosen."""
    return block_starts(_events(spark, sf_dir)).select(F.col("payload_id").alias("user_id"), F.col("at").alias("first_unit"), F.col("length").alias("block_units"), "copies")


def record_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dumps of the records of a return flag and 1000 order keys: lines mostly above the cap, cut into their records."""
    part = F.floor(F.col("l_orderkey") / 1000)
    r = _read(spark, sf_dir, "lineitem").select("l_returnflag", part.alias("part"), F.concat(F.lit('{"o":'), F.col("l_orderkey").cast("string"), F.lit(',"l":'), F.col("l_linenumber").cast("string"), F.lit(NOTE)).alias("r"), "l_orderkey", "l_linenumber")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", "r"))), lambda x: x["r"])  # of 1000 orders
    d = r.groupBy("l_returnflag", "part").agg(F.concat(F.lit("["), F.array_join(rows, ","), F.lit("]")).alias("text"))
    d = d.withColumn("key", F.concat("l_returnflag", F.col("part").cast("string")))
    u = split_units(_spans(d, "key", F.col("text")))
    n = u.groupBy("payload_id").agg(F.count("*").alias("n_records"), F.count_if("eligible").alias("n_eligible"), F.sum(F.length("raw")).alias("record_bytes"))
    return n.select(F.substring("payload_id", 1, 1).alias("l_returnflag"), F.expr("substring(payload_id, 2)").cast("long").alias("part"), "n_records", "n_eligible", "record_bytes")


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.mixed_payloads(_read(spark, sf_dir, "conversations"))


def sniff_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _mixed(spark, sf_dir).select("payload_id", locate_column(F.col("body")).alias("l"))
    return d.select(F.col("payload_id").alias("conv_id"), "l.schema", "l.noop_reason", F.size("l.spans").cast("long").alias("n_spans"))


def strict_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chats as they are (conv_id % 5 = 0), with a number that only a lenient reader takes (1, 2), and broken off (3, 4)."""
    p = corpus.conversation_payloads(_read(spark, sf_dir, "conversations"))
    form, text = F.pmod(F.col("payload_id"), F.lit(5)), F.decode("body", "UTF-8")
    body = F.when(form == 0, text).when(form < 3, F.concat(F.lit('{"n":01,'), F.expr("substring(decode(body, 'UTF-8'), 2)"))).otherwise(F.substring(text, 1, F.length(text) - 1))
    p = p.select("payload_id", F.encode(body, "UTF-8").alias("body"))
    ok = lambda strict: locate_column(F.col("body"), strict=strict)["noop_reason"].isNull()
    return p.select(F.col("payload_id").alias("conv_id"), ok(False).alias("lenient_ok"), ok(True).alias("strict_ok"))


def span_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = corpus.conversation_payloads(_read(spark, sf_dir, "conversations"))
    s = explode_spans(p.select("payload_id", "body", locate_column(F.col("body"))["spans"].alias("spans")))
    return s.groupBy(F.col("payload_id").alias("conv_id"), "class").agg(F.count("*").alias("n_spans"), F.sum(F.length("text")).alias("span_bytes"), F.count_if(F.col("style") == "ascii").alias("ascii_spans"))


def detect_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = detect(_mixed(spark, sf_dir), "user_and_tools")
    return d.select(F.col("payload_id").alias("conv_id"), "schema", F.col("n_user").cast("long").alias("n_user"), F.col("n_tool").cast("long").alias("n_tool"), F.size("spans").cast("long").alias("n_shown"), "spans_truncated")


def compress_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(corpus.event_payloads(_read(spark, sf_dir, "events"))).select(*STATS)


def compress_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(corpus.document_payloads(_read(spark, sf_dir, "documents"))).select(*STATS)


def compress_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the user says stands three times, as lines or blocks of lines, in spans of their own."""
    return compress(corpus.conversation_payloads(_read(spark, sf_dir, "conversations"), 3)).select(*STATS)


def compress_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as text payloads, a line each tag and the text after it."""
    lines = F.replace(F.replace("html", F.lit("\n"), F.lit("\\n")), F.lit("<"), F.lit("\\n<"))
    p = _read(spark, sf_dir, "pages").select(F.col("page_id").alias("payload_id"), F.encode(lines, "UTF-8").alias("body"))
    return compress(p, Options(content_type="text")).select("payload_id", "bytes_in", "bytes_out", "groups_collapsed", "degraded")


def bytes_in_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of each result by its commits, and as it is."""
    c = compress(corpus.event_payloads(_read(spark, sf_dir, "events")))
    return c.select(F.col("payload_id").alias("user_id"), "bytes_in", spliced_length(F.col("body"), F.col("commits")).cast("long").alias("by_commits"), "bytes_out")


def restore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every commit's original goes to the store and comes back by its id."""
    c = compress(corpus.document_payloads(_read(spark, sf_dir, "documents")), Options(reversible=True))
    now = F.timestamp_seconds(F.lit(1_767_225_600))
    o = materialize(originals(c), "originals")
    store = R.insert(spark.createDataFrame([], R.STORE), R.entries(o, now, F.lit(0)), now, max_bytes=1 << 40)
    back = R.restore(o.select("restore_id").distinct(), store, now)
    return o.join(back.withColumnRenamed("original", "restored"), "restore_id").groupBy(F.col("payload_id").alias("doc_id")).agg(F.count("*").alias("n_commits"), F.count_if(F.col("original") == F.col("restored")).alias("n_restored"))


def approx_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("text")
    return _read(spark, sf_dir, "documents").select("doc_id", T.approx_tokens(n).alias("stats_tokens"), E.eval_tokens(n).alias("eval_tokens"))


def reduction_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, least and greatest reduction by language, had each document its exact runs folded without markers."""
    spans = _documents(spark, sf_dir).withColumn("bytes_in", F.length("text").cast("long"))
    gone = F.aggregate("commits", F.lit(0).cast("long"), lambda n, c: n + c["removed_end"] - c["anchor_end"])
    m = find_groups(split_pieces(spans), stages=("exact_run",)).withColumn("bytes_out", F.col("bytes_in") - gone)
    return E.summaries(E.measurements(m), "lang").select("lang", "cases", "median_permille", "min_permille", "max_permille", "meets_target", "median_percent")


def span_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.span_shapes(_documents(spark, sf_dir).where("text != ''"), "lang")


def request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _read(spark, sf_dir, "events").select(F.concat(F.lit("/v1/"), "event_type").alias("route"), F.when(F.col("user_id") % 5 == 0, 404).otherwise(200).alias("status"))
    return reports.request_metrics(log)


def stats_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = compress(corpus.conversation_payloads(_read(spark, sf_dir, "conversations"), 3))
    return reports.stats_headers(c).select("payload_id", F.to_json("headers").alias("headers"))


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes that are well formed (doc_id % 4 = 0, 1), have an unknown option (2), or are none (3)."""
    d = _read(spark, sf_dir, "documents")
    form, fields = F.pmod(F.col("doc_id"), F.lit(4)), (F.col("text").alias("payload"), F.lit("text").alias("content_type"))
    body = F.when(form < 2, F.to_json(F.struct(*fields))).when(form == 2, F.to_json(F.struct(*fields, F.struct(F.lit(1).alias("o")).alias("options")))).otherwise("no envelope")
    e = reports.open_envelopes(d.select(F.col("doc_id").alias("payload_id"), F.encode(body, "UTF-8").alias("body")))
    return e.select(F.col("payload_id").alias("doc_id"), "content_type", "valid", F.octet_length("body").cast("long").alias("body_bytes"))


def pinned_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_pin(_mixed(spark, sf_dir), "chat").withColumnRenamed("payload_id", "conv_id")


def generated_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reduction of generated payloads of all schemas, by stratum, by a quarter of the bytes and by a public vocabulary."""
    parts = [corpus.chat_payloads(spark, 4, 600, schema) for schema in ("chat", "responses", "messages", "text")] + [corpus.golden(spark), corpus.adversarial(spark, 600)]
    every = parts[0].withColumn("part", F.lit(0))
    for k, p in enumerate(parts[1:], 1):
        every = every.unionByName(p.withColumn("part", F.lit(k)))
    every = every.withColumn("payload_id", F.col("part") * 1000 + F.col("payload_id"))
    c = compress(every.select("payload_id", "body")).join(every.select("payload_id", "stratum"), "payload_id")
    counted = E.measurements(c)
    if (encode := E.public_encoder()) is not None:
        counted = counted.unionByName(E.measurements(c, "word_bpe_49k", encode))
    return E.summaries(counted)


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units_of(corpus.conversation_payloads(_read(spark, sf_dir, "conversations"), 3))
    return u.groupBy(F.col("payload_id").alias("conv_id")).agg(F.count("*").alias("n_units"), F.count_if("eligible").alias("n_eligible"))


QUERIES = {f.__name__: f for f in (split_lines, exact_runs, ws_normalize, ws_runs, mask_forms, template_groups, block_candidates, record_split, sniff_schema, strict_check, span_inventory, detect_preview, compress_logs, compress_documents, compress_conversations, compress_pages, bytes_in_balance, restore_roundtrip, approx_tokens, reduction_summary, span_shapes, request_metrics, stats_headers, envelopes, pinned_mismatch, generated_corpus, units)}
