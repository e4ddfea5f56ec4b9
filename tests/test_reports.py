import json

from pyspark.sql import functions as F

from plisse.plans import evaluation as E
from plisse.plans.compress import compress
from plisse.plans.options import Options
from plisse.sources import corpus, reports
from plisse.streaming import compress_stream


def test_headers_json_and_envelopes(spark):
    body = '{"messages":[{"role":"user","content":"café"}]}'
    e = [(1, bytearray(json.dumps({"payload": body, "options": {"min_group_size": 4}}).encode())), (2, bytearray(b'{"payload":"x","other":1}')), (3, bytearray(b"no")), (4, bytearray(b'{"payload":"x","options":{"o":1}}'))]
    o = {r.payload_id: r for r in reports.open_envelopes(spark.createDataFrame(e, "payload_id long, body binary")).collect()}
    assert [o[i].valid for i in (1, 2, 3, 4)] == [True, False, False, False] and bytes(o[1].body).decode() == body and o[1].options.min_group_size == 4
    c = compress(spark.createDataFrame([(1, bytearray(body.encode())), (2, bytearray(b"[1]"))], "payload_id long, body binary"))
    h = {r.payload_id: r.headers for r in reports.stats_headers(c).collect()}
    assert len(h[1]) == 13 and h[1]["x-stats-bytes-in"] == str(len(body.encode())) and h[2]["x-stats-noop-reason"] == "unknown_schema" and h[2]["x-stats-degraded"] == "true"
    j = {r.payload_id: json.loads(r.stats_json) for r in reports.stats_json(c).collect()}
    assert j[1]["noop_reason"] is None and j[1]["bytes_out"] == len(body.encode()) and j[2]["degraded"] is True
    r = json.loads({r.payload_id: r.response for r in reports.close_envelopes(c).collect()}[1])
    assert r["payload"] == body and r["stats"]["groups_collapsed"] == 0
    assert reports.transfer_metrics(c).first().degraded_total == 1


def test_request_metrics(spark):
    log = spark.createDataFrame([("/v1/compress", 200), ("/v1/compress", 200), ("/healthz", 404)], "route string, status int")
    assert {r.line for r in reports.request_metrics(log).collect()} == {'http_requests_total{route="/v1/compress",status="200"} 2', 'http_requests_total{route="/healthz",status="404"} 1'}


def test_summaries(spark):
    m = spark.createDataFrame([("a", "x", 100), ("a", "x", 401), ("a", "x", 402), ("a", "y", 5)], "baseline string, stratum string, reduction_permille int")
    got = {r.stratum: tuple(r)[2:] for r in E.summaries(m).collect()}
    assert got["x"] == (3, 401, 100, 402, True, "40.1%") and got["y"] == (1, 5, 5, 5, False, "0.5%")
    assert "| a | x | 3 |" in E.markdown(E.summaries(m), "Reduction")
    s = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    assert E.nearest_rank(s, "v", 500).first()[0] == 5.0 and E.nearest_rank(s, "v", 990).first()[0] == 10.0


def test_parity(spark):
    rows = [("counting", ["12"], "there are 12", "There are 12!"), ("counting", ["12"], "there are 112", "there are 112"), ("counting", ["12"], "12 here", "12 there"), ("summarisation", ["Disk"], "disk full", "the disk"), ("anomaly", ["x"], None, "x")]
    j = E.parity(spark.createDataFrame(rows, "task_class string, facts array<string>, baseline string, compressed string"))
    assert [r.parity for r in j.collect()] == [True, False, False, True, None]
    got = {r.task_class: (r.scored, r.parity_permille, r.meets_target) for r in E.class_scores(j).collect()}
    assert got == {"counting": (3, 333, False), "summarisation": (1, 1000, True), "anomaly": (1, 0, False)}


def test_answers_tokens_and_text(spark):
    df = spark.createDataFrame([("how many?", r"a\nbé", bytearray(b"one two")), ("q", r"bad\x", bytearray(b"\xff"))], "question string, payload string, body binary")
    r = df.select(E.ask(df, lambda p: p.str.len().astype(str)).alias("a"), E.unescape(F.col("payload")).alias("u"), E.bpe_tokens(F.col("body"), str.split).alias("n"), E.bpe_tokens(F.col("body"), None).alias("none")).collect()
    assert r[0].u == "a\nbé" and r[1].u is None and (r[0].n, r[1].n, r[0].none) == (2, None, None) and int(r[0].a) > 10
    f = spark.createDataFrame([(["ERROR a status=500", "ok"],)], "l array<string>").select(E.log_facts(F.col("l")).alias("f")).first().f
    assert (f.lines, f.errors, f.status) == (2, 1, "500")
    logs = ["ERROR a status=500 path=/x user=ann took 7ms", "ok (cache warm) path=/y took 31ms", "path=/x"]
    f = spark.createDataFrame([(logs,)], "l array<string>").select(E.log_facts(F.col("l")).alias("f")).first().f
    assert (f.place, f.paths, f.users, f.slowest_ms) == ("cache warm", ["/x", "/y"], ["ann"], 31)


def test_generated_corpora(spark):
    for schema in ("chat", "responses", "messages", "text"):
        r = compress(corpus.chat_payloads(spark, 2, 240, schema)).collect()
        assert len(r) == 2 and all(x.schema == schema and x.noop_reason is None for x in r)
        assert all(x.groups_collapsed > 0 for x in r)
    given = corpus.adversarial(spark, 300)
    a = {r.name: r for r in compress(given).join(given.select("payload_id", "name"), "payload_id").collect()}
    assert a["depth-beyond"].noop_reason == "malformed" and a["depth-within"].noop_reason is None
    assert a["many-small-records"].record_splits == 1 and a["many-small-records"].bytes_out < a["many-small-records"].bytes_in / 10
    assert a["block-within"].block_repeats >= 1 and a["block-beyond"].block_repeats == 0
    assert a["record-within"].groups_collapsed == 1 and a["record-beyond"].groups_collapsed == 0
    assert [a[n].record_splits for n in ("line-within", "line-beyond")] == [0, 1]
    given = corpus.golden(spark)
    g = {r.name: r for r in compress(given).join(given.select("payload_id", "name"), "payload_id").collect()}
    folded = {n for n, r in g.items() if r.groups_collapsed}
    assert folded == {"chat-string", "chat-parts", "chat-spaced", "responses-string", "responses-items", "messages-blocks", "text", "bom", "twice", "escaped-key", "other-breaks", "unicode"}
    assert g["broken"].noop_reason == "malformed" and g["unknown"].noop_reason == "unknown_schema" and all(r.groups_collapsed <= 1 for r in g.values())


def test_perf_payload(spark):
    r = compress(corpus.perf_payloads(spark, 2, 300_000)).orderBy("payload_id").collect()
    assert [x.bytes_in > 300_000 for x in r] == [True, True] and bytes(r[0].body) != bytes(r[1].body)
    assert all(x.bytes_out < x.bytes_in / 5 and x.exact_runs and x.ws_runs and x.block_repeats and x.template_groups and x.templated_blocks and x.record_splits for x in r)


def test_exposition_and_json_report(spark):
    log = spark.createDataFrame([("/v1/compress", 200), ("/healthz", 200)], "route string, status int")
    c = compress(corpus.golden(spark).limit(4)).join(corpus.golden(spark).select("payload_id", "name", "stratum"), "payload_id")
    lines = [r.line for r in reports.exposition(log, c).orderBy("place").collect()]
    assert lines[:4] == ["# HELP http_requests_total Requests served, by route and status.", "# TYPE http_requests_total counter", 'http_requests_total{route="/healthz",status="200"} 1', 'http_requests_total{route="/v1/compress",status="200"} 1']
    assert sum(x.startswith("# HELP") for x in lines) == 4 and 'build_info{algo_version="0.1.0",reversible="true"} 1' == lines[-1]
    assert f'payload_bytes_total{{direction="in"}} {sum(r.bytes_in for r in c.collect())}' in lines
    m = E.measurements(c)
    report = json.loads(E.json_report(E.summaries(m), m, Options().echo()).first().report)
    assert len(report["payloads"]) == 4 and report["target_permille"] == 400 and report["summaries"][0]["stratum"] == "golden"
    assert report["options"]["marker_style"] == "auto" and report["payloads"][0]["detectors"]["exact_runs"] == 0


def test_tokens_of_a_public_vocabulary(spark):
    encode = E.public_encoder()
    c = compress(corpus.chat_payloads(spark, 2, 240)).withColumn("stratum", F.lit("x"))
    r = E.measurements(c, "words", encode).collect()
    assert len(r) == 2 and all(x.tokens_in == len(encode(bytes(x.body).decode())) and 0 < x.tokens_out < x.tokens_in for x in r)


def test_stream(spark, tmp_path):
    corpus.chat_payloads(spark, 3, 120).select("payload_id", "body").write.parquet(str(tmp_path / "in"))
    got = []
    q = compress_stream(spark.readStream.schema("payload_id long, body binary").parquet(str(tmp_path / "in")), lambda df, n: got.extend(df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert len(got) == 3 and all(r.bytes_out < r.bytes_in for r in got)


def test_span_shapes(spark):
    rows = [("user", r"a\nb"), ("user", r"a\\nb"), ("user", "x" * 70_000), ("tool", "y")]
    got = {r["class"]: (r.multi_line, r.single_line, r.over_cap) for r in E.span_shapes(spark.createDataFrame(rows, "class string, text string")).collect()}
    assert got == {"user": (1, 1, 1), "tool": (0, 1, 0)}
