"""Seeded payloads for evaluation and benchmarks, generated where they are used: nothing comes from the driver but a range."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plisse.plans.options import JSON_DEPTH, MAX_BLOCK_LINES, MAX_LINE_BYTES, MAX_RECORD_BYTES

SEED = 0x5EED


def _pick(n: int, *parts) -> Column:
    return F.pmod(F.xxhash64(F.lit(SEED), *parts), F.lit(n))


def log_lines(spark: SparkSession, payloads: int, lines: int) -> DataFrame:
    """(payload_id, line_no, line): bursts of service logs, with exact repeats, padded repeats, template rows and traces."""
    rows = spark.range(payloads).select(F.col("id").alias("payload_id"), F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("line_no"))
    p, i = F.col("payload_id"), F.col("line_no")
    burst = F.floor(i / 12)
    kind = _pick(5, p, burst)
    stamp = F.date_format(F.timestamp_seconds(F.lit(1_767_225_600) + p * 86_400 + i), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    address = F.concat(F.lit("10."), _pick(256, p, i, F.lit(1)), F.lit("."), _pick(256, p, i, F.lit(2)), F.lit(".7"))
    repeated = F.concat(F.lit("WARN retrying shard "), _pick(64, p, burst), F.lit(" after timeout, backing off"))
    padded = F.concat(repeated, F.repeat(F.lit(" "), (_pick(4, p, i) + 1).cast("int")), F.lit("again"))
    template = F.concat(stamp, F.lit(" INFO request from "), address, F.lit(" took "), _pick(900, p, i), F.lit("ms status="), F.lit(200))
    trace = F.concat(F.lit("    at step_"), F.pmod(i, F.lit(4)), F.lit(" in module_"), _pick(50, p, burst), F.lit(" during the scheduled maintenance window"))
    unique = F.concat(F.lit("event "), F.hex(F.xxhash64(p, i)), F.lit(" "), F.hex(F.xxhash64(i, p)))
    line = F.when(kind == 0, repeated).when(kind == 1, padded).when(kind == 2, template).when(kind == 3, trace).otherwise(unique)
    return rows.select("payload_id", "line_no", line.alias("line"))


def chat_payloads(spark: SparkSession, payloads: int, lines: int, schema: str = "chat") -> DataFrame:
    """(payload_id, name, stratum, body): the lines of log_lines() as the one user string of a request of the schema."""
    text = log_lines(spark, payloads, lines).groupBy("payload_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("l"))
    joined = F.array_join(F.transform("l", lambda x: x["line"]), "\\n")
    head, tail = {
        "chat": ('{"model":"m","messages":[{"role":"user","content":"', '"}]}'),
        "responses": ('{"model":"m","input":"', '"}'),
        "messages": ('{"model":"m","max_tokens":1024,"messages":[{"role":"user","content":"', '"}]}'),
        "text": ("", ""),
    }[schema]
    return text.select("payload_id", F.concat(F.lit(f"log-{schema}-"), "payload_id").alias("name"), F.lit("log_heavy").alias("stratum"), F.encode(F.concat(F.lit(head), joined, F.lit(tail)), "UTF-8").alias("body"))


def _words(i: int, n: int) -> str:
    """n words that follow from i, mostly unlike those of another i."""
    return " ".join(f"{(i * 2_654_435_761 + k * 40_503) % 1_000_003:x}" for k in range(n))


def adversarial(spark: SparkSession, units: int = 4000) -> DataFrame:
    """(payload_id, name, stratum, body): one payload just within and one just beyond each limit of options.py that a payload
    of moderate size can meet, and payloads that give the detectors much to look at and nothing to fold."""
    ask = lambda text: '{"messages":[{"role":"user","content":"' + text + '"}]}'
    join = "\\n".join
    nested = lambda depth: '{"note":' + "[" * (depth - 1) + "]" * (depth - 1) + ',"messages":[{"role":"user","content":"hello"}]}'
    record = lambda size: '{\\"v\\":\\"' + "r" * (size - 12) + '\\"}'
    cases = {
        "block-within": ask(join(_words(i % MAX_BLOCK_LINES, 6) for i in range(units))),
        "block-beyond": ask(join(_words(i % (2 * MAX_BLOCK_LINES + 1), 6) for i in range(units))),
        "depth-within": nested(JSON_DEPTH),
        "depth-beyond": nested(JSON_DEPTH + 1),
        "line-within": ask("z" * MAX_LINE_BYTES),
        "line-beyond": ask("z" * (MAX_LINE_BYTES + 1)),
        "record-within": ask("[" + ",".join(record(MAX_RECORD_BYTES) for _ in range(6)) + "]"),
        "record-beyond": ask("[" + ",".join(record(MAX_RECORD_BYTES + 1) for _ in range(6)) + "]"),
        "all-different": ask(join(_words(i, 5) for i in range(units))),
        "every-second": ask(join(_words(i if i % 2 else 0, 5) for i in range(units))),
        "one-message-a-line": '{"messages":[' + ",".join('{"role":"user","content":"' + _words(i % 3, 1) + '"}' for i in range(units)) + "]}",
        "many-small-records": ask("[" + ",".join(f'{{\\"k\\":{i % 4},\\"of\\":\\"{_words(i % 4, 3)}\\"}}' for i in range(3000)) + "]"),
    }
    rows = [(i, name, "adversarial", bytearray(body.encode())) for i, (name, body) in enumerate(cases.items())]
    return spark.createDataFrame(rows, "payload_id long, name string, stratum string, body binary")


def golden(spark: SparkSession) -> DataFrame:
    """(payload_id, name, stratum, body): small payloads of every schema and form of content, with something to fold in each
    place that is eligible and the same in places that aren't."""
    rows = "\\n".join(f"2026-01-01T00:00:0{i}Z INFO worker {i} took {i * 7}ms for the nightly backup" for i in range(6))
    part = f'{{"type":"text","text":"{rows}"}}'
    cases = {
        "chat-string": f'{{"messages":[{{"role":"system","content":"{rows}"}},{{"role":"user","content":"{rows}"}}]}}',
        "chat-parts": f'{{"messages":[{{"role":"user","content":[{part},{{"type":"image_url","image_url":{{"url":"{rows}"}}}}]}}]}}',
        "chat-tool": f'{{"messages":[{{"role":"tool","content":"{rows}"}},{{"role":"assistant","content":"{rows}"}}]}}',
        "chat-null": '{"messages":[{"role":"user","content":null}]}',
        "chat-spaced": f'{{ "model" : "m", "messages":[ {{ "role" : "user" , "content" : "{rows}" }} ] }}',
        "responses-string": f'{{"input":"{rows}"}}',
        "responses-items": f'{{"input":[{{"role":"user","content":[{part}]}},{{"type":"function_call_output","call_id":"c","output":"{rows}"}}]}}',
        "messages-blocks": f'{{"max_tokens":9,"system":"{rows}","messages":[{{"role":"user","content":[{part}]}}]}}',
        "messages-tool": f'{{"max_tokens":9,"messages":[{{"role":"user","content":[{{"type":"tool_result","tool_use_id":"t","content":[{part}]}}]}}]}}',
        "text": rows,
        "bom": "\ufeff" + f'{{"input":"{rows}"}}',
        "twice": f'{{"input":"once","input":"{rows}"}}',
        "escaped-key": f'{{"input":[{{"r\\u006fle":"user","content":"{rows}"}}]}}',
        "other-breaks": f'{{"input":"{rows}"}}'.replace("\\n", "\\u000a"),
        "unicode": f'{{"input":"{rows}"}}'.replace("worker", "w\u00f6rker"),
        "unknown": f'["{rows}"]',
        "broken": f'{{"input":"{rows}"',
    }
    made = [(i, name, "golden", bytearray(body.encode())) for i, (name, body) in enumerate(cases.items())]
    return spark.createDataFrame(made, "payload_id long, name string, stratum string, body binary")


#: Size, seed and make-up of the payload on which throughput was published: lines of each kind a body, records a dump. Fixed values.
PERF_BYTES, PERF_SEED = 8 << 20, 0x0BADC0DE5EED1234
PERF_EXACT, PERF_WS, PERF_TEMPLATE, PERF_TRACE, PERF_REQUEST, PERF_RECORDS = 48, 12, 480, (8, 6), (10, 5), 900


def perf_body(body: int, seed: int = PERF_SEED) -> str:
    """One body of a log-heavy payload: as many lines of each kind as the fixed make-up has, all determined by body and seed."""
    rng = random.Random(seed * 1_000_003 + body)
    number, stamp = rng.randrange, lambda: f"2026-03-{rng.randrange(1, 29):02}T{rng.randrange(24):02}:{rng.randrange(60):02}:{rng.randrange(60):02}Z"
    out = [f"{stamp()} INFO gateway-{body % 7} came up with {body} shards"]
    out += ["2026-03-01T08:00:00Z INFO gateway answered the probe of the load balancer path=/live status=204 in 3ms"] * PERF_EXACT
    out += [" " * (i % 3) + "2026-03-01T08:00:01Z INFO gateway reads the cache tier=warm entries=512" + " " * (3 - i % 4 + i % 2) for i in range(PERF_WS)]
    out += [f"{stamp()} INFO gateway call {rng.getrandbits(64):016x} from 10.{number(256)}.{number(256)}.{number(256)} took {number(1, 900)}ms bytes={number(1000, 900_000)} span={rng.getrandbits(128):032x}" for _ in range(PERF_TEMPLATE)]
    copies, depth = PERF_TRACE
    out += [f"    in {('open', 'parse', 'check', 'price', 'store', 'reply')[k]}() at /app/{'abcdef'[k]}/step.py line {100 + 13 * k}" for _ in range(copies) for k in range(depth)]
    copies, steps = PERF_REQUEST
    out += [f"step {'abcde'[k]} of order {number(90_000)} ended after {number(1, 900)}ms with trace {rng.getrandbits(128):032x}" for _ in range(copies) for k in range(steps)]
    out.append("[" + ",".join(f'{{\\"id\\":\\"{rng.getrandbits(64):016x}\\",\\"level\\":{number(8)},\\"note\\":\\"unit {i:04} is ready\\",\\"seq\\":{i}}}' for i in range(PERF_RECORDS)) + "]")
    return "\\n".join(out) + "\\n"


def perf_payloads(spark: SparkSession, payloads: int = 1, size: int = PERF_BYTES) -> DataFrame:
    """(payload_id, name, stratum, body): log-heavy chat payloads of about `size` bytes each, made in the tasks."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column("id").to_pylist():
                parts, total, body = [], 0, 0
                while total < size:
                    parts.append(perf_body(body, PERF_SEED + i))
                    total, body = total + len(parts[-1]), body + 1
                text = '{"model":"m","messages":[{"role":"user","content":"' + "".join(parts) + '"}]}'
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([f"perf-{i}"]), pa.array(["perf"]), pa.array([text.encode()])], names=["payload_id", "name", "stratum", "body"])

    return spark.range(payloads, numPartitions=payloads).mapInArrow(make, "payload_id long, name string, stratum string, body binary")


def mixed_payloads(conversations: DataFrame) -> DataFrame:
    """(payload_id, body): conversations as requests of form conv_id % 5: 0 chat, 1 responses, 2 messages, 3 text, 4 a chat that
    breaks off. What the assistant said stands where a tool's output does."""
    say = F.col("t")
    quoted = F.expr("substr(to_json(named_struct('t', t)), 6, length(to_json(named_struct('t', t))) - 6)")
    form, user, tool = F.pmod(F.col("conv_id"), F.lit(5)), F.col("role") == "user", F.col("role") == "assistant"
    wrap = lambda head, tail: F.concat(F.lit(head), quoted, F.lit(tail))
    part = lambda role: wrap('{"type":"message","role":"' + role + '","content":[{"type":"text","text":', "}]}")
    chat = F.when(user, wrap('{"role":"user","content":', "}")).when(tool, wrap('{"role":"tool","content":', "}")).otherwise(wrap('{"role":"system","content":', "}"))
    responses = F.when(user, part("user")).when(tool, wrap('{"type":"function_call_output","call_id":"c","output":', "}")).otherwise(part("system"))
    messages = F.when(user, part("user")).when(tool, wrap('{"role":"user","content":[{"type":"tool_result","tool_use_id":"t","content":', "}]}")).otherwise(part("assistant"))
    one = F.when(form == 1, responses).when(form == 2, messages).when(form == 3, say).otherwise(chat)
    c = conversations.withColumn("t", F.coalesce("text", F.lit(""))).select("conv_id", "turn", one.alias("m"))
    c = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "m"))).alias("l"))  # one conversation's
    joined = lambda by: F.array_join(F.transform("l", lambda x: x["m"]), by)
    whole = F.concat(F.lit('{"messages":['), joined(","), F.lit("]}"))
    body = F.when(form == 1, F.concat(F.lit('{"input":['), joined(","), F.lit("]}"))).when(form == 2, F.concat(F.lit('{"max_tokens":64,"messages":['), joined(","), F.lit("]}")))
    body = body.when(form == 3, joined("\n")).when(form == 4, F.substring(whole, 1, F.length(whole) - 2)).otherwise(whole)
    return c.select(F.col("conv_id").alias("payload_id"), F.encode(body, "UTF-8").alias("body"))


def conversation_payloads(conversations: DataFrame, times: int = 1) -> DataFrame:
    """(payload_id, body): each conversation of conversations(conv_id, turn, role, text) as a chat request; what the user says
    is said so many times, a line each."""
    said = F.array_join(F.array_repeat("text", times), "\n")
    message = F.struct("role", F.when((F.col("role") == "user") & F.col("text").isNotNull(), said).otherwise(F.col("text")).alias("content"))
    c = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))).alias("l"))
    body = F.to_json(F.struct(F.transform("l", lambda x: x["m"]).alias("messages")))
    return c.select(F.col("conv_id").alias("payload_id"), F.encode(body, "UTF-8").alias("body"))


def event_line() -> Column:
    """An event as a log line; no double is printed, so every engine prints the same."""
    return F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), "event_type", F.lit(" user="), F.col("user_id").cast("string"), F.lit(" value="), F.floor("value").cast("string"), F.lit("ms"))


def event_payloads(events: DataFrame) -> DataFrame:
    """(payload_id, body): each user's events in order as the log in a chat request."""
    e = events.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", event_line().alias("line")))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"]), "\\n")
    return e.select(F.col("user_id").alias("payload_id"), F.encode(F.concat(F.lit('{"messages":[{"role":"user","content":"'), text, F.lit('"}]}')), "UTF-8").alias("body"))


def document_payloads(documents: DataFrame) -> DataFrame:
    """(payload_id, body): each document's text as a chat request."""
    body = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages")))
    return documents.select(F.col("doc_id").alias("payload_id"), F.encode(body, "UTF-8").alias("body"))
