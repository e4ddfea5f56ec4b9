"""Compaction against a plain model of the detectors, written unit by unit as the rules say."""

import json
import random
import time

import xxhash
from pyspark.sql import functions as F

from plisse.functions import text as T
from plisse.operators import restore as R
from plisse.operators.splice import originals, spliced_length
from plisse.operators.units import explode_spans, joiners, split_pieces, split_units
from plisse.plans.compress import check_pin, compress, locate_payloads
from plisse.plans.options import Options
from plisse.sources.locate import is_valid, locate

WIDTH = {"exact_run": 26, "ws_run": 31, "block": 22, "template_group": 31, "templated_block": 32}


def model(units, raw, ws, masked, minimum=3, normalize=True, template=True):
    """Commits (kind, first, last, count) of units [(start, end)], by the forms of each."""
    n, claimed, out = len(units), [False] * len(units), []

    def gate(kind, first, anchor, stop, count):
        size = units[stop - 1][1] - units[first][0]
        if units[first + anchor - 1][1] - units[first][0] + WIDTH[kind] + len(str(count)) < size:
            out.append((kind, first, stop - 1, count))
            for i in range(first, stop):
                claimed[i] = True
            return True
        return False

    def runs(kind, form):
        i = 0
        while i < n:
            j = i + 1
            while not claimed[i] and j < n and not claimed[j] and form[j] == form[i]:
                j += 1
            if not claimed[i] and j - i >= max(2, minimum):
                gate(kind, i, 1, j, j - i - 1)
            i = j

    def blocks(kind, form, coarse, least):
        i = 0
        while i < n:
            step = i + 1
            room = 0
            while i + room < n and not claimed[i + room]:
                room += 1
            for size in range(min(64, room // 2), least - 1, -1):
                same = lambda a, b, m, f: f[a : a + m] == f[b : b + m]
                if not same(i, i + size, size, form):
                    continue
                if any(same(s, s + p, p, coarse) for p in range(1, size // 2 + 1) for s in range(i, i + size - 2 * p + 1)):
                    continue
                if i and not claimed[i - 1] and coarse[i - 1] == coarse[i]:
                    break
                copies = 2
                while (copies + 1) * size <= room and same(i, i + copies * size, size, form):
                    copies += 1
                if gate(kind, i, size, i + copies * size, copies - 1):
                    step = i + copies * size
                break
            i = step

    runs("exact_run", raw)
    if normalize:
        runs("ws_run", ws)
    blocks("block", ws, masked, 2)
    if template:
        runs("template_group", masked)
        blocks("templated_block", masked, masked, 1)
    return sorted(out, key=lambda c: c[1])


def payload(text):
    return bytearray(json.dumps({"messages": [{"role": "user", "content": text}]}, separators=(",", ":")).encode())


def random_text(rng):
    lines, words = [], ["alpha beta gamma delta worker %d", "request %d served by the pool in %dms", "a  b   c wide line of text %s", "short", "the same long line of text again and again"]
    while len(lines) < rng.randint(1, 45):
        k = rng.random()
        block = [rng.choice(words) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(1, 4)):
            for w in block:
                w = w.replace("%d", str(rng.randint(0, 3 if k < 0.5 else 1))).replace("%s", "x")
                lines.append(w + ("  " if rng.random() < 0.1 else ""))
    return "\n".join(lines)


def test_random_payloads_agree_with_the_model(spark):
    rng = random.Random(11)
    texts = [random_text(rng) for _ in range(120)]
    df = spark.createDataFrame([(i, payload(t)) for i, t in enumerate(texts)], "payload_id long, body binary")
    lines = [[w for w in t.split("\n") if w] for t in texts]
    flat = spark.createDataFrame([(i, j, w) for i, ws in enumerate(lines) for j, w in enumerate(ws)], "i int, j int, w string")
    forms = {(r.i, r.j): (r.ws, r.m) for r in flat.select("i", "j", T.normalize_ws(F.col("w")).alias("ws"), T.mask(T.normalize_ws(F.col("w"))).alias("m")).collect()}
    for options in (Options(), Options(min_group_size=2, normalize_ws=False), Options(template_dedup=False)):
        got = {r.payload_id: r for r in compress(df, options).select("*", spliced_length(F.col("body"), F.col("commits")).alias("balance")).collect()}
        for i, text in enumerate(texts):
            at, units = 0, []
            for w in text.split("\n"):
                if w:
                    units.append((at, at + len(w)))
                at += len(w) + 2
            ws, masked = ([forms[i, j][k] for j in range(len(units))] for k in (0, 1))
            want = model(units, lines[i], ws, masked, options.min_group_size, options.normalize_ws, options.template_dedup)
            assert [(c.kind, c["first"], c["last"], c["count"]) for c in got[i].commits] == want
            body = text.replace("\n", "\\n")
            at, out = 0, ""
            for kind, first, last, count in want:
                size = (last - first + 1) // (count + 1)
                anchor = body[units[first][0] : units[first + size - 1][1]]
                name = {"exact_run": f"x{count} identical", "ws_run": f"x{count} rows, ws-equal", "block": f"block x{count}", "template_group": f"x{count} rows, template", "templated_block": f"templated block x{count}"}[kind]
                out += body[at : units[first][0]] + anchor + f"[... {name} {xxhash.xxh3_64_intdigest(anchor.encode()) & 0xFFFF:04x} ...]"
                at = units[last][1]
            out += body[at:]
            assert bytes(got[i].out).decode() == f'{{"messages":[{{"role":"user","content":"{out}"}}]}}'
            assert got[i].balance == got[i].bytes_out == len(got[i].out)


def test_pass_through_and_statistics(spark):
    rows = [(1, bytearray(b"[1,2]")), (2, bytearray(b'{"messages":[}')), (3, None), (4, bytearray(b"plain\nplain\nplain")), (5, bytearray("﻿a⟪…".encode()))]
    got = {r.payload_id: r for r in compress(spark.createDataFrame(rows, "payload_id long, body binary")).collect()}
    for i, body in rows:
        assert bytes(got[i].out) == bytes(body or b"") and got[i].groups_collapsed == 0
    assert [(got[i].degraded, got[i].noop_reason) for i in (1, 2, 3, 4)] == [(True, "unknown_schema"), (True, "malformed"), (False, None), (False, None)]
    assert got[4].approx_tokens_in == 4 and got[4].options_echo == Options().echo() and got[4].restore_ids == []


def test_unicode_span_and_tools(spark):
    text = "\n".join(["café number %d was served by the kitchen" % (i * 7) for i in range(5)])
    df = spark.createDataFrame([(1, bytearray(json.dumps({"messages": [{"role": "tool", "content": text}]}, ensure_ascii=False, separators=(",", ":")).encode()))], "payload_id long, body binary")
    assert compress(df).first().groups_collapsed == 0
    r = compress(df, Options(scope_policy="user_and_tools")).first()
    assert r.template_groups == 1 and "⟪×4 rows, template ·" in bytes(r.out).decode()
    assert "[... x4 rows" in bytes(compress(df, Options(scope_policy="user_and_tools", marker_style="ascii")).first().out).decode()


def test_markers_are_not_folded_again(spark):
    line = "one long enough line that repeats itself"
    once = compress(spark.createDataFrame([(1, payload("\n".join([line] * 6)))], "payload_id long, body binary")).first()
    twice = compress(spark.createDataFrame([(1, once.out)], "payload_id long, body binary")).first()
    assert once.exact_runs == 1 and twice.out == once.out


def test_records_and_joiners(spark):
    rec = '{"a":%d,"note":"' + "n" * 900 + '"}'
    dump = "[" + ",".join(rec % i for i in range(80)) + "]"
    big = "[" + ",".join('{"b":"' + "x" * n + '"}' for n in (30_000, 16_372, 16_373, 20_000)) + "]"
    spans = explode_spans(locate_payloads(spark.createDataFrame([(1, payload(dump)), (2, payload(big)), (3, payload("a\n\n\nb"))], "payload_id long, body binary"), Options()))
    u = joiners(split_units(spans), spans).orderBy("payload_id", "unit_no").collect()
    one, two, three = ([r for r in u if r.payload_id == i] for i in (1, 2, 3))
    assert len(one) == 80 and all(r.eligible and r.over_cap for r in one) and sum(r.first_record for r in one) == 1
    assert [r.eligible for r in two] == [False, True, False, False]
    assert [(r.raw, r.start, r.end, r.joiner_end) for r in three] == [("a", 0, 1, 7), ("b", 7, 8, 8)]


def test_restore(spark):
    texts = ["\n".join(["the very same line of the log"] * (4 + i % 2)) for i in range(4)]
    c = compress(spark.createDataFrame([(i, payload(t)) for i, t in enumerate(texts)], "payload_id long, body binary"), Options(reversible=True))
    ids = {r.payload_id: r.restore_ids for r in c.collect()}
    assert all(len(x) == 1 for x in ids.values()) and ids[0] == ids[2] != ids[1]
    now = F.timestamp_seconds(F.lit(1000))
    later = F.timestamp_seconds(F.lit(1900))
    store = R.insert(spark.createDataFrame([], R.STORE), R.entries(originals(c), now, F.lit(0)), now)
    assert store.count() == 2
    asked = spark.createDataFrame([(ids[0][0],), (ids[1][0],), ("0" * 32 + ":4",), ("junk",)], "restore_id string")
    back = {r.restore_id: r.original for r in R.restore(asked, store, now).collect()}
    assert bytes(back[ids[0][0]]) == texts[0].replace("\n", "\\n").encode() and back["junk"] is None and back["0" * 32 + ":4"] is None
    assert R.restore(asked, store, later).where("original is not null").isEmpty()
    newest = R.entries(originals(c), later, F.lit(10))
    assert [r.seq for r in R.insert(store, newest, later, max_bytes=200).collect()] == [newest.agg(F.max("seq")).first()[0]]
    assert R.insert(store, R.entries(originals(c), now, F.lit(10)), now, max_bytes=10).isEmpty()


def test_pins(spark):
    rows = [(1, payload("x")), (2, bytearray(b'{"input":"x"}')), (3, bytearray(b'{"messages":[}')), (4, bytearray(b"[1]"))]
    got = {r.payload_id: r.content_type_mismatch for r in check_pin(spark.createDataFrame(rows, "payload_id long, body binary"), "chat").collect()}
    assert got == {1: False, 2: True, 3: True, 4: True}


def test_strict_validation(spark):
    """Documents that the lenient reader takes and the letter of JSON doesn't, and both sides of the limit of depth."""
    lenient = ['{"messages":[],"n":01}', '{"messages":[],"n":1.}', '{"messages":[],"n":nulls}', '{"messages":[],"n":-}', '{"messages":[{"role":"user","content":"\\x"}]}', '{"messages":[],"n":NaN}', '{"n":[1 2],"messages":[]}']
    valid = ['{"messages":[],"n":[-0.5e+3,true,null,"\\u00e9"]}', '{"messages":[],"n":' + "[" * 63 + "]" * 63 + "}"]
    broken = ['{"messages":[],"n":' + "[" * 64 + "]" * 64 + "}", '{"messages":[]} x']
    for t in lenient + broken:
        assert not is_valid(t.encode()), t
    for t in valid:
        assert is_valid(t.encode()) and locate(t.encode(), strict=True)["noop_reason"] is None
    assert locate(b"no json", strict=True)["schema"] == "text" and locate(b"[1,]", strict=True)["noop_reason"] == "malformed"
    line = "the very same line of the log, again"
    body = json.dumps({"messages": [{"role": "user", "content": "\n".join([line] * 5)}]}, separators=(",", ":"))[:-1] + ',"n":01}'
    df = spark.createDataFrame([(1, bytearray(body.encode()))], "payload_id long, body binary")
    assert compress(df).first().exact_runs == 1
    r = compress(df, Options(strict_validate=True)).first()
    assert r.noop_reason == "malformed" and bytes(r.out) == bytes(r.body) and r.degraded


def test_a_span_of_too_many_forms_passes_through(spark):
    """More different masked forms in one span than the table holds: that span stays, with degraded set, others are folded."""
    names = ["".join(random.Random(i).choices("ghijklmnop", k=12)) for i in range(40)]
    crowded, plain = "\n".join(names + [names[0] + " and some more of it"] * 9), "\n".join(["the same line of text every time"] * 9)
    body = json.dumps({"messages": [{"role": "user", "content": t} for t in (crowded, plain)]}, separators=(",", ":"))
    df = spark.createDataFrame([(1, bytearray(body.encode()))], "payload_id long, body binary")
    whole, cut = compress(df).first(), compress(df, table_keys=30).first()
    assert (whole.exact_runs, whole.degraded) == (2, False)
    assert (cut.exact_runs, cut.degraded, cut.noop_reason) == (1, True, None) and [c.span_no for c in cut.commits] == [1]
    assert compress(df, table_keys=41).first().exact_runs == 2


def test_splitting_is_linear_in_the_lines_of_a_span(spark):
    """77,000 lines of one span are split, and looked through, in seconds."""
    text = "\n".join(f"line {i} {i * 7919 % 104729:x}" for i in range(77_000))
    df = spark.createDataFrame([(1, payload(text))], "payload_id long, body binary")
    spans = explode_spans(locate_payloads(df, Options()))
    split_units(spans).count()
    began = time.monotonic()
    assert split_units(spans).count() == 77_000
    assert time.monotonic() - began < 20
    r = compress(df).first()
    assert r.template_groups + r.templated_blocks == r.groups_collapsed


def test_no_text_is_looked_through_beside_a_generator(spark):
    """The pieces alone go past the generator: above it, no pattern is searched in the text or in a line."""
    plan = split_pieces(explode_spans(locate_payloads(spark.createDataFrame([(1, payload("a"))], "payload_id long, body binary"), Options())))._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate explode")]
    assert "_lines" not in above and "regexp_extract_all" not in above and "text#" not in above.split("Generate posexplode")[0]
