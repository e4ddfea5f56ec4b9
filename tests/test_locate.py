import json

import pytest

from plisse.plans.options import OptionError, Options
from plisse.sources.locate import detect, key_name, locate, mismatch, sniff


def found(payload, scope="user_content", pinned=None):
    raw = payload if isinstance(payload, bytes) else json.dumps(payload, separators=(",", ":")).encode()
    at = locate(raw, scope, pinned)
    return [(raw[s["start"] : s["end"]].decode(), s["class"]) for s in at["spans"]], at["noop_reason"]


def chat(*messages, **more):
    return {**more, "messages": [{"role": r, "content": c} for r, c in messages]}


def test_sniff():
    assert sniff(b'{"messages":[]}') == "chat"
    assert sniff(b'{"messages":[],"max_tokens":3}') == "messages"
    assert sniff(b'{"system":"s","messages":[]}') == "messages"
    assert sniff(b'{"input":"x"}') == "responses"
    assert sniff(b'{"input":"x","messages":[]}') == "chat"
    assert sniff(b'{"messages" :[]}') is None
    assert sniff(b'{"a":{"messages":[]}}') is None
    assert sniff(b"plain text") == sniff(b"") == sniff(b"\xef\xbb\xbf  hello") == "text"
    assert sniff(b"[1]") is None and sniff(b'"x"') is None
    assert sniff(b'\xef\xbb\xbf {"messages":[]}') == "chat"
    assert sniff(b'{"x":"' + b"a" * 70_000 + b'","messages":[]}') is None


def test_keys():
    assert key_name(b"role") == key_name(b"\\u0072ole") == key_name(b"\\u0172ole") == b"role"
    for raw in (b"Role", b"roles", b"\\ud83d\\ude00", b"\\u00", b"role\\", b""):
        assert key_name(raw) is None


def test_roles_and_parts():
    assert found(chat(("user", "a"), ("assistant", "b"), ("system", "c"), ("tool", "d")))[0] == [("a", "user")]
    assert found(chat(("user", "a"), ("tool", "d")), "user_and_tools")[0] == [("a", "user"), ("d", "tool")]
    parts = [{"type": "text", "text": "p"}, {"type": "image_url", "text": "q"}, {"text": "r", "type": "text"}]
    assert found(chat(("user", parts)))[0] == [("p", "user"), ("r", "user")]
    assert found(chat(("user", "")))[0] == [] and found(chat(("user", None)))[0] == []


def test_responses_and_tools():
    assert found({"input": "whole"})[0] == [("whole", "user")]
    call = {"input": [{"role": "user", "content": "q"}, {"type": "function_call_output", "output": "result"}]}
    assert found(call)[0] == [("q", "user")]
    assert found(call, "user_and_tools")[0] == [("q", "user"), ("result", "tool")]
    block = {"max_tokens": 1, "messages": [{"role": "user", "content": [{"type": "tool_result", "content": [{"type": "text", "text": "t"}]}, {"type": "tool_result", "content": "s"}]}]}
    assert found(block)[0] == [] and found(block, "user_and_tools")[0] == [("t", "tool"), ("s", "tool")]
    assert found({"messages": block["messages"]}, "user_and_tools")[0] == []


def test_last_of_equal_keys_wins():
    assert found(b'{"messages":[{"role":"assistant","content":"a","role":"user","content":"b"}]}')[0] == [("b", "user")]
    assert found(b'{"messages":[{"role":"user","content":"a"}],"messages":[{"role":"user","content":"b"}]}')[0] == [("b", "user")]
    assert found(b'{"messages":[{"role":"user","content":"a","content":5}]}')[0] == []


@pytest.mark.parametrize("bad", [b'{"messages":[}', b'{"messages":[{"role":"user","content":"a"}]', b'{"messages":[]} x', b'{"messages":[],}', b'{"messages":[,]}', b'{"messages":[1,]}', b'{"messages":[nul]}', b'{"messages":[-]}', b'{"messages":["a\nb"]}', b'{"messages":["a]}', b'{"messages":' + b"[" * 64 + b"]" * 64 + b"}"])
def test_malformed(bad):
    assert found(bad) == ([], "malformed")


def test_lenient_forms():
    assert found(b'{"messages":[{"role":"user","content":"a"}x}')[1] is None
    assert found(b'{"messages":[1e+-.5,{"role":"user","content":"a"}]}')[0] == [("a", "user")]
    assert found(b'{"messages":' + b"[" * 62 + b"]" * 62 + b"}")[1] is None


def test_text_and_pins():
    assert found(b"\xef\xbb\xbfabc") == ([("abc", "user")], None)
    assert found(b"[1,2]", pinned="text")[0] == [("[1,2]", "user")]
    assert found(b"[1,2]")[1] == "unknown_schema"
    assert not mismatch("text", None) and mismatch("chat", None) and not mismatch("chat", "messages") and mismatch("responses", "chat")


def test_detect(spark):
    many = chat(*[("user", f"m{i}") for i in range(70)])
    rows = [(1, bytearray(json.dumps(many, separators=(",", ":")).encode())), (2, None), (3, bytearray(b"[1]"))]
    got = {r.payload_id: r for r in detect(spark.createDataFrame(rows, "payload_id long, body binary")).collect()}
    assert (got[1].n_spans, len(got[1].spans), got[1].spans_truncated) == (70, 64, True)
    assert got[2].schema == "text" and got[2].n_spans == 0 and got[3].noop_reason == "unknown_schema"


def test_options():
    assert Options().echo() == '{"scope_policy":"user_content","min_group_size":3,"normalize_ws":true,"template_dedup":true,"marker_style":"auto","reversible":false}'
    assert Options(min_group_size=0).min_group_size == 3
    assert Options.from_query("min_group_size=5&min_group_size=9&marker_style=asc%69i&normalize_ws=false") == Options(min_group_size=5, marker_style="ascii", normalize_ws=False)
    for bad in ("x=1", "min_group_size=1", "scope_policy=all_messages", "reversible=yes", "marker_style=loud"):
        with pytest.raises(OptionError):
            Options.from_query(bad)
