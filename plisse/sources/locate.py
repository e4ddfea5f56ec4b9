"""Schema detection and the byte ranges of a payload's eligible strings."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plisse.plans.options import JSON_DEPTH, MAX_SPAN_BYTES, PREVIEW_SPANS, SNIFF_BYTES

BOM = b"\xef\xbb\xbf"
NAMES = (b"messages", b"input", b"role", b"content", b"type", b"text", b"output", b"system", b"tool_use_id", b"max_tokens")
SPANS = "array<struct<start:int,end:int,class:string>>"
LOCATED = f"struct<schema:string,noop_reason:string,spans:{SPANS}>"

_PUNCTUATION = re.compile(rb'"(?:[^"\\]|\\[\s\S])*+(?:"|\\?\Z)|[{}\[\]]')
_STRING = re.compile(rb'"([^"\\\x00-\x1f]*+(?:\\[\s\S][^"\\\x00-\x1f]*+)*+)"')
_SPACE = re.compile(rb"[ \t\n\r]*")
_NUMBER = re.compile(rb"[0-9.eE+-]*[0-9][0-9.eE+-]*")
_WORD = re.compile(rb"true|false|null")
_ESCAPE = re.compile(rb"\\(u[0-9A-Fa-f]{4}|u|[\s\S]|\Z)")
_SIMPLE = {b"b": b"\x08", b"f": b"\x0c", b"n": b"\n", b"r": b"\r", b"t": b"\t"}


class Malformed(Exception):
    pass


def key_name(raw: bytes) -> bytes | None:
    """The structural key that a raw key stands for, escapes decoded, None for any other.

    A code point is cut to its low byte, as the format's readers do; surrogates and bad escapes never match.
    """
    if b"\\" in raw:

        def one(m: re.Match) -> bytes:
            e = m[1]
            if e[:1] == b"u":
                point = int(e[1:], 16) if len(e) == 5 else 0xD800
                return b"\x00" if 0xD800 <= point < 0xE000 else bytes([point & 0xFF])
            return _SIMPLE.get(e, e or b"\x00")

        raw = _ESCAPE.sub(one, raw)
    return raw if raw in NAMES else None


def sniff(payload: bytes) -> str | None:
    """chat, responses, messages, text or None, from the keys of the root object that the first bytes show.

    A key counts only if its colon follows at once.
    """
    data = payload.removeprefix(BOM)
    head, depth, keys = data[:SNIFF_BYTES], 0, set()
    first = data.lstrip(b" \t\n\r")[:1]
    if first == b"{":
        for m in _PUNCTUATION.finditer(head):
            c = m[0]
            if c in (b"{", b"["):
                depth += 1
            elif c in (b"}", b"]"):
                depth = max(0, depth - 1)
            elif depth == 1 and head[m.end() : m.end() + 1] == b":":
                keys.add(key_name(c[1:-1]))
        if b"messages" in keys:
            return "messages" if keys & {b"max_tokens", b"system"} else "chat"
        return "responses" if b"input" in keys else None
    return None if first in (b"[", b'"') else "text"


@dataclass
class _Text:
    """A string's interior."""

    start: int
    end: int


class _Reader:
    """Reads a document into dicts of its structural keys (the last of equal keys stays), lists and string ranges.

    The grammar is as lenient as the format's: an array ends at any byte but a comma and '}', a number is a run of number
    bytes with a digit, a word needs only its prefix.
    """

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def document(self):
        value = self.value(0)
        self.space()
        if self.at != len(self.data):
            raise Malformed
        return value

    def space(self) -> bytes:
        self.at = _SPACE.match(self.data, self.at).end()
        return self.data[self.at : self.at + 1]

    def text(self) -> _Text:
        m = _STRING.match(self.data, self.at)
        if not m:
            raise Malformed
        self.at = m.end()
        return _Text(m.start(1), m.end(1))

    def value(self, depth: int):
        c = self.space()
        if c == b'"':
            return self.text()
        if c in (b"{", b"["):
            if depth >= JSON_DEPTH:
                raise Malformed
            self.at += 1
            return self.object(depth + 1) if c == b"{" else self.array(depth + 1)
        m = (_NUMBER if c in b"-0123456789" and c else _WORD).match(self.data, self.at)
        if not m:
            raise Malformed
        self.at = m.end()
        return None

    def object(self, depth: int) -> dict:
        out: dict = {}
        c = self.space()
        while c != b"}":
            if c != b'"':
                raise Malformed
            key = self.text()
            name = key_name(self.data[key.start : key.end])
            if self.space() != b":":
                raise Malformed
            self.at += 1
            value = self.value(depth)
            if name:
                out[name] = value
            c = self.space()
            if c == b",":
                self.at += 1
                c = self.space()
                if c == b"}":
                    raise Malformed
            elif c != b"}":
                raise Malformed
        self.at += 1
        return out

    def array(self, depth: int) -> list:
        out: list = []
        if self.space() != b"]":
            while True:
                out.append(self.value(depth))
                c = self.space()
                if c == b",":
                    self.at += 1
                    continue
                if c in (b"}", b""):
                    raise Malformed
                break
        self.at += 1
        return out


def _eligible(data: bytes, schema: str, root, tools: bool):
    """(text, class) of the eligible strings of a document that was read."""

    def raw(node: dict, key: bytes) -> bytes | None:
        v = node.get(key)
        return data[v.start : v.end] if isinstance(v, _Text) else None

    def objects(node) -> list[dict]:
        return [x for x in node if isinstance(x, dict)] if isinstance(node, list) else []

    if not isinstance(root, dict):
        return
    top = root.get(b"input" if schema == "responses" else b"messages")
    if schema == "responses" and isinstance(top, _Text):
        yield top, "user"
    for message in objects(top):
        role = {b"user": "user", b"tool": "tool" if tools else None}.get(raw(message, b"role"))
        content = message.get(b"content")
        if role and isinstance(content, _Text):
            yield content, role
        for block in objects(content):
            kind = raw(block, b"type")
            if kind == b"text":
                if role and isinstance(block.get(b"text"), _Text):
                    yield block[b"text"], role
            elif kind == b"tool_result" and schema == "messages" and tools:
                inner = block.get(b"content")
                if isinstance(inner, _Text):
                    yield inner, "tool"
                for part in objects(inner):
                    if raw(part, b"type") == b"text" and isinstance(part.get(b"text"), _Text):
                        yield part[b"text"], "tool"
        output = message.get(b"output")
        if tools and schema == "responses" and raw(message, b"type") == b"function_call_output" and isinstance(output, _Text):
            yield output, "tool"


#: Brackets outside strings.
_DEPTHS = re.compile(rb'"(?:[^"\\]|\\[\s\S])*+"|[{}\[\]]')


def is_valid(data: bytes) -> bool:
    """Whether data is one JSON document by the letter, nested JSON_DEPTH deep at most.

    The standard reader judges the grammar, on the Latin-1 view, as bytes needn't be UTF-8; it would also take NaN and
    infinities, which are refused. Nesting is counted first, so that it can't exhaust the reader.
    """
    depth = 0
    for m in _DEPTHS.finditer(data):
        c = m[0]
        depth += 1 if c in (b"{", b"[") else -1 if c in (b"}", b"]") else 0
        if depth > JSON_DEPTH:
            return False
    try:
        json.loads(data.decode("latin-1"), parse_constant=_refuse, parse_float=str, parse_int=str)
    except (ValueError, RecursionError):
        return False
    return True


def _refuse(name: str):
    raise ValueError(name)


def locate(payload: bytes, scope: str = "user_content", pinned: str | None = None, strict: bool = False) -> dict:
    """Schema, reason for leaving the payload alone, and eligible spans in order, as absolute byte ranges. strict: a payload
    other than text that isn't valid JSON is malformed, even where its eligible strings could be read."""
    schema = pinned or sniff(payload)
    bom = len(BOM) if payload.startswith(BOM) else 0
    if strict and schema != "text" and not is_valid(payload[bom:]):
        return {"schema": schema, "noop_reason": "malformed", "spans": []}
    if schema is None:
        return {"schema": None, "noop_reason": "unknown_schema", "spans": []}
    if schema == "text":
        found = [(_Text(0, len(payload) - bom), "user")]
    else:
        try:
            data = payload[bom:]
            found = list(_eligible(data, schema, _Reader(data).document(), scope == "user_and_tools"))
        except Malformed:
            return {"schema": schema, "noop_reason": "malformed", "spans": []}
    spans = sorted((t.start + bom, t.end + bom, c) for t, c in found if 0 < t.end - t.start <= MAX_SPAN_BYTES)
    return {"schema": schema, "noop_reason": None, "spans": [{"start": a, "end": b, "class": c} for a, b, c in spans]}


def locate_column(body: Column, scope: str = "user_content", pinned: str | None = None, strict: bool = False) -> Column:
    """locate() over Arrow batches, as LOCATED. A null payload is an empty one."""

    @F.arrow_udf(LOCATED)
    def run(bodies: pa.Array) -> pa.Array:
        out = [locate(x or b"", scope, pinned, strict) for x in bodies.to_pylist()]
        span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("class", pa.string())])
        return pa.array(out, pa.struct([("schema", pa.string()), ("noop_reason", pa.string()), ("spans", pa.list_(span))]))

    return run(body)


def mismatch(pinned: str, sniffed: str | None) -> bool:
    """Whether a pinned schema contradicts the detected one: text never does, chat and messages stand for each other."""
    if pinned == "text":
        return False
    return sniffed not in (("chat", "messages") if pinned in ("chat", "messages") else (pinned,))


def detect(payloads: DataFrame, scope: str = "user_content") -> DataFrame:
    """Preview: (payload_id, schema, noop_reason, n_spans, n_user, n_tool, spans, spans_truncated), at most 64 spans."""
    at = payloads.select("payload_id", locate_column(F.col("body"), scope).alias("l")).select("payload_id", "l.*")
    count = lambda c: F.size(F.filter("spans", lambda x: x["class"] == c)).alias(f"n_{c}")
    return at.select("payload_id", "schema", "noop_reason", F.size("spans").alias("n_spans"), count("user"), count("tool"), F.slice("spans", 1, PREVIEW_SPANS).alias("spans"), (F.size("spans") > PREVIEW_SPANS).alias("spans_truncated"))
