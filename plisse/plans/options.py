"""Options of a compaction, validated on the driver."""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote_to_bytes

#: Fixed limits and defaults.
MIN_BLOCK_LINES, MAX_BLOCK_LINES = 2, 64
MAX_LINE_BYTES, MAX_RECORD_BYTES, MAX_SPAN_BYTES = 65_536, 16_384, 33_554_432
JSON_DEPTH, SNIFF_BYTES, BODY_LIMIT = 64, 65_536, 67_108_864
TABLE_KEYS = 196_608
PREVIEW_SPANS = 64
ALGO_VERSION = "0.1.0"
STORE_TTL_SECONDS, STORE_BYTES = 900, 67_108_864
SCOPES, STYLES, SCHEMAS = ("user_content", "user_and_tools"), ("auto", "ascii", "unicode"), ("chat", "responses", "messages", "text")
RESERVED_SCOPES = ("all_messages", "explicit_paths")


class OptionError(ValueError):
    """An option has a value that isn't allowed."""


@dataclass(frozen=True)
class Options:
    """min_group_size 0 stands for its default, 3. content_type pins the schema of every payload. strict_validate leaves
    payloads alone that aren't valid JSON throughout; it is a setting of the engine and not echoed."""

    scope_policy: str = "user_content"
    min_group_size: int = 3
    normalize_ws: bool = True
    template_dedup: bool = True
    marker_style: str = "auto"
    reversible: bool = False
    content_type: str | None = None
    strict_validate: bool = False

    def __post_init__(self):
        if self.scope_policy in RESERVED_SCOPES:
            raise OptionError(f"scope_policy {self.scope_policy} is reserved")
        if self.scope_policy not in SCOPES:
            raise OptionError(f"unknown scope_policy {self.scope_policy}")
        if self.min_group_size == 0:
            object.__setattr__(self, "min_group_size", 3)
        if not 2 <= self.min_group_size < 1 << 32:
            raise OptionError("min_group_size must be at least 2")
        if self.marker_style not in STYLES:
            raise OptionError(f"unknown marker_style {self.marker_style}")
        if self.content_type is not None and self.content_type not in SCHEMAS:
            raise OptionError(f"unknown content_type {self.content_type}")

    def echo(self) -> str:
        """Canonical JSON of the options, in fixed order."""
        flag = lambda x: "true" if x else "false"
        return f'{{"scope_policy":"{self.scope_policy}","min_group_size":{self.min_group_size},"normalize_ws":{flag(self.normalize_ws)},"template_dedup":{flag(self.template_dedup)},"marker_style":"{self.marker_style}","reversible":{flag(self.reversible)}}}'

    @staticmethod
    def from_query(query: str) -> Options:
        """Options from a query string: '+' and percent decoding, the first of repeated names wins, unknown names are errors."""
        found: dict[str, str] = {}
        for pair in filter(None, query.split("&")):
            name, _, value = (unquote_to_bytes(x.replace("+", " ")).decode() for x in pair.partition("="))
            found.setdefault(name, value)
        return Options.from_texts(found)

    @staticmethod
    def from_texts(found: dict[str, str]) -> Options:
        out: dict = {}
        for name, value in found.items():
            if name in ("scope_policy", "marker_style", "content_type"):
                out[name] = None if (name, value) == ("content_type", "auto") else value
            elif name in ("normalize_ws", "template_dedup", "reversible"):
                if value not in ("true", "false"):
                    raise OptionError(f"{name} must be true or false")
                out[name] = value == "true"
            elif name == "min_group_size":
                if not value.isascii() or not value.isdigit():
                    raise OptionError("min_group_size must be a number")
                out[name] = int(value)
            else:
                raise OptionError(f"unknown option {name}")
        return Options(**out)
