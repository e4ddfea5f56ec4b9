"""Scalar functions on the Latin-1 view of a span: one character is one byte of the payload, escapes are not decoded."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Escape units: \\uXXXX is six bytes, any other escape two; between them everything else.
LEXEME = r"(\\u[\s\S]{0,4}|\\[\s\S]|\\$|[^\\]+)"
#: Stand-ins outside Latin-1.
OPAQUE_SPACE, BREAK2, BREAK6, BREAK1, PAIR = "\u0100", "\u0101", "\u0102", "\u0103", "\u0104"


def latin1(body: Column) -> Column:
    return F.decode(body, "ISO-8859-1")


def to_bytes(text: Column) -> Column:
    return F.encode(text, "ISO-8859-1")


def lexemes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LEXEME), F.lit(1))


def normalize_ws(raw: Column) -> Column:
    """Runs of spaces and of the escapes for tab, line feed and carriage return become one space; both ends are trimmed."""
    kept = F.transform(lexemes(raw), lambda x: F.when(x.isin("\\t", "\\n", "\\r"), " ").when(x.startswith("\\u"), F.translate(x, " ", OPAQUE_SPACE)).otherwise(x))
    # Where no such escape can stand, nor one of six bytes, nothing is to be taken apart.
    some = F.lit(False)
    for e in "tnru":
        some = some | F.contains(raw, F.lit("\\" + e))
    plain = F.when(some, F.array_join(kept, "")).otherwise(raw)
    single = F.when(F.contains(plain, F.lit("  ")), F.regexp_replace(plain, " +", " ")).otherwise(plain)
    return F.translate(F.trim(single), OPAQUE_SPACE, " ")


def with_breaks(text: Column) -> Column:
    """The text with each line break (an escaped line feed) replaced by a stand-in for its two or six bytes."""
    kept = F.transform(lexemes(text), lambda x: F.when(x == "\\n", BREAK2).when(x.isin("\\u000A", "\\u000a"), BREAK6).otherwise(x))
    # Pairs of backslashes are hidden first, so that each one left begins an escape; only where an escape of six bytes holds
    # another backslash, or ends early, is the text taken apart.
    odd = text.rlike(r"\\u[^\\]{0,3}(?:\\|\z)")
    out = F.replace(text, F.lit("\\\\"), F.lit(PAIR))
    for escape, stand_in in (("\\n", BREAK2), ("\\u000A", BREAK6), ("\\u000a", BREAK6), (PAIR, "\\\\")):
        out = F.replace(out, F.lit(escape), F.lit(stand_in))
    return F.when(odd, F.array_join(kept, "")).otherwise(out)


_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]\d\d|\d{1,2})(?!\d)"
_V4 = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}"


def _v6() -> str:
    """Seven single colons, or '::' with at most seven groups and single colons; an IPv4 tail counts two groups."""
    g = r"[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f.])"
    forms = [rf"(?:{g}:){{7}}(?:\z|{g}(?!:))"]
    for a in range(5):
        left = "::" if a == 0 else f"{g}(?::{g}){{{a - 1}}}::"
        cost = max(0, 2 * a - 1)
        if a and cost <= 7:
            forms.append(left + r"\z")
        for b in range(4, -1, -1):
            if b and cost + 2 * b - 1 <= 7:
                forms.append(rf"{left}{g}(?::{g}){{{b - 1}}}(?!:)")
            if b and cost + 2 * b <= 7:
                forms.append(rf"{left}(?:{g}:){{{b}}}\z")
            if cost + 2 * b + 2 <= 7:
                forms.append(rf"{left}(?:{g}:){{{b}}}{_V4}")
    # Few texts have a colon so near: without one the forms aren't tried.
    return rf"(?={g[: g.index('(')].replace('{1,4}', '{0,4}')}:)(?:{'|'.join(forms)})"


#: What is masked, in order of priority at one place. Fixed patterns.
MASKS = (
    ("<ts>", r"\d{4}-\d{2}-\d{2}(?:[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d++)?+(?:[Zz]|[+-]\d{2}:?\d{2}|(?![Zz+-])))?|[A-Z][a-z]{2} +\d{1,2} +\d{2}:\d{2}:\d{2}"),
    ("<ip>", rf"{_V4}|{_v6()}"),
    ("<uuid>", r"[0-9A-Fa-f]{8}-(?:[0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}(?![0-9A-Fa-f])"),
    ("<hex>", r"[0-9A-Fa-f]{16,}+"),
    ("<dur>", r"\d++(?:\.\d++)?+(?:ns|us|ms|s|m|h)"),
    ("<num>", r"\d++(?:\.\d++)?+"),
)
#: An escape, a word in which no mask can begin, or other bytes that begin none; the masks; any other byte. A word is safe if no
#: eight hexadecimal letters stand together in it, and nothing follows that could go on a mask begun inside it.
TOKEN = r"\\u[\s\S]{0,4}|\\[\s\S]|(?![a-z]*?[a-f]{8})[a-z]++(?![0-9A-F:])|(?![A-Z]*?[A-F]{8})[A-Z]{2,}+(?![0-9a-z:])|[^0-9A-Za-f:\\]+|" + "|".join(f"(?:{p})" for _, p in MASKS) + r"|[\s\S]"
_FULL = {name: rf"\A(?:{p})\z" for name, p in MASKS}


def mask(ws: Column) -> Column:
    """The text with volatile fields replaced by placeholders, in one scan from left to right; escapes stay as they are."""

    def one(x: Column) -> Column:
        # A mask of more than one byte has a digit or a colon, or is long. Only a long number can be taken for another mask.
        out = F.when(F.length(x) == 1, F.when(x.between("0", "9"), "<num>").otherwise(x)).when(x.startswith("\\"), x)
        out = out.when(~x.rlike("[0-9:]") & (F.length(x) < 16), x).when((F.length(x) < 16) & x.rlike(_FULL["<num>"]), "<num>")
        for name in ("<dur>", "<hex>", "<uuid>", "<ts>", "<ip>", "<num>"):
            out = out.when(x.rlike(_FULL[name]), name)
        return out.otherwise(x)

    scanned = F.array_join(F.transform(F.regexp_extract_all(ws, F.lit(TOKEN), F.lit(0)), one), "")
    # Without a digit or a colon only a long run of hexadecimal letters can be masked.
    return F.when(ws.rlike("[0-9:]|[A-Fa-f]{16}"), scanned).otherwise(ws)


def resolve_style(requested: str, text: Column) -> Column:
    """ascii or unicode; auto is ascii where the span is."""
    return F.when(text.rlike(r"\A[\x00-\x7F]*+\z"), "ascii").otherwise("unicode") if requested == "auto" else F.lit(requested)


def _l1(text: str) -> str:
    return text.encode().decode("latin-1")


#: Fixed texts of the markers, by style: opening, sign of a count, separator, closing; by kind: before and after the count.
FRAMES = {"ascii": ("[... ", "x", " ", " ...]"), "unicode": ("\u27ea", "\u00d7", " \u00b7", "\u27eb")}
KINDS = {"exact_run": ("", " identical"), "ws_run": ("", " rows, ws-equal"), "block": ("block ", ""), "template_group": ("", " rows, template"), "templated_block": ("templated block ", "")}


def marker_core(style: Column, kind: Column, count: Column) -> Column:
    """Marker text up to the checksum, without it and the closing, on the Latin-1 view."""
    out = F.lit(None).cast("string")
    for s, (opening, sign, sep, _) in FRAMES.items():
        for k, (before, after) in KINDS.items():
            out = F.when((style == s) & (kind == k), F.concat(F.lit(_l1(opening + before + sign)), count.cast("string"), F.lit(_l1(after + sep)))).otherwise(out)
    return out


def marker_close(style: Column) -> Column:
    return F.when(style == "ascii", _l1(FRAMES["ascii"][3])).otherwise(_l1(FRAMES["unicode"][3]))


def marker_length(style: Column, kind: Column, count: Column) -> Column:
    return F.length(marker_core(style, kind, count)) + 4 + F.length(marker_close(style))


def carries_marker(unit: Column, style: Column) -> Column:
    """Whether a marker of the style stands in the unit. The search ends at the first byte that looks like an opening's but
    isn't one."""
    found = F.lit(False)
    for s, (opening, sign, sep, close) in FRAMES.items():
        first = _l1(opening)[0]
        quoted = lambda x: r"\Q" + _l1(x) + r"\E"
        core = "|".join(quoted(before + sign) + r"\d+" + (quoted(after) if after else "") for before, after in KINDS.values())
        skip = rf"[^\x{ord(first):02X}]*+{quoted(opening)}"
        pattern = rf"\A(?:{skip})+?(?:{core}){quoted(sep)}[0-9a-f]{{4}}{quoted(close)}"
        found = found | ((style == s) & F.contains(unit, F.lit(_l1(opening))) & unit.rlike(pattern))
    return found


def approx_tokens(n: Column) -> Column:
    """A quarter of the bytes, rounded down."""
    return F.floor(n / 4).cast("long")


def permille(before: Column, after: Column) -> Column:
    """Reduction in thousandths, cut off; 0 where nothing was there."""
    return F.when(before > 0, F.floor(F.greatest(before - after, F.lit(0)) * 1000 / before)).otherwise(F.lit(0)).cast("int")


def percent(thousandths: Column) -> Column:
    return F.concat(F.floor(thousandths / 10).cast("string"), F.lit("."), F.pmod(thousandths, F.lit(10)).cast("string"), F.lit("%"))


def valid_restore_id(text: Column) -> Column:
    return text.rlike(r"\A[0-9a-f]{32}:(0|[1-9][0-9]*)\z")
