"""SQL (DuckDB) for what the catalog's queries return, over the same tables; written from the rules, not from the engine."""

from __future__ import annotations

#: End of a record, long enough for every dump to exceed the line cap.
NOTE = ',"note":"' + "no remark " * 4 + '"}'
LOG = "strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || event_type || ' user=' || user_id || ' value=' || floor(value)::bigint || 'ms'"
CHAT = """'{"messages":[{"role":"user","content":""}]}'"""
#: White space, and what a mask leaves, where lines hold no escapes but these and no addresses of six groups.
WS = r"trim(regexp_replace(replace(replace(line, '\t', ' '), '\r', ' '), ' +', ' ', 'g'), ' ')"
MASK = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(ws, '\d{4}-\d\d-\d\d([Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:?\d\d)?)?', '<ts>', 'g'),
    '((25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(25[0-5]|2[0-4]\d|[01]?\d?\d)', '<ip>', 'g'), '[0-9A-Fa-f]{16,}', '<hex>', 'g'), '\d+(\.\d+)?(ns|us|ms|s|m|h)', '<dur>', 'g')"""
MASK = rf"regexp_replace({MASK}, '\d+(\.\d+)?', '<num>', 'g')"
SPAN = "k, sp"


def escaped(text: str) -> str:
    for a, b in (("chr(92)", "chr(92) || chr(92)"), ("'\"'", "chr(92) || '\"'"), ("chr(10)", "chr(92) || 'n'"), ("chr(9)", "chr(92) || 't'"), ("chr(13)", "chr(92) || 'r'")):
        text = f"replace({text}, {a}, {b})"
    return text


def lines(source: str) -> str:
    """u: units of source(k, sp, text), text with line breaks instead of their escapes but otherwise as it stands in the payload."""
    return f"""
src as ({source}),
raw as (select k, sp, regexp_full_match(replace(text, chr(10), ' '), '[\\x00-\\x7F]*') as ascii, generate_subscripts(string_split(text, chr(10)), 1) as l, unnest(string_split(text, chr(10))) as line from src),
pos as (select *, sum(strlen(line) + 2) over (partition by k, sp order by l) - strlen(line) - 2 as s from raw),
u as (select k, sp, ascii, line, s, s + strlen(line) as e, row_number() over (partition by k, sp order by l) - 1 as i, false as cl from pos where line <> '')"""


FORMS = f"f0 as (select *, {WS} as ws from u), f as (select *, {MASK} as m from f0)"


def runs(source: str, name: str, value: str, width: int) -> str:
    """name: source after its runs of equal values are claimed; name_c: their commits. width: of the ASCII marker but its count."""
    return f"""
{name}1 as (select *, case when not cl and not lag(cl) over w and {value} = lag({value}) over w then 0 else 1 end as c from {source} window w as (partition by {SPAN} order by i)),
{name}2 as (select *, sum(c) over (partition by {SPAN} order by i) as g from {name}1),
{name}_c as (select {SPAN}, g, min(i) as first, count(*) - 1 as n, arg_min(e - s, i) as anchor, max(e) - min(s) as removed, bool_and(ascii) as ascii, {width} - (not bool_and(ascii))::int + strlen((count(*) - 1)::varchar) as marker
    from {name}2 where not cl group by {SPAN}, g having count(*) >= 3 and arg_min(e - s, i) + {width} - (not bool_and(ascii))::int + strlen((count(*) - 1)::varchar) < max(e) - min(s)),
{name} as (select x.* exclude (c, g, cl), x.cl or y.n is not null as cl from {name}2 x left join {name}_c y using ({SPAN}, g))"""


def streaks(source: str, name: str, value: str, low: int, high: int) -> str:
    """name: where a streak of units that equal the p-th after them is `left` long still."""
    return f"""
{name}1 as (select a.k, a.sp, a.i, p.p from {source} a, range({low}, {high} + 1) p(p), {source} b where b.k = a.k and b.sp = a.sp and b.i = a.i + p.p and b.{value} = a.{value} and not a.cl and not b.cl),
{name}2 as (select *, i - row_number() over (partition by {SPAN}, p order by i) as g from {name}1),
{name} as (select *, row_number() over (partition by {SPAN}, p, g order by i desc) as left_ from {name}2)"""


def candidates(source: str, name: str, fine: str, coarse: str, low: int) -> str:
    """name: the longest block that repeats at each start and has no repeat inside."""
    return f"""{streaks(source, name + "f", fine, low, 64)},{streaks(source, name + "q", coarse, 1, 32)},
{name}b as (select {SPAN}, i as pos, p as len, left_ // p + 1 as copies, null::bigint as reach from {name}f where left_ >= p union all select {SPAN}, i, null::bigint, null::bigint, i + 2 * p from {name}q where left_ >= p),
{name}n as (select *, min(reach) over (partition by {SPAN} order by pos desc range between unbounded preceding and current row) as near from {name}b),
{name} as (select {SPAN}, pos, max(len) as len, arg_max(copies, len) as copies from {name}n where len is not null and (near is null or pos + len < near) group by {SPAN}, pos)"""


def blocks(source: str, name: str, fine: str, coarse: str, low: int, width: int) -> str:
    """name: source after its repeated blocks are claimed, in order of their starts; name_c: their commits."""
    return f"""{candidates(source, name + "a", fine, coarse, low)},
{name}g as (select c.*, a.ascii, y.e - a.s as anchor, z.e - a.s as removed, coalesce(not w.cl and w.{coarse} = a.{coarse}, false) as wall, {width} - (not a.ascii)::int + strlen((c.copies - 1)::varchar) as marker
    from {name}a c join {source} a on a.k = c.k and a.sp = c.sp and a.i = c.pos join {source} y on y.k = c.k and y.sp = c.sp and y.i = c.pos + c.len - 1
    join {source} z on z.k = c.k and z.sp = c.sp and z.i = c.pos + c.len * c.copies - 1 left join {source} w on w.k = c.k and w.sp = c.sp and w.i = c.pos - 1),
{name}p as (select *, pos + len * copies as stop from {name}g where anchor + marker < removed),
{name}x as (select a.k, a.sp, a.stop, min(b.pos) as pos from (select distinct k, sp, stop from {name}p) a join {name}p b on b.k = a.k and b.sp = a.sp and b.pos >= a.stop and (not b.wall or b.pos = a.stop) group by a.k, a.sp, a.stop),
{name}r as (select k, sp, min(pos) as pos from {name}p where not wall group by k, sp union all select x.k, x.sp, x.pos from {name}r r join {name}p p on p.k = r.k and p.sp = r.sp and p.pos = r.pos join {name}x x on x.k = p.k and x.sp = p.sp and x.stop = p.stop),
{name}_c as (select p.k, p.sp, p.pos as first, p.copies - 1 as n, p.anchor, p.removed, p.ascii, p.marker, p.stop from {name}r r join {name}p p on p.k = r.k and p.sp = r.sp and p.pos = r.pos),
{name} as (select x.* exclude (cl), x.cl or y.n is not null as cl from {source} x left join {name}_c y on y.k = x.k and y.sp = x.sp and x.i >= y.first and x.i < y.stop)"""


KINDS = {"exact_runs": "e3", "ws_runs": "e4", "block_repeats": "e5", "template_groups": "e6", "templated_blocks": "e7"}


def stages(source: str) -> str:
    """All commits of spans: commits(k, kind, saved)."""
    parts = [lines(source), FORMS, runs("f", "e3", "line", 26), runs("e3", "e4", "ws", 31), blocks("e4", "e5", "ws", "m", 2, 22), runs("e5", "e6", "m", 31), blocks("e6", "e7", "m", "m", 1, 32)]
    each = " union all ".join(f"select k, '{kind}' as kind, removed - anchor - marker as saved from {name}_c" for kind, name in KINDS.items())
    return f"with recursive {','.join(parts).strip()}, commits as ({each})"


def compressed(payloads: str, source: str, key: str = "payload_id", columns: str | None = None) -> str:
    """The statistics of payloads(k, n): n bytes each; source(k, sp, text) their eligible spans."""
    counts = ", ".join(f"coalesce(count(*) filter (kind = '{kind}'), 0) as {kind}" for kind in KINDS)
    own = columns or f"""k as {key}, n as bytes_in, n - saved as bytes_out, n // 4 as approx_tokens_in, (n - saved) // 4 as approx_tokens_out, groups_collapsed, {', '.join(KINDS)},
        0::bigint as record_splits, false as degraded, null::varchar as noop_reason"""
    return f"""{stages(source)}, per as (select k, coalesce(sum(saved), 0)::bigint as saved, count(*) as groups_collapsed, {counts} from commits group by k),
        total as (select p.k, p.n::bigint as n, coalesce(saved, 0) as saved, coalesce(groups_collapsed, 0) as groups_collapsed, {', '.join(f'coalesce({k}, 0) as {k}' for k in KINDS)} from ({payloads}) p left join per using (k))
        select {own} from total"""


LOGS = f"select user_id as k, 0 as sp, string_agg({LOG}, chr(10) order by ts, event_id) as text from events group by user_id"
LOG_PAYLOADS = f"select user_id as k, sum(strlen({LOG}) + 2) - 2 + strlen({CHAT}) as n from events group by user_id"
#: Line breaks stay, as lines() cuts at them; the rest is escaped.
TEXTS = f"select doc_id as k, 0 as sp, replace({escaped('text')}, chr(92) || 'n', chr(10)) as text from documents where text <> ''"
TEXT_PAYLOADS = f"""select doc_id as k, case when text is null then strlen('{{"messages":[{{"role":"user"}}]}}') else strlen({escaped('text')}) + strlen({CHAT}) end as n from documents"""
_SAID = "case when role = 'user' then text || chr(10) || text || chr(10) || text else text end"
TURNS = f"select conv_id as k, turn as sp, replace({escaped(_SAID)}, chr(92) || 'n', chr(10)) as text from conversations where role = 'user' and text is not null"
TURN_PAYLOADS = f"""select conv_id as k, sum(strlen({escaped(_SAID)}) + strlen(role) + strlen('{{"role":"","content":""}},')) - 1 + strlen('{{"messages":[]}}') as n from conversations group by conv_id"""
PAGES = "select page_id as k, 0 as sp, replace(html, '<', chr(10) || '<') as text from pages where html <> ''"
PAGE_PAYLOADS = "select page_id as k, strlen(replace(replace(html, chr(10), '  '), '<', '  <')) as n from pages"
_HEADERS = {"bytes_in": "n", "bytes_out": "n - saved", "approx_tokens_in": "n // 4", "approx_tokens_out": "(n - saved) // 4", "groups_collapsed": "groups_collapsed"} | {k: k for k in KINDS} | {"record_splits": "0", "degraded": "'false'", "algo_version": "'0.1.0'"}
_HEADER_JSON = " || ',' || ".join(f"""'"x-stats-{k.replace("_", "-")}":"' || ({v}) || '"'""" for k, v in _HEADERS.items())
_LINES = lines("select doc_id as k, 0 as sp, text from documents where text is not null")
#: conv_id % 5: chat with tools, responses, messages, text, and a chat cut off at its end.
_MIXED = "select conv_id, (conv_id % 5)::int as form, count(*) filter (role = 'user' and text <> '') as n_user, count(*) filter (role = 'assistant' and text <> '') as n_tool from conversations group by conv_id"
_SCHEMA = "['chat', 'responses', 'messages', 'text', 'chat'][form + 1]"

ORACLES = {
    "split_lines": f"with {_LINES.strip()} select k as doc_id, count(*) as n_units, sum(strlen(line))::bigint as unit_bytes, max(e)::bigint as last_end from u group by k",
    "exact_runs": f"""with {_LINES.strip()}, {runs("u", "x", "line", 26).strip()}
        select k as doc_id, first as first_unit, n as copies_omitted, anchor as anchor_bytes, removed::bigint as removed_bytes,
        case when ascii then '[... x' || n || ' identical ' else chr(10218) || chr(215) || n || ' identical ' || chr(183) end as marker_core from x_c""",
    "ws_normalize": f"with {_LINES.strip()} select k as doc_id, i as unit_no, strlen(trim(regexp_replace(line, ' +', ' ', 'g'), ' '))::bigint as ws_bytes from u",
    "ws_runs": f"""with {_LINES.strip()}, f as (select *, trim(regexp_replace(line, ' +', ' ', 'g'), ' ') as ws from u), {runs("f", "x", "line", 26).strip()}, {runs("x", "y", "ws", 31).strip()}
        select k as doc_id, count(*) filter (t = 3) as exact_runs, count(*) filter (t = 4) as ws_runs from (select k, 3 as t from x_c union all select k, 4 from y_c) group by k""",
    "mask_forms": f"select event_id, regexp_replace(regexp_replace(regexp_replace({LOG}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}}', '<ts>'), 'user=[0-9]+', 'user=<num>'), 'value=[0-9]+ms', 'value=<dur>') as masked from events",
    "template_groups": f"""with u as (select user_id as k, 0 as sp, event_type as m, row_number() over w - 1 as i, sum(strlen({LOG}) + 2) over w - strlen({LOG}) - 2 as s, sum(strlen({LOG}) + 2) over w - 2 as e, true as ascii, false as cl from events window w as (partition by user_id order by ts, event_id)),
        {runs("u", "x", "m", 31).strip()} select k as user_id, first as first_unit, n as copies_omitted, removed::bigint as removed_bytes from x_c""",
    "block_candidates": f"""with u as (select user_id as k, 0 as sp, event_type as m, row_number() over (partition by user_id order by ts, event_id) - 1 as i, false as cl from events),
        {candidates("u", "c", "m", "m", 2).strip()} select k as user_id, pos as first_unit, len as block_units, copies from c""",
    "record_split": f"""with r as (select l_returnflag, l_orderkey // 1000 as part, '{{"o":' || l_orderkey || ',"l":' || l_linenumber || '{NOTE}' as r from lineitem),
        d as (select l_returnflag, part, count(*) as n, sum(strlen(r))::bigint as b, sum(strlen(r) + 1) + 1 > 65536 as over from r group by all)
        select l_returnflag, part::bigint as part, case when over then n else 1 end as n_records, case when over then n else 1 end as n_eligible, case when over then b + 2 else b + n + 1 end as record_bytes from d""",
    "sniff_schema": f"""select conv_id, {_SCHEMA} as schema, case when form = 4 then 'malformed' end as noop_reason, case form when 3 then 1 when 4 then 0 else n_user end::bigint as n_spans from ({_MIXED})""",
    "detect_preview": f"""select conv_id, {_SCHEMA} as schema, a as n_user, b as n_tool, least(64, a + b) as n_shown, a + b > 64 as spans_truncated
        from (select conv_id, form, case form when 3 then 1 when 4 then 0 else n_user end::bigint as a, case when form < 3 then n_tool else 0 end::bigint as b from ({_MIXED}))""",
    "pinned_mismatch": f"select conv_id, form <> 0 and form <> 2 as content_type_mismatch from ({_MIXED})",
    "strict_check": "select conv_id, conv_id % 5 < 3 as lenient_ok, conv_id % 5 = 0 as strict_ok from conversations group by conv_id",
    "span_inventory": f"select conv_id, 'user' as class, count(*) as n_spans, sum(strlen({escaped('text')}))::bigint as span_bytes, count(*) filter (strlen(text) = length(text)) as ascii_spans from conversations where role = 'user' and text <> '' group by conv_id",
    "compress_logs": compressed(LOG_PAYLOADS, LOGS),
    "compress_documents": compressed(TEXT_PAYLOADS, TEXTS),
    "compress_conversations": compressed(TURN_PAYLOADS, TURNS),
    "compress_pages": compressed(PAGE_PAYLOADS, PAGES, columns="k as payload_id, n as bytes_in, n - saved as bytes_out, groups_collapsed, false as degraded"),
    "bytes_in_balance": compressed(LOG_PAYLOADS, LOGS, columns="k as user_id, n as bytes_in, n - saved as by_commits, n - saved as bytes_out"),
    "restore_roundtrip": compressed(TEXT_PAYLOADS, TEXTS, columns="k as doc_id, groups_collapsed as n_commits, groups_collapsed as n_restored") + " where groups_collapsed > 0",
    "stats_headers": compressed(TURN_PAYLOADS, TURNS, columns=f"k as payload_id, '{{' || {_HEADER_JSON} || '}}' as headers"),
    "units": f"with {lines(TURNS).strip()} select k as conv_id, count(*) as n_units, count(*) as n_eligible from u group by k",
    "approx_tokens": "select doc_id, (strlen(text) // 4)::bigint as stats_tokens, ((strlen(text) + 3) // 4)::bigint as eval_tokens from documents",
    "reduction_summary": f"""with {_LINES.strip()}, {runs("u", "x", "line", 26).strip()},
        d as (select doc_id, lang, strlen(replace(text, chr(10), '  ')) as b from documents where text is not null),
        v as (select d.doc_id, coalesce(sum(removed - anchor), 0) as saved from d left join x_c on x_c.k = d.doc_id group by d.doc_id),
        t as (select lang, (b + 3) // 4 as ti, (b - saved + 3)::bigint // 4 as tn from d join v using (doc_id)),
        p as (select lang, case when ti > 0 then greatest(ti - tn, 0) * 1000 // ti else 0 end as q from t)
        select lang, count(*) as cases, floor(median(q))::int as median_permille, min(q)::int as min_permille, max(q)::int as max_permille, floor(median(q)) >= 400 as meets_target,
               (floor(median(q))::int // 10) || '.' || (floor(median(q))::int % 10) || '%' as median_percent from p group by lang""",
    "span_shapes": """with d as (select lang, text, list_max(list_transform(string_split(text, chr(10)), lambda x: strlen(x))) > 65536 as over from documents where text <> '')
        select 'user' as class, lang, count(*) filter (not over and contains(text, chr(10))) as multi_line, count(*) filter (not over and not contains(text, chr(10))) as single_line, count(*) filter (over) as over_cap from d group by lang""",
    "request_metrics": """select '/v1/' || event_type as route, (case when user_id % 5 = 0 then 404 else 200 end)::int as status, count(*) as requests,
        'http_requests_total{route="/v1/' || event_type || '",status="' || (case when user_id % 5 = 0 then 404 else 200 end) || '"} ' || count(*) as line from events group by event_type, case when user_id % 5 = 0 then 404 else 200 end""",
    "envelopes": """select doc_id, case when doc_id % 4 < 3 then 'text' end as content_type, doc_id % 4 < 2 and text is not null as valid, case when doc_id % 4 < 3 then strlen(text)::bigint end as body_bytes from documents""",
}
