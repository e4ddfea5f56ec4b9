"""Spans and their units: the ordered relation that the detectors work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plisse.functions import text as T
from plisse.plans.options import MAX_LINE_BYTES, MAX_RECORD_BYTES

SPAN = ("payload_id", "span_no")


def explode_spans(located: DataFrame, style: str = "auto", keep_all: bool = False) -> DataFrame:
    """located(payload_id, body, spans, ...) → the other columns, span_no, base, class, text, style, one row a span.

    base is the span's first byte in the payload; text its Latin-1 view. The body is not carried on. With keep_all a payload
    without spans has one row too, its span empty and its span_no null.
    """
    own = [c for c in located.columns if c not in ("body", "spans")]
    s = located.select(*own, "body", F.posexplode_outer("spans").alias("span_no", "s"))
    s = s if keep_all else s.where("span_no is not null")
    text = T.latin1(F.coalesce(F.substring("body", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")), F.lit(b"")))
    s = s.select(*own, "span_no", F.coalesce("s.start", F.lit(0)).alias("base"), F.col("s.class").alias("class"), text.alias("text"))
    return s.withColumn("style", T.resolve_style(style, F.col("text")))


def split_pieces(spans: DataFrame) -> DataFrame:
    """The lines and records of spans, in order: a span's own columns but text, and over_cap, head, gap, eligible, raw.

    Lines end at escaped line feeds; a line above the cap is cut into records between '}' and '{', the first of which is its
    head. gap: bytes between a piece and the next. An empty piece is no unit; a piece that carries a marker, or a record above
    its cap, is not eligible. Spans are dealt once, before they are split, and all that follows within a span uses that. No
    text stands beside a generator: a piece keeps the stand-in of its gap as its last character, and only pieces go on, so
    the work is linear in a span. (The generators are outer ones, though no array is empty, as for others Spark would split
    the text once more to test that.)
    """
    own = [c for c in spans.columns if c != "text"]
    b = spans.repartition(*SPAN).select(*own, F.split(T.with_breaks(F.col("text")), f"(?<=[{T.BREAK2}{T.BREAK6}])", -1).alias("_lines"))
    b = b.select(*own, F.explode_outer("_lines").alias("_line"))
    over = F.length("_line") - F.when(_gap("_line") > 0, 1).otherwise(0) > MAX_LINE_BYTES
    records = F.split(F.regexp_replace("_line", r"(?<=\}),(?=\{)", T.BREAK1), f"(?<={T.BREAK1})", -1)
    b = b.select(*own, over.alias("over_cap"), F.when(over, records).otherwise(F.array("_line")).alias("_p"))
    b = b.select(*own, "over_cap", F.posexplode_outer("_p").alias("_r", "_piece")).withColumn("gap", _gap("_piece"))
    raw = F.when(F.col("gap") > 0, F.expr("left(_piece, length(_piece) - 1)")).otherwise(F.col("_piece"))
    b = b.select(*own, "over_cap", (F.col("over_cap") & (F.col("_r") == 0)).alias("head"), "gap", raw.alias("raw"))
    fits = ~F.col("over_cap") | (F.length("raw") <= MAX_RECORD_BYTES)
    return b.select(*own, "over_cap", "head", "gap", (fits & ~T.carries_marker(F.col("raw"), F.col("style"))).alias("eligible"), "raw")


def split_units(spans: DataFrame) -> DataFrame:
    """(payload_id, span_no, base, style, unit_no, start, end, eligible, over_cap, first_record, raw) of the units of spans.

    Offsets are bytes within the span.
    """
    b = split_pieces(spans.select(*SPAN, "base", "style", "text")).withColumn("_i", F.monotonically_increasing_id())
    order = Window.partitionBy(*SPAN).orderBy("_i")
    end = F.sum(F.length("raw") + F.col("gap")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("gap")
    b = b.withColumn("end", end.cast("int")).withColumn("start", F.col("end") - F.length("raw")).where("raw != ''")
    return b.select(*SPAN, "base", "style", (F.row_number().over(order) - 1).alias("unit_no"), "start", "end", "eligible", "over_cap", F.col("head").alias("first_record"), "raw")


def _gap(piece: str):
    """Bytes of the gap for which a piece's last character stands; none if it stands for itself."""
    last = F.right(F.col(piece), F.lit(1))
    return F.when(last == T.BREAK2, 2).when(last == T.BREAK6, 6).when(last == T.BREAK1, 1).otherwise(0)


def joiners(units: DataFrame, spans: DataFrame) -> DataFrame:
    """units with joiner_end: where the bytes between a unit and the next one, or the span's end, stop."""
    size = spans.select(*SPAN, F.length("text").alias("_size"))
    order = Window.partitionBy(*SPAN).orderBy("unit_no")
    return units.join(size, list(SPAN)).withColumn("joiner_end", F.coalesce(F.lead("start").over(order), F.col("_size"))).drop("_size")
