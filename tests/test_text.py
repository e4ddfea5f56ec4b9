from pyspark.sql import functions as F

from plisse.functions import hashes
from plisse.functions import text as T

MASKED = [
    ("at 2025-01-02T03:04:05Z from 192.168.7.9 in 31ms", "at <ts> from <ip> in <dur>"),
    ("2025-01-02 03:04:05.250+0130 x", "<ts> x"),
    ("2025-01-02T03:04:05+1 x", "<ts>T<num>:<num>:<num>+<num> x"),
    ("2025-01-02", "<ts>"),
    ("Feb  3 04:05:06 host", "<ts> host"),
    ("300.1.2.3", "<num>.<num>"),
    ("9.8.7.6.5", "<ip>.<num>"),
    ("fe80::1 and ::ffff:1.2.3.4", "<ip> and <ip>"),
    ("1:2:3:4:5:6:7:8", "<ip>"),
    ("10:20:30", "<num>:<num>:<num>"),
    ("::", "::"),
    ("a8098c1a-f86e-11da-bd1a-00112444be1e", "<uuid>"),
    ("cafebabecafebabe", "<hex>"),
    ("cafebabecafebab", "cafebabecafebab"),
    ("1h20m 1.25s 7us 7u", "<dur><dur> <dur> <dur> <num>u"),
    ("v2.0 -3", "v<num> -<num>"),
    (r"4 \t4", r"<num> \t<num>"),
    ("no field at all", "no field at all"),
    ("", ""),
    ("x\\", "x\\"),
]
SPACED = [
    ("  a  b ", "a b"),
    (r"\ta\r\nb\t", "a b"),
    (r"a\\tb", r"a\\tb"),
    ("a" + chr(92) + "u0020  b", "a" + chr(92) + "u0020 b"),
    (r"\u000a \u000a", r"\u000a \u000a"),
    ("", ""),
    (r" \t ", ""),
    ("x\\", "x\\"),
]


def check(spark, pairs, function):
    df = spark.createDataFrame(pairs, "given string, want string")
    bad = df.withColumn("got", function(F.col("given"))).where("got is null or got != want").collect()
    assert not bad


def test_masks(spark):
    check(spark, MASKED, T.mask)


def test_mask_of_long_text(spark):
    n = 50_000
    got = spark.range(1).select(T.mask(F.repeat(F.lit("a1 "), n)).alias("m")).first().m
    assert got == "a<num> " * n


def test_whitespace(spark):
    check(spark, SPACED, T.normalize_ws)


def test_markers(spark):
    widths = {"exact_run": (27, 26), "ws_run": (32, 31), "block": (23, 22), "template_group": (32, 31), "templated_block": (33, 32)}
    rows = [(s, k, w[i]) for k, w in widths.items() for i, s in enumerate(("ascii", "unicode"))]
    df = spark.createDataFrame(rows, "style string, kind string, want int")
    got = df.withColumn("got", T.marker_length(F.col("style"), F.col("kind"), F.lit(7)))
    assert got.where("got != want").isEmpty()
    core = got.where("style = 'unicode' and kind = 'block'").select(F.decode(T.to_bytes(T.marker_core(F.col("style"), F.col("kind"), F.lit(12))), "UTF-8")).first()[0]
    assert core == "⟪block ×12 ·"


def test_marker_guard(spark):
    l1 = lambda s: s.encode().decode("latin-1")
    rows = [
        ("ascii", "row [... x4 identical 00ff ...] tail", True),
        ("ascii", "[... block x12 abcd ...]", True),
        ("ascii", "[INFO] then [... x4 identical 00ff ...]", False),
        ("ascii", "[... nothing [... x4 rows, template 00ff ...]", True),
        ("ascii", "[... x4 identical 00fg ...]", False),
        ("ascii", l1("⟪×4 identical ·00ff⟫"), False),
        ("unicode", l1("⟪×4 identical ·00ff⟫"), True),
        ("unicode", l1("– ⟪×4 identical ·00ff⟫"), False),
        ("unicode", "[... x4 identical 00ff ...]", False),
    ]
    df = spark.createDataFrame(rows, "style string, unit string, want boolean")
    assert df.where(T.carries_marker(F.col("unit"), F.col("style")) != F.col("want")).isEmpty()


def test_numbers(spark):
    r = spark.range(1).select(
        T.approx_tokens(F.lit(7)), T.permille(F.lit(3), F.lit(2)), T.permille(F.lit(0), F.lit(2)), T.permille(F.lit(2), F.lit(3)), T.percent(F.lit(905)),
        *[T.valid_restore_id(F.lit("a" * 32 + t)) for t in (":0", ":10", ":01", "")],
    ).first()
    assert tuple(r) == (1, 333, 0, 0, "90.5%", True, True, False, False)


def test_hashes(spark):
    df = spark.createDataFrame([(bytearray(b"abc"),), (None,)], "b binary")
    got = df.select(hashes.marker_checksums(F.array("b"))[0].alias("c"), hashes.restore_id(F.col("b")).alias("i")).collect()
    assert got[0].i == "06b05ab6733a618578af5f94892f3950:3" and len(got[0].c) == 4 and got[1].c is None and got[1].i is None
