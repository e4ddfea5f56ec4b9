"""Evaluation: token reduction by stratum, span shapes, and answer parity of tasks."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plisse.functions.text import percent, permille
from plisse.plans.options import MAX_LINE_BYTES

#: Targets in thousandths. Fixed values.
MEDIAN_TARGET = 400
PARITY_TARGETS = {"summarisation": 900, "anomaly": 900, "extraction": 750, "counting": 750}
EXACT_CLASSES = ("extraction", "counting")


def eval_tokens(n: Column) -> Column:
    """A quarter of the bytes, rounded up."""
    return F.ceil(n / 4).cast("long")


def bpe_tokens(body: Column, encode: Callable[[str], Iterable[int]] | None) -> Column:
    """Tokens by an encoder; null where the bytes aren't UTF-8 or no encoder is at hand (then nothing was measured)."""
    if encode is None:
        return F.lit(None).cast("long")

    @F.pandas_udf("long")
    def count(bodies: pd.Series) -> pd.Series:
        def one(raw):
            try:
                return len(list(encode(bytes(raw).decode())))
            except (UnicodeDecodeError, TypeError):
                return None

        return bodies.map(one).astype("Int64")

    return count(body)


class PublicEncoder:
    """encode() of a vocabulary of the tokenizers library, read where it is used; each worker keeps one of a file."""

    _open: dict = {}

    def __init__(self, path: str):
        self.path = path

    def __call__(self, text: str) -> list[int]:
        if self.path not in self._open:
            from tokenizers import Tokenizer

            self._open[self.path] = Tokenizer.from_file(self.path)
        return self._open[self.path].encode(text, add_special_tokens=False).ids


def public_encoder(name: str = "word_bpe_49k.json") -> PublicEncoder | None:
    """An encoder of the public vocabularies, None where they aren't installed."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return None
    return PublicEncoder(public_tokenizers.path(name))


def measurements(compressed: DataFrame, baseline: str = "approx", encode: Callable[[str], Iterable[int]] | None = None) -> DataFrame:
    """compressed(payload_id, stratum, bytes_in, bytes_out, body, out, ...) with tokens before and after and the reduction: a
    quarter of the bytes, or, with an encoder, its tokens; payloads that it can't read are left out."""
    count = {"tokens_in": eval_tokens(F.col("bytes_in")), "tokens_out": eval_tokens(F.col("bytes_out"))}
    if encode is not None:
        count = {"tokens_in": bpe_tokens(F.col("body"), encode), "tokens_out": bpe_tokens(F.col("out"), encode)}
    m = compressed.withColumns(count).where("tokens_in is not null and tokens_out is not null")
    return m.withColumns({"baseline": F.lit(baseline), "reduction_permille": permille(F.col("tokens_in"), F.col("tokens_out"))})


def median(values: Column) -> Column:
    """Integer median: of an even number the mean of the middle two, cut off."""
    return F.floor(F.percentile(values, 0.5)).cast("int")


def summaries(measured: DataFrame, *keys: str) -> DataFrame:
    """Cases, median, least and greatest reduction by baseline and stratum (or other keys), and whether the target is met."""
    x = F.col("reduction_permille")
    s = measured.groupBy(*(keys or ("baseline", "stratum"))).agg(F.count("*").alias("cases"), median(x).alias("median_permille"), F.min(x).alias("min_permille"), F.max(x).alias("max_permille"))
    return s.withColumns({"meets_target": F.col("median_permille") >= MEDIAN_TARGET, "median_percent": percent(F.col("median_permille"))})


def span_shapes(spans: DataFrame, *keys: str) -> DataFrame:
    """Spans by class (and other keys) counted as over_cap (a line above the cap), multi_line or single_line."""
    lines = F.split("text", r"(?<!\\)(?:\\\\)*\\n|\\u000[Aa]", -1)
    longest = F.array_max(F.transform(lines, F.length))
    shape = F.when(longest > MAX_LINE_BYTES, "over_cap").when(F.size(lines) > 1, "multi_line").otherwise("single_line")
    return spans.withColumn("shape", shape).groupBy("class", *keys).pivot("shape", ["multi_line", "single_line", "over_cap"]).agg(F.count("class")).na.fill(0)


def nearest_rank(samples: DataFrame, value: str, thousandths: int, *keys: str) -> DataFrame:
    """The nearest-rank percentile of value by keys."""
    ordered = F.array_sort(F.collect_list(value))  # benchmark samples, a few by nature
    n = F.size(ordered)
    return samples.groupBy(*keys).agg(F.get(ordered, F.greatest(F.ceil(n * thousandths / 1000) - 1, F.lit(0)).cast("int")).alias(f"p{thousandths}"))


def normalize_answer(answer: Column) -> Column:
    return F.lower(F.regexp_replace(answer, r"[^\p{L}\p{N}]", ""))


def covers(facts: Column, answer: Column) -> Column:
    """Every fact is in the answer; a fact of digits as a whole number."""
    numbers = F.regexp_extract_all(answer, F.lit(r"(\d+)"), F.lit(1))
    return F.forall(facts, lambda f: F.when(f.rlike(r"\A\d+\z"), F.array_contains(numbers, f)).otherwise(F.contains(F.lower(answer), F.lower(f))))


def parity(cases: DataFrame) -> DataFrame:
    """cases(task_class, facts, baseline, compressed) with parity: both answers cover the facts and, where the class asks for
    it, agree; null where an answer is missing."""
    same = normalize_answer(F.col("baseline")) == normalize_answer(F.col("compressed"))
    both = covers(F.col("facts"), F.col("baseline")) & covers(F.col("facts"), F.col("compressed"))
    exact = F.col("task_class").isin(*EXACT_CLASSES)
    answered = F.col("baseline").isNotNull() & F.col("compressed").isNotNull()
    return cases.withColumn("parity", F.when(answered, both & (~exact | same)))


def class_scores(judged: DataFrame) -> DataFrame:
    """Per class: cases (unanswered ones too), parity in thousandths of them, and whether its target is met."""
    target = F.create_map(*[F.lit(x) for pair in PARITY_TARGETS.items() for x in pair])
    s = judged.groupBy("task_class").agg(F.count("*").alias("scored"), F.count_if("parity").alias("agreed"))
    s = s.withColumn("parity_permille", F.floor(F.col("agreed") * 1000 / F.col("scored")).cast("int"))
    return s.withColumn("meets_target", F.coalesce(F.col("parity_permille") >= F.try_element_at(target, F.col("task_class")), F.lit(False)))


def ask(cases: DataFrame, model: Callable[[pd.Series], pd.Series], question: str = "question", payload: str = "payload") -> Column:
    """A model's answers, in batches: model maps a series of prompts to one of answers."""

    @F.pandas_udf("string")
    def run(prompts: pd.Series) -> pd.Series:
        return model(prompts)

    return run(F.concat(cases[question], F.lit("\n\n"), cases[payload]))


def unescape(text: Column) -> Column:
    """The string that escaped JSON text stands for; null where it doesn't parse."""
    return F.get(F.from_json(F.concat(F.lit('["'), text, F.lit('"]')), "array<string>"), 0)


def field(line: Column, name: str) -> Column:
    """The value of name=value in a line, up to white space, a quote or a closing bracket; null where there is none."""
    found = F.regexp_extract(line, rf"(?:^|[\s\[({{,]){name}=\"?([^\s\",\])}}]+)", 1)
    return F.when(found != "", found)


def paren(line: Column) -> Column:
    """What the first pair of round brackets in a line holds; null where there is none."""
    found = F.regexp_extract(line, r"\(([^()]+)\)", 1)
    return F.when(found != "", found)


def log_facts(lines: Column) -> Column:
    """From log lines: their number and that of lines with an error, the first status field and the first place in brackets,
    the distinct fields of path and user, and the longest duration in milliseconds."""
    errors = F.size(F.filter(lines, lambda x: x.rlike(r"\b(ERROR|error)\b")))
    first = lambda pick: F.get(F.filter(F.transform(lines, pick), lambda x: x.isNotNull()), 0)
    each = lambda name: F.array_sort(F.array_distinct(F.filter(F.transform(lines, lambda x: field(x, name)), lambda x: x.isNotNull())))
    slowest = F.array_max(F.transform(lines, lambda x: F.regexp_extract(x, r"(\d+)ms\b", 1).try_cast("long")))
    return F.struct(F.size(lines).alias("lines"), errors.alias("errors"), first(lambda x: field(x, "status")).alias("status"), first(paren).alias("place"), each("path").alias("paths"), each("user").alias("users"), slowest.alias("slowest_ms"))


def throughput(n_bytes: int, seconds: float) -> float:
    return math.inf if seconds <= 0 else n_bytes / seconds / 1e6


def markdown(summary: DataFrame, title: str) -> str:
    """A report of a summary, which has one row for each stratum and baseline."""
    rows = summary.collect()
    names = summary.columns
    return "\n".join([f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "-|" * len(names), *("| " + " | ".join(str(r[n]) for n in names) + " |" for r in rows), ""])


def json_report(summary: DataFrame, measured: DataFrame, options: str) -> DataFrame:
    """One row, report: JSON of the target, the options, the summary's rows and one entry a payload, by name and baseline.

    measured has one row a payload of an evaluation's corpus, some hundreds; its statistics go in, its bodies don't.
    """
    rows = lambda df, names: F.array_sort(F.collect_list(F.struct(*names)))
    detectors = F.struct("exact_runs", "ws_runs", "block_repeats", "template_groups", "templated_blocks", "record_splits").alias("detectors")
    tokens = F.struct("tokens_in", "tokens_out", "reduction_permille").alias("tokens")
    named = "name" if "name" in measured.columns else F.col("payload_id").cast("string").alias("name")
    s = summary.agg(rows(summary, summary.columns).alias("summaries"))
    m = measured.agg(rows(measured, [named, "baseline", "stratum", "schema", "bytes_in", "bytes_out", detectors, "degraded", tokens]).alias("payloads"))
    whole = F.struct(F.lit(MEDIAN_TARGET).alias("target_permille"), F.from_json(F.lit(options), "map<string,string>").alias("options"), "summaries", "payloads")
    return s.join(m).select(F.to_json(whole, {"ignoreNullFields": "false"}).alias("report"))  # one row each


def write_report(report: DataFrame, path: str) -> None:
    """A report's rows as text files under path, in place of what was there."""
    report.write.mode("overwrite").text(path)
