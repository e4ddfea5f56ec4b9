"""URL filter: allow and block rules, and for the rest an empirical-Bayes reputation of the host."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: (verdict, rule): host and path prefix. Fixed values of the query's contract.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
MAX_RULES = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Quantile of the normal bound on a posterior, and the share of bad pages from which a host is blocked.
Z, CUT = 1.6449, 0.5


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (ASCII lower case) and path of a URL; both empty where it is null or has no '://'."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, URL, 1), UPPER, LOWER), F.regexp_extract(url, URL, 2)


def match_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (null if none) and its verdict. Rules are plan literals, so their number is bounded."""
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MAX_RULES} are compiled into the plan")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _strength(children: DataFrame, keys: list[str]) -> DataFrame:
    """Pseudo-counts of the beta prior that a level gives its children, by the moments of their outcomes (ANOVA estimator)."""
    s = children.groupBy(*keys).agg(F.sum("n").alias("w"), F.sum("bad").alias("b"), F.count("*").alias("j"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("q"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    p = F.col("b") / F.col("w")
    between = F.col("q") - p * p * F.col("w") - p * (1 - p) * (F.col("j") - 1)
    scale = p * (1 - p) * (F.col("w") - F.col("nn") / F.col("w") - (F.col("j") - 1))
    phi = F.when(scale > 1e-9, F.least(F.greatest(between / scale, F.lit(0.001)), F.lit(0.5))).otherwise(F.lit(0.5))
    return s.select(*keys, (1 / phi - 1).alias("k"))


def counts(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outcomes(host, bad 0/1) counted by host, by registered domain (last two labels) and by suffix (last label).

    Every step is a partial aggregate, so a host with a third of all pages is one row after the map side.
    """
    host = outcomes.where("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    host = host.withColumns({"domain": F.substring_index("host", ".", -2), "suffix": F.substring_index("host", ".", -1)})
    domain = host.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffix = domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    return host, domain, suffix


def levels(outcomes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Shrunken rates of all, of suffixes and of domains, with the strength of the prior each gives below it; counts of hosts.

    Rates come down from all to suffix to domain: each level's rate is the mean of the beta prior of the next, with a
    strength estimated from the spread of that level's children.
    """
    host, domain, suffix = counts(outcomes)
    whole = suffix.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).select(((F.col("bad") + 1) / (F.col("n") + 2)).alias("m0"))
    k_all = _strength(suffix.withColumn("one", F.lit(1)), ["one"]).agg(F.coalesce(F.max("k"), F.lit(1.0)).alias("k0"))
    whole = whole.crossJoin(k_all)  # one row by one row
    k_suffix = _strength(domain, ["suffix"])
    suffix = suffix.join(k_suffix, "suffix").crossJoin(F.broadcast(whole)).select("suffix", ((F.col("bad") + F.col("k0") * F.col("m0")) / (F.col("n") + F.col("k0"))).alias("ms"), F.col("k").alias("ks"))
    k_domain = _strength(host, ["domain"])
    domain = domain.join(k_domain, "domain").join(suffix, "suffix").select("domain", ((F.col("bad") + F.col("ks") * F.col("ms")) / (F.col("n") + F.col("ks"))).alias("md"), F.col("k").alias("kd"))
    return whole, suffix, domain, host.select("host", "n", "bad")


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, z: float = Z, cut: float = CUT) -> DataFrame:
    """Judge every page's url: rows (page_id, host, path, rule, verdict).

    The rules' verdicts are the labelled outcomes from which reputations are learnt. A page without a rule is blocked if the
    lower bound (mean - z standard deviations) of its host's posterior share of bad pages is above cut. A host without
    outcomes has its domain's prior as posterior, a domain without outcomes its suffix's, a suffix without any that of all.
    Null urls and urls without '://' have an empty host and path and no rule; repeated page ids are judged row by row;
    an empty table gives an empty result; other columns of pages are left out. No Python runs on the executors.
    """
    host, path = split_url(F.col("url"))
    p = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, said = match_rule(F.col("host"), F.col("path"), rules)
    p = p.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"))
    seen = p.where("said is not null").select("host", (F.col("said") == "block").cast("long").alias("bad"))
    whole, suffix, domain, hosts = levels(seen)
    # One row for each host that a page without a rule has; the reputations are joined to those, not to the pages.
    asked = p.where("rule is null").groupBy("host").agg(F.count("*").alias("pages"))
    asked = asked.withColumns({"domain": F.substring_index("host", ".", -2), "suffix": F.substring_index("host", ".", -1)})
    r = asked.join(hosts, "host", "left").join(domain, "domain", "left").join(suffix, "suffix", "left").crossJoin(F.broadcast(whole))
    mean = F.coalesce("md", "ms", "m0")
    k = F.coalesce("kd", "ks", "k0")
    n, bad = F.coalesce("n", F.lit(0)), F.coalesce("bad", F.lit(0))
    r = r.select("host", (bad + k * mean).alias("alpha"), (n - bad + k * (1 - mean)).alias("beta"))
    total = F.col("alpha") + F.col("beta")
    bound = F.col("alpha") / total - z * F.sqrt(F.col("alpha") * F.col("beta") / (total * total * (total + 1)))
    r = r.select(F.col("host").alias("r_host"), bound.alias("bad_bound"))
    out = p.join(r, F.when(F.col("rule").isNull(), F.col("host")) == F.col("r_host"), "left")
    verdict = F.coalesce("said", F.when(F.col("bad_bound") > cut, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def _case(part: int) -> str:
    whens = []
    for said, text in sorted(RULES, key=lambda r: (-len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        whens.append(f"when (host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '{slash + rest}') then '{(said, text)[part]}'")
    return f"case {' '.join(whens)} end"


def _sql_strength(source: str, key: str, by: str) -> str:
    return f"""
  select {key}, 1 / (case when scale > 1e-9 then least(greatest(btw / scale, 0.001), 0.5) else 0.5 end) - 1 as k from (
    select {key}, q - p * p * w - p * (1 - p) * (j - 1) as btw, p * (1 - p) * (w - nn / w - (j - 1)) as scale from (
      select {key}, sum(n)::double as w, count(*)::double as j, sum(bad * bad / n::double) as q, sum(n * n)::double as nn, sum(bad) / sum(n)::double as p
      from {source} group by {by}))"""


ORACLE = f"""
with u as (
  select page_id, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{UPPER}', '{LOWER}') as host,
         regexp_extract(coalesce(url, ''), '{URL}', 2) as path from pages),
p as (select page_id, host, path, {_case(1)} as rule, {_case(0)} as said from u),
h as (select host, count(*)::double as n, sum(case when said = 'block' then 1 else 0 end)::double as bad,
             array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') as domain, string_split(host, '.')[-1] as suffix
      from p where said is not null group by host),
d as (select domain, suffix, sum(n) as n, sum(bad) as bad from h group by domain, suffix),
s as (select suffix, sum(n) as n, sum(bad) as bad from d group by suffix),
g as (select (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) as m0, coalesce((select max(k) from ({_sql_strength('s', '1 as one', '1')})), 1.0) as k0 from s),
s2 as (select s.suffix, (bad + k0 * m0) / (n + k0) as ms, k as ks from s join ({_sql_strength('d', 'suffix', 'suffix')}) using (suffix), g),
d2 as (select d.domain, (bad + ks * ms) / (n + ks) as md, k as kd from d join ({_sql_strength('h', 'domain', 'domain')}) using (domain) join s2 using (suffix)),
a as (select host, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') as domain, string_split(host, '.')[-1] as suffix
      from p where rule is null group by host),
r as (select a.host, coalesce(bad, 0) + coalesce(kd, ks, k0) * coalesce(md, ms, m0) as al,
             coalesce(n, 0) - coalesce(bad, 0) + coalesce(kd, ks, k0) * (1 - coalesce(md, ms, m0)) as be
      from a left join h on h.host = a.host left join d2 on d2.domain = a.domain left join s2 on s2.suffix = a.suffix, g)
select page_id, p.host, path, rule,
       coalesce(said, case when al / (al + be) - {Z} * sqrt(al * be / ((al + be) * (al + be) * (al + be + 1))) > {CUT} then 'block' else 'allow' end) as verdict
from p left join r on p.rule is null and r.host = p.host
"""
