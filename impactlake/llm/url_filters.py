"""URL filters: rules by host and path, then an empirical-Bayes reputation of the host.

Bad labelled pages are counted per host, registered domain (the suffix and one label) and suffix (the last label, or
one of a few suffixes of two labels). Each level's rate is shrunk to its parent's by a beta-binomial prior whose weight is estimated from the data by
moments; a host is blocked if the lower posterior bound of its bad rate exceeds the rate of all pages, that is if it is surely
worse than pages in general. All of it is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from impactlake.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Reputation:
    """z: how many posterior standard deviations below the mean the bound lies. excess: how far above the overall bad rate the bound has to be to block. rho: limits of the estimated intra-class correlation; the prior weighs 1 / rho - 1 pages. suffixes: those of two labels."""

    z: float = 1.645
    excess: float = 0.0
    rho_min: float = 0.005
    rho_max: float = 0.5
    suffixes: tuple[str, ...] = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "co.jp", "co.kr", "co.in", "co.nz", "co.za", "com.br", "com.cn", "com.mx", "com.tr")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule of (verdict, 'host/path...'), nulls if none fits. The rules are a short fixed list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        own, _, tail = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def domain_pattern(settings: Reputation) -> str:
    """All of it is the registered domain, its second group the suffix."""
    return r"([^.]+\.)?(" + "|".join(s.replace(".", r"\.") for s in settings.suffixes) + r"|[^.]*)$"


def domain_of(host: Column, settings: Reputation = Reputation()) -> Column:
    return F.regexp_extract(host, domain_pattern(settings), 0)


def suffix_of(host: Column, settings: Reputation = Reputation()) -> Column:
    return F.regexp_extract(host, domain_pattern(settings), 2)


def _shrunk(nodes: DataFrame, settings: Reputation) -> tuple[DataFrame, float]:
    """nodes(n, k, prior) with the posterior mean of the rate, and the weight of the prior: 1 / rho - 1 for the moment estimate of the beta-binomial's rho."""
    noise = F.col("prior") * (1 - F.col("prior"))
    spread = F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("prior"), 2) - noise)
    rho = nodes.agg(F.try_divide(spread, F.sum(noise * (F.col("n") - 1)))).first()[0]
    weight = 1 / min(settings.rho_max, max(settings.rho_min, settings.rho_min if rho is None else rho)) - 1
    return nodes.withColumn("mean", (weight * F.col("prior") + F.col("k")) / (weight + F.col("n"))), weight


def reputation(outcomes: DataFrame, hosts: DataFrame, settings: Reputation = Reputation()) -> DataFrame:
    """For each distinct host of `hosts`: host, n, k, mean, bound (lower posterior bound of the bad rate), blocked.

    outcomes(host, bad 0/1) are the labelled pages; rows with a null or empty host or a null outcome take no part. A host without
    labelled pages gets its domain's rate, else its suffix's, else the overall one, with n = 0. Without any
    outcome the overall rate is 0.5 and nothing is learned.
    """
    own = outcomes.filter("host != '' and bad is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").cast("long").alias("k"))
    own = written(own.select("host", domain_of(F.col("host"), settings).alias("domain"), suffix_of(F.col("host"), settings).alias("suffix"), "n", "k"), "hosts")
    total = own.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    overall = ((total["k"] or 0) + 1) / ((total["n"] or 0) + 2)
    counts = [F.sum("n").alias("n"), F.sum("k").alias("k")]
    suffix, _ = _shrunk(own.groupBy("suffix").agg(*counts).withColumn("prior", F.lit(overall)), settings)
    suffix = suffix.select("suffix", F.col("mean").alias("suffix_mean"))
    domain, _ = _shrunk(own.groupBy("suffix", "domain").agg(*counts).join(suffix, "suffix").withColumnRenamed("suffix_mean", "prior"), settings)
    domain = domain.select("domain", F.col("mean").alias("domain_mean"))
    _, weight = _shrunk(own.join(domain, "domain").withColumnRenamed("domain_mean", "prior"), settings)
    all_hosts = hosts.select("host").filter("host != ''").distinct().withColumns({"domain": domain_of(F.col("host"), settings), "suffix": suffix_of(F.col("host"), settings)})
    found = all_hosts.join(own.select("host", "n", "k"), "host", "left").join(domain, "domain", "left").join(suffix, "suffix", "left")
    prior, n, k = F.coalesce("domain_mean", "suffix_mean", F.lit(overall)), F.coalesce("n", F.lit(0)), F.coalesce("k", F.lit(0))
    mean, size = (weight * prior + k) / (weight + n), weight + n
    bound = mean - settings.z * F.sqrt(mean * (1 - mean) / (size + 1))
    return found.select("host", n.alias("n"), k.alias("k"), mean.alias("mean"), bound.alias("bound")).withColumn("blocked", F.col("bound") > overall + settings.excess)


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], settings: Reputation = Reputation(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict (allow or block).

    outcomes(url, bad 0/1) are labelled pages. The longest fitting rule decides; without one the host's posterior
    bound does. Null urls and those without "://" have an empty host and path, fit no rule and are allowed. Repeated rows are judged alike; an empty table gives no rows.
    """
    url = F.col("url")
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    scored = reputation(outcomes.select(host_of(F.col("url").cast("string")).alias("host"), "bad"), own.select("host"), settings)
    # written, it is broadcast or comes straight from a shuffle: adaptive execution can split a hot host's pages
    bad = written(scored.filter("blocked").select("host", F.lit(True).alias("blocked")), "blocked-hosts")
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))
    return own.join(bad, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"))
