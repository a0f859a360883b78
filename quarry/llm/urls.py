"""URL filter: fixed host/path rules, then an empirical-Bayes reputation of hosts.

Method: labelled page outcomes are shrunk through beta-binomial priors from host
to registered domain to suffix to all pages, and a page is blocked when the
lower posterior bound of its host's bad rate is above a limit. Built-in
expressions and joins only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.shared import materialize

RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Public suffixes of two labels.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "com.br", "com.cn", "co.in", "co.jp", "ne.jp", "or.jp", "co.kr", "com.mx", "co.nz", "com.tr", "co.za",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: str | Column) -> Column:
    """Between the first :// and the next / ? # or end, A-Z lower-cased; '' if there is none."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def url_path(url: str | Column) -> Column:
    """From the end of the host up to ? # or end; '' if there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. The rules are a short fixed list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda x: (len(x[0]), x[0])):  # the longest is asked first
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame, low: float = 1.0, high: float = 1000.0) -> float:
    """Strength of the beta priors about the parents' rates by the method of moments.

    ``groups`` has n, bad and parent. One row comes to the driver.
    """
    rate, p = F.col("bad") / F.col("n"), F.col("parent")
    got = groups.where("n > 0").agg(F.sum(F.col("n") * (rate - p) * (rate - p)).alias("v"), F.sum(F.col("n") * p * (1 - p)).alias("m")).first()
    return min(max(got["m"] / got["v"] - 1, low), high) if got["v"] else high


def _shrunk(k: float):
    return (F.col("bad") + F.lit(k) * F.col("parent")) / (F.col("n") + F.lit(k))


def parents(host: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host: the suffix is the last label, or the last two where they are in ``suffixes``."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    long = F.regexp_extract(name, r"[^.]*\.[^.]*$", 0).isin(*suffixes)
    suffix = F.when(long, F.regexp_extract(name, r"[^.]*\.[^.]*$", 0)).otherwise(F.regexp_extract(name, r"[^.]*$", 0))
    return F.when(long, F.regexp_extract(name, r"([^.]*\.)?[^.]*\.[^.]*$", 0)).otherwise(F.regexp_extract(name, r"([^.]*\.)?[^.]*$", 0)), suffix


def reputation(pages: DataFrame, outcomes: DataFrame, max_rate: float = 0.35, z: float = 1.64, suffixes=SUFFIXES) -> DataFrame:
    """Hosts with their posterior and its verdict: (host, bad_rate, bad_bound, blocked).

    ``pages`` has page_id and host, ``outcomes`` page_id and bad (0/1, one row a
    page). Each level is shrunk towards the posterior rate of the level above.
    Hosts without a labelled page take what their domain and suffix say.
    """
    domain, suffix = parents(F.col("host"), suffixes)
    hosts = pages.join(outcomes, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = materialize(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts")
    domains = materialize(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    tops = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = tops.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    tops = tops.withColumn("parent", F.lit((total["bad"] or 0) / (total["n"] or 1)))
    above = tops.select("suffix", _shrunk(_strength(tops)).alias("parent"))
    domains = domains.join(above, "suffix")
    above = domains.select("domain", "suffix", _shrunk(_strength(domains)).alias("parent"))
    hosts = hosts.join(above, ["domain", "suffix"])
    k = _strength(hosts)
    post = _shrunk(k)
    low = post - z * F.sqrt(post * (1 - post) / (F.col("n") + F.lit(k + 1)))
    return hosts.select("host", post.alias("bad_rate"), low.alias("bad_bound")).withColumn("blocked", F.col("bad_bound") > max_rate)


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, max_rate: float = 0.35, suffixes=SUFFIXES) -> DataFrame:
    """One row per page row: page_id, host, path, rule, verdict, bad_rate, bad_bound.

    Labels belong to the page of the same id; a page is bad where a label row
    says quality 0 or toxic 1 (of repeated label rows the worst counts; rows
    with both null say nothing). bad_rate and bad_bound are the posterior of the
    page's host and its lower bound, to six digits. Null urls and urls without
    :// have empty host and path and share the reputation of the empty host.
    ``suffixes`` are the public suffixes of two labels, of any number. Repeated
    pages each get a row; only page_id and url are read, so other
    columns cannot clash; an empty table gives none.
    """
    host, path = url_host("url"), url_path("url")
    seen = pages.select("page_id", host.alias("host"), path.alias("path"))
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)
    outcomes = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    hosts = reputation(seen, outcomes, max_rate, suffixes=suffixes)
    rule, verdict = rule_column(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("blocked"), "block").otherwise("allow")
    out = seen.join(hosts, "host", "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), F.round("bad_rate", 6).alias("bad_rate"), F.round("bad_bound", 6).alias("bad_bound"))
