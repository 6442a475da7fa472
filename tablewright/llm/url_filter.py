"""URL filter: explicit rules first, then empirical-Bayes host reputation.

A page's label is that of the document its `key` names: the page_id unless another
expression is given, such as `document_number` of the url.  A page is good if its
label has quality 1 and toxic 0.  Good rates are shrunk
level by level through beta priors: all pages to suffix, suffix to registered
domain, domain to host.  The prior strength of a level is the beta-binomial
moment estimate from the spread of its groups around their parents' means.  A
host is blocked if the upper posterior bound of its good rate is below
`min_good`; a host without labels has its parents' posterior.

Defined results: a null url, or one without "://", has empty host and path and
belongs to the host ""; null labels and labels of unknown pages are ignored, and
a page with a null key has no label;
several labels of one id count once, the worst of them; repeated pages are each
judged.  Hosts are joined back by a shuffle join that adaptive execution splits
at hot hosts; only blocked hosts take part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Suffixes of more than one label, for the registered domain.
LONG_SUFFIXES = ("co.uk", "org.uk", "com.au", "co.jp", "com.br")


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def document_number(url: Column) -> Column:
    """The number that the last segment of the url's path is, before any extension; null if it is none."""
    return F.regexp_extract(path_of(url), r"(?s)/([0-9]+)(?:\.[^/]*)?/?$", 1).try_cast("bigint")


def matched_rule(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block", r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        what = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, what) if out is None else out.when(fits, what)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def _suffix(host: Column) -> Column:
    long = reduce(lambda a, s: a | host.endswith("." + s), LONG_SUFFIXES, F.lit(False))
    return F.when(long, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def _domain(host: Column) -> Column:
    long = reduce(lambda a, s: a | host.endswith("." + s), LONG_SUFFIXES, F.lit(False))
    return F.when(long, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def host_counts(pages: DataFrame, labels: DataFrame, key: Column | None = None) -> DataFrame:
    """(host, domain, suffix, n, k) of every host: labelled pages and good ones.

    `key` is the doc_id of a page's label; page_id if none is given."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    one = one.groupBy(F.col("doc_id").alias("_id")).agg(
        F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("long")).alias("good"))
    seen = pages.select((F.col("page_id") if key is None else key).alias("_key"), host_of(F.col("url")).alias("host"))
    seen = seen.join(one, seen["_key"] == one["_id"], "left")
    seen = seen.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("k"))
    return seen.select("host", _domain(F.col("host")).alias("domain"), _suffix(F.col("host")).alias("suffix"), "n", "k")


def _strength(groups: DataFrame) -> float:
    """Beta prior strength from columns n, k and m (the parent's mean), by moments."""
    p, v = F.col("k") / F.col("n"), F.col("m") * (1 - F.col("m"))
    r = groups.where("n > 0").agg(F.sum(F.col("n") * (p - F.col("m")) ** 2).alias("s"), F.sum(v).alias("v"),
                                  F.sum(v * (F.col("n") - 1)).alias("w")).first()
    rho = ((r["s"] or 0.0) - (r["v"] or 0.0)) / r["w"] if r["w"] else 0.0
    rho = min(max(rho, 1e-3), 0.999)
    return round(1 / rho - 1, 6)


def host_posteriors(counts: DataFrame, z: float = 1.645) -> DataFrame:
    """Add mean and upper bound of the good rate to the hosts."""
    counts = cut(counts)
    total = counts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    mean = ((total["k"] or 0) + 1) / ((total["n"] or 0) + 1)  # good, as long as no label says otherwise
    suffixes = counts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("m", F.lit(mean))
    s = _strength(suffixes)
    suffixes = cut(suffixes.select("suffix", ((F.col("k") + s * F.col("m")) / (F.col("n") + s)).alias("m")))
    domains = counts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).join(suffixes, "suffix")
    s = _strength(domains)
    domains = cut(domains.select("suffix", "domain", ((F.col("k") + s * F.col("m")) / (F.col("n") + s)).alias("m")))
    hosts = counts.join(domains, ["suffix", "domain"])
    s = _strength(hosts)
    a, b = F.col("k") + s * F.col("m"), F.col("n") - F.col("k") + s * (1 - F.col("m"))
    return hosts.select("host", "n", "k", (a / (a + b)).alias("mean"),
                        (a / (a + b) + z * F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))).alias("upper"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES, min_good: float = 0.5, z: float = 1.645,
                key: Column | None = None) -> DataFrame:
    """(page_id, url, host, path, rule, verdict) of every page; `key` as in `host_counts`."""
    bad = host_posteriors(host_counts(pages, labels, key), z).where(F.col("upper") < min_good).select(F.col("host").alias("_bad"))
    out = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    out = out.join(bad, F.col("host") == F.col("_bad"), "left")
    hit = matched_rule(F.col("host"), F.col("path"), rules)
    return out.select("page_id", "url", "host", "path", hit["rule"].alias("rule"), F.coalesce(
        hit["verdict"], F.when(F.col("_bad").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))
