"""URL filters by rules and by empirical-Bayes host reputation.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's path; the longest rule
wins. Pages that a rule decides are the labelled outcomes (blocked or allowed). A page without a rule is judged by its
host: the host's share of blocked outcomes is shrunk towards that of its registered domain, which is shrunk towards its
suffix (the last label, or one of the listed suffixes of several labels; a port does not count, an IPv4 address is a domain of its own without a suffix), which is shrunk towards all pages. Each level's prior is a beta distribution whose mean is the parent's
posterior mean and whose strength is fitted to the level's own groups by moments. The page is blocked when the lower
bound of the host's posterior block rate is above a threshold.

Only DataFrame functions are used. Pages are reduced to one row for each host before anything is shuffled; the
suffix and domain tables are made from that table. The join back is a plain equi-join on host, whose large partitions
adaptive execution splits.

Null urls, and urls without "://", have an empty host and path: no rule fits, and they form a host, domain and suffix
of their own. Repeated rows give repeated results. Without outcomes every posterior is the starting rate of 0.5 and
nothing is blocked. An empty table gives an empty result. Columns of the input other than the two named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: public suffixes of two labels, a parameter
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def _first_rule(rules, host: Column, path: Column, value) -> Column:
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[1], r[2])):  # the longest is asked first
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, F.lit(value(rule))).otherwise(out)
    return out


def with_rules(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """pages with host, path, rule and rule_verdict."""
    host, path = F.col("host"), F.col("path")
    return (
        pages.withColumn("host", host_of(F.col(url)))
        .withColumn("path", path_of(F.col(url)))
        .withColumn("rule", _first_rule(rules, host, path, lambda r: r[1] + r[2]))
        .withColumn("rule_verdict", _first_rule(rules, host, path, lambda r: r[0]))
    )


def _strength(groups: DataFrame, low: float, high: float) -> DataFrame:
    """One row: the beta prior's strength (sum of its parameters) that fits the spread of the groups' rates."""
    rate = F.col("k") / F.col("n")
    mean = F.sum("k") / F.sum("n")
    spread = F.sum(F.col("k") * rate) / F.sum("n") - mean * mean
    groups = groups.where("n > 0").agg(mean.alias("m"), spread.alias("v"))
    fitted = F.col("m") * (1 - F.col("m")) / F.col("v") - 1
    return groups.select(
        F.when(F.col("v") > 1e-9, F.least(F.greatest(fitted, F.lit(low)), F.lit(high))).otherwise(F.lit(high)).alias("strength")
    )


def _shrunk(child: DataFrame, parent: DataFrame, key: str, low: float, high: float) -> DataFrame:
    """child with rate (posterior mean) and strength; parent has key and rate."""
    prior = parent.select(key, F.col("rate").alias("prior"))
    one = _strength(child, low, high)  # one row by construction
    out = child.join(prior, key).join(F.broadcast(one), F.lit(True), "left")
    out = out.withColumn("strength", F.coalesce("strength", F.lit(high)))
    return out.withColumn("rate", (F.col("k") + F.col("strength") * F.col("prior")) / (F.col("n") + F.col("strength")))


def with_domain(hosts: DataFrame, suffixes=SUFFIXES) -> DataFrame:
    """hosts with domain (the registered one) and suffix."""
    bare = F.regexp_replace("host", ":[0-9]*$", "")
    last, two, three = (F.substring_index(bare, ".", -i) for i in (1, 2, 3))
    address, listed = bare.rlike(r"^[0-9]+(\.[0-9]+){3}$"), two.isin(*suffixes)
    domain = F.when(address, bare).when(listed, three).otherwise(two)
    return hosts.withColumns({"domain": domain, "suffix": F.when(address, "").when(listed, two).otherwise(last)})


def reputation(hosts: DataFrame, low: float = 2.0, high: float = 200.0, z: float = 1.645, suffixes=SUFFIXES) -> DataFrame:
    """hosts(host, n outcomes, k of them blocked) with the posterior rate and its lower bound."""
    hosts = with_domain(hosts, suffixes)
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).withColumn("all", F.lit(1))
    whole = suffixes.groupBy("all").agg(((F.sum("k") + 1) / (F.sum("n") + 2)).alias("rate"))
    suffixes = _shrunk(suffixes, whole, "all", low, high)
    domains = _shrunk(domains, suffixes, "suffix", low, high)
    hosts = _shrunk(hosts.drop("suffix"), domains, "domain", low, high)
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("strength") + 1))
    return hosts.select("host", "rate", (F.col("rate") - z * sd).alias("bound"))


def judge(pages: DataFrame, rules=RULES, threshold: float = 0.5, url: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict, and the host's posterior block rate and bound."""
    ruled = with_rules(pages, rules, url)
    outcome = F.col("rule_verdict")
    hosts = ruled.groupBy("host").agg(F.count(outcome).alias("n"), F.count(F.when(outcome == "block", 1)).alias("k"))
    judged = ruled.join(reputation(hosts), "host", "left")
    guess = F.when(F.col("bound") > threshold, "block").otherwise("allow")
    return judged.withColumn("verdict", F.coalesce(outcome, guess)).drop("rule_verdict")
