"""URL filter: explicit rules, then an empirical-Bayes reputation of hosts.

Labelled pages give each host, registered domain and suffix a count of bad and of all outcomes. The
counts are pre-aggregated, so one hot host is one row. Rates are shrunk downwards: the corpus gives the
prior of a suffix, the suffix that of a registered domain, the domain that of a host, each as a beta
prior with a fitted strength. A page is blocked when the lower bound of its host's posterior is over the
threshold; that of a host without labelled pages is the prior that its domain, suffix or the corpus gives.
Only DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: Fixed values: (action, host, start of the path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Labels below which registries of two-letter countries register, as in example.co.uk.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gob", "gov", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as an index into ``rules``, or null. Of equal length the first wins."""
    fit = F.lit(None).cast("int")
    for i, (_, h, p) in sorted(enumerate(rules), key=lambda x: (len(x[1][1]) + len(x[1][2]), -x[0])):
        fit = F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.lit(i)).otherwise(fit)
    return fit


def levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix. A suffix is the last label, or the last two where they are like co.uk; the domain has one label more."""
    last, two, three = [F.substring_index(host, ".", -i) for i in (1, 2, 3)]
    deep = (F.length(last) == 2) & F.substring_index(two, ".", 1).isin(*SECOND_LEVEL)
    return F.when(deep, three).otherwise(two), F.when(deep, two).otherwise(last)


def reputation(outcomes: DataFrame, least: float = 2.0, most: float = 1000.0, z: float = 1.645) -> DataFrame:
    """``outcomes`` (host, n, bad) by host with the posterior mean and lower bound of the bad rate.

    Hosts of which n is 0 teach nothing; theirs is the prior of the nearest level with outcomes.
    The strength of each prior is fitted by moments from how the children's rates vary around their
    parent's, weighted by n, and kept between ``least`` and ``most``. Only sums reach the driver.
    """
    domain, suffix = levels(F.col("host"))
    every = outcomes.withColumns({"domain": domain, "suffix": suffix})
    hosts, unseen = every.filter("n > 0"), every.filter("n = 0")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("bad").alias("db"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("db").alias("sb"))
    n, bad = suffixes.agg(F.sum("sn"), F.sum("sb")).first()
    rate = (bad + 0.5) / (n + 1.0) if n else 0.5

    def strength(df: DataFrame, k: str, m: str, mean: Column) -> float:
        p = F.col(m) / F.col(k)
        inner = F.sum(F.col(k) * (p - mean) * (p - mean))
        row = df.agg(inner, F.sum(mean * (1 - mean)), F.sum(F.col(k) * mean * (1 - mean)), F.count(F.lit(1))).first()
        if not row[0] or not row[2]:
            return most
        # E[sum k (p - mean)^2] = sum mean (1 - mean) (1 + (k - 1) rho), with rho = 1 / (strength + 1)
        rho = (row[0] - row[1]) / max(row[2] - row[1], 1e-9)
        return float(round(min(most, max(least, 1 / max(rho, 1e-9) - 1)), 6))

    s = strength(suffixes, "sn", "sb", F.lit(rate))
    suffixes = suffixes.withColumn("sm", (F.col("sb") + s * F.lit(rate)) / (F.col("sn") + s))
    domains = domains.join(suffixes, "suffix")
    d = strength(domains, "dn", "db", F.col("sm"))
    domains = domains.withColumn("dm", (F.col("db") + d * F.col("sm")) / (F.col("dn") + d))
    hosts = hosts.join(domains.select("domain", "dm"), "domain")
    h = strength(hosts, "n", "bad", F.col("dm"))
    # a prior's mean comes with the strength that it has for the level below it
    unseen = unseen.join(domains.select("domain", "dm"), "domain", "left").join(suffixes.select("suffix", "sm"), "suffix", "left")
    unseen = unseen.withColumn("k", F.when(F.col("dm").isNotNull(), h).when(F.col("sm").isNotNull(), d).otherwise(s))
    unseen = unseen.withColumn("dm", F.coalesce("dm", "sm", F.lit(rate)))
    hosts = hosts.withColumn("k", F.lit(h)).select("host", "n", "bad", "dm", "k").unionByName(unseen.select("host", "n", "bad", "dm", "k"))
    a, b = F.col("bad") + F.col("k") * F.col("dm"), F.col("n") - F.col("bad") + F.col("k") * (1 - F.col("dm"))
    mean = a / (a + b)
    return hosts.select("host", "n", "bad", mean.alias("mean"), (mean - z * F.sqrt(mean * (1 - mean) / (a + b + 1))).alias("lower"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, threshold: float = 0.5) -> DataFrame:
    """Every page with host, path, rule, verdict, and the posterior mean and lower bound of its host (null without labelled pages of its own).

    ``labels`` (page_id, bad 0/1). A null url, or one without ``://``, has an empty host and path; an
    empty host is allowed. A host without labelled pages is judged by the prior of its nearest level. Rows of pages that repeat stay; several labels of an id count as one, the worst. Empty tables give no rows.
    """
    seen = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    worst = labels.filter("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    outcomes = seen.join(worst, "page_id", "left").filter("host <> ''").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    known = reputation(stage(outcomes, "url-hosts")).select("host", "n", "mean", "lower")  # a row for each host; read for each prior
    fit = rule_of(F.col("host"), F.col("path"), rules)
    joined = seen.join(known, "host", "left").withColumn("_fit", fit)
    at = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), F.col("_fit") + 1)
    own = F.when(F.col("lower") > threshold, F.lit("block")).otherwise("allow")
    rule = F.when(F.col("_fit").isNotNull(), at([h + p for _, h, p in rules]))
    verdict = F.when(F.col("_fit").isNotNull(), at([a for a, _, _ in rules])).otherwise(own)
    return joined.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), F.when(F.col("n") > 0, F.round("mean", 6)).alias("bad_rate"), F.when(F.col("n") > 0, F.round("lower", 6)).alias("bad_rate_lower"))
