"""URL filters by empirical-Bayes host reputation.

Every page with an outcome is a good or bad trial of its host. Outcomes are given (labels of pages), or they are what is
known of the page's own url: the verdict of the explicit rule that fits it, else bad where the url holds one of a list
of seed words as a whole word, else good. A host's rate of bad outcomes has a beta prior whose mean is its registered
domain's posterior mean without the host's own pages; likewise the domain's prior comes from its suffix without the
domain, and the suffix's from all other pages. How much a prior counts (its strength in pages) is fitted per level by
the method of moments on the spread of the children's rates. A host is blocked where the lower bound of its posterior
exceeds the allowed bad rate. Explicit rules go first: a rule fits its host and all subdomains where the url's path
starts with the rule's, and the longest fitting rule decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: (rule, verdict); a rule is a host and a path.
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Whole words of a host or path by which a page is taken for a bad one, where no rule knows better.
SEEDS = tuple("adult bet bets betting bingo casino escort gambling jackpot malware phishing pills poker porn scam slots spam torrent viagra warez xxx".split())
WEAKEST, STRONGEST = 1.0, 1000.0
#: Suffixes of two labels under which names are registered; a full list can be passed instead.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "co.jp", "ne.jp", "or.jp", "com.au", "com.br", "co.nz", "co.in", "co.kr", "com.cn")


def host_of(url) -> F.Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url) -> F.Column:
    """What follows the host, up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host, path, rules=RULES) -> F.Column:
    """The longest fitting rule, or null."""
    out = None
    for rule, _ in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        out = F.when(fits, F.lit(rule)) if out is None else out.when(fits, F.lit(rule))
    return out.otherwise(F.lit(None).cast("string")) if out is not None else F.lit(None).cast("string")


def _levels(host, suffixes) -> tuple[F.Column, F.Column]:
    """(registered domain, suffix): the suffix is one of `suffixes` (such as co.uk) or else the last label, the domain
    has one label more."""
    two = F.substring_index(host, ".", -2)
    known = two.isin(list(suffixes)) if suffixes else F.lit(False)
    return F.when(known, F.substring_index(host, ".", -3)).otherwise(two), F.when(known, two).otherwise(F.substring_index(host, ".", -1))


def url_outcome(host, path, rules=RULES, seeds=SEEDS) -> F.Column:
    """1 for a bad page, 0 for a good one, null without a host: the fitting rule's verdict, else whether a seed word occurs."""
    rule = rule_of(host, path, rules)
    blocked = rule.isin([r for r, what in rules if what == "block"]) if rules else F.lit(False)
    seeded = F.lower(F.concat(host, path)).rlike(r"(^|[^a-z0-9])(" + "|".join(seeds) + r")($|[^a-z0-9])") if seeds else F.lit(False)
    return F.when(host != "", F.when(rule.isNotNull(), blocked).otherwise(seeded).cast("long"))


def _posterior(level: DataFrame, key: str, parent: str | None, above: DataFrame | tuple[float, float]) -> DataFrame:
    """level (key, parent, n, bad) with mean, a, b: the beta posterior under the parent's mean as prior mean.

    The parent's a and b go without the member's own pages. The strength m of the prior is p(1-p)/v - 1 for mean p and
    variance v of the rates between the level's members, v being the weighted spread of the rates less what chance
    alone gives.
    """
    rate = F.col("bad") / F.greatest(F.col("n"), F.lit(1))
    fit = level.filter("n > 0").agg(
        F.sum("n").alias("sn"), F.sum("bad").alias("sb"), F.count("*").alias("k"), F.sum(F.col("n") * rate * rate).alias("srr"), F.sum(F.col("n") * F.col("n")).alias("snn")
    )
    p = (F.col("sb") + 1.0) / (F.col("sn") + 2.0)
    within = F.col("k") * p * (1 - p)
    spread = F.col("srr") - F.col("sn") * p * p
    between = (spread - within) / F.greatest(F.col("sn") - F.col("snn") / F.greatest(F.col("sn"), F.lit(1)), F.lit(1e-9))
    strength = F.when(between <= 1e-9, STRONGEST).otherwise(F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), p * (1 - p) / between - 1)))
    m = fit.select(F.coalesce(strength, F.lit(WEAKEST)).alias("m")).first().m
    if parent is None:
        joined = level.withColumn("pa", F.lit(above[0])).withColumn("pb", F.lit(above[1]))
    else:
        joined = level.join(above.select(F.col(parent), F.col("a").alias("pa"), F.col("b").alias("pb")), parent, "left")
    prior = (F.col("pa") - F.col("bad")) / (F.col("pa") + F.col("pb") - F.col("n"))
    joined = joined.withColumn("prior", prior)
    a = F.col("bad") + m * F.col("prior")
    b = F.col("n") - F.col("bad") + m * (1 - F.col("prior"))
    return joined.withColumn("a", a).withColumn("b", b).withColumn("mean", a / (a + b)).drop("prior", "pa", "pb")


def host_reputation(pages: DataFrame, labels: DataFrame | None = None, z: float = 1.64, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_col: str = "quality", public_suffixes=SUFFIXES, rules=RULES, seeds=SEEDS) -> DataFrame:
    """One row per host: host, pages, labelled, bad, bad_rate (posterior mean), lower, upper.

    A page's outcome is bad where label_col is 0, if labels are given (their ids must be those of the pages; of repeated
    ones the worst counts); without labels it is the url's own. Hosts without outcomes get their domain's rate; pages
    without a host have no outcome of their url. lower and upper are the posterior's bounds at z standard deviations.
    """
    url = F.col(url_col)
    p = pages.select(F.col(id_col).cast("long").alias("__id"), host_of(url).alias("host"), path_of(url).alias("path"))
    if labels is None:
        judged = p.select("host", url_outcome(F.col("host"), F.col("path"), rules, seeds).alias("__bad"))
    else:
        outcome = labels.filter(F.col(label_id).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(label_id).cast("long").alias("__id")).agg((F.min(label_col) == 0).cast("long").alias("__bad"))
        judged = p.join(outcome, "__id", "left")
    hosts = judged.groupBy("host").agg(F.count("*").alias("pages"), F.count("__bad").alias("n"), F.coalesce(F.sum("__bad"), F.lit(0)).alias("bad"))
    domain, suffix = _levels(F.col("host"), public_suffixes)
    hosts = materialize(hosts.withColumn("domain", domain).withColumn("suffix", suffix))
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    every = suffixes.agg(*sums).first()
    n, bad = every.n or 0, every.bad or 0
    mid = _posterior(suffixes, "suffix", None, (bad + 1.0, n - bad + 1.0))
    low = _posterior(domains, "domain", "suffix", mid)
    found = _posterior(hosts, "host", "domain", low)
    sd = F.sqrt(F.col("a") * F.col("b") / ((F.col("a") + F.col("b")) ** 2 * (F.col("a") + F.col("b") + 1)))
    return found.select(
        "host", "pages", F.col("n").alias("labelled"), "bad", F.col("mean").alias("bad_rate"),
        F.greatest(F.lit(0.0), F.col("mean") - z * sd).alias("lower"), F.least(F.lit(1.0), F.col("mean") + z * sd).alias("upper"),
    )


def filter_urls(pages: DataFrame, labels: DataFrame | None = None, rules=RULES, allowed_bad: float = 0.3, z: float = 1.64, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_col: str = "quality", seeds=SEEDS) -> DataFrame:
    """One row per page: id_col, host, path, rule, verdict (allow or block), bad_rate, lower.

    A null url or one without :// has an empty host and path and no rule; its verdict is the empty host's. Rows with a
    null or repeated id are judged like any other. Other columns are ignored. Empty tables give an empty result; without
    a bad outcome nothing is blocked but by rule. Outcomes are labels where given, else the urls' own.
    """
    judged = host_reputation(pages, labels, z, id_col, url_col, label_id, label_col, rules=rules, seeds=seeds).select("host", "bad_rate", "lower")
    p = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    p = p.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.when(F.col("lower") > allowed_bad, "block").otherwise("allow")
    for rule, what in rules:
        verdict = F.when(F.col("rule") == rule, F.lit(what)).otherwise(verdict)
    return p.join(judged, "host", "left").select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "bad_rate", "lower")
