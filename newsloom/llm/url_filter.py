"""URL filtering by rules and by host reputation under empirical-Bayes shrinkage.

Reputation: of labelled pages, the share of bad ones by host. Each level is shrunk towards the one above it
by a beta-binomial prior (host to registered domain to suffix to all pages); a prior's strength is estimated
from how much the groups of its level differ beyond chance. A host is blocked when the lower bound of its
posterior share of bad pages, a quantile of the beta distribution, lies above the threshold. Hosts without labelled
pages inherit their domain's mean. User-info and port play no part in domain and suffix; an IP address is its own
domain and suffix.

Rules: of those whose host is the url's host or a parent of it and whose path starts the url's path, the
longest decides, before any reputation.

Defined results: a null url or one without :// has host and path empty; rows with null keys are judged like
others; repeated pages give repeated rows and count as often in the reputation; several outcomes of a page
count once, as bad if one is bad; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Public suffixes of two labels, the default of a parameter; every other suffix is the last label.
TWO_LABEL_SUFFIXES = (
    "ac.at", "ac.il", "ac.in", "ac.jp", "ac.kr", "ac.nz", "ac.uk", "ac.za",
    "co.at", "co.id", "co.il", "co.in", "co.jp", "co.ke", "co.kr", "co.nz", "co.th", "co.uk", "co.za",
    "com.ar", "com.au", "com.bd", "com.br", "com.cn", "com.co", "com.ec", "com.eg", "com.es", "com.gt", "com.hk", "com.mx",
    "com.my", "com.ng", "com.pe", "com.ph", "com.pk", "com.pl", "com.pt", "com.sa", "com.sg", "com.tr", "com.tw", "com.ua",
    "com.uy", "com.ve", "com.vn",
    "edu.ar", "edu.au", "edu.br", "edu.cn", "edu.co", "edu.hk", "edu.in", "edu.mx", "edu.my", "edu.pe", "edu.pl", "edu.sg",
    "edu.tr", "edu.tw", "edu.ua", "edu.vn",
    "go.id", "go.jp", "go.ke", "go.kr", "go.th",
    "gob.ar", "gob.es", "gob.mx", "gob.pe", "gouv.fr",
    "gov.au", "gov.br", "gov.cn", "gov.co", "gov.hk", "gov.il", "gov.in", "gov.my", "gov.ng", "gov.ph", "gov.pl", "gov.pt",
    "gov.sg", "gov.tr", "gov.tw", "gov.ua", "gov.uk", "gov.vn", "gov.za", "govt.nz",
    "ne.jp", "net.au", "net.br", "net.cn", "net.in", "net.nz", "net.pl", "net.tr", "net.tw", "net.ua", "net.uk", "net.za",
    "nhs.uk", "or.at", "or.id", "or.jp", "or.kr", "or.th",
    "org.ar", "org.au", "org.br", "org.cn", "org.hk", "org.il", "org.in", "org.mx", "org.my", "org.nz", "org.pl", "org.sg",
    "org.tr", "org.tw", "org.ua", "org.uk", "org.za",
    "sch.uk", "school.nz",
)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def name_of(host: Column) -> Column:
    """host without user-info and port."""
    return F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")


def _levels(host: Column, two_label: Sequence[str]) -> tuple[Column, Column, Column, Column]:
    """The host's name, its last two labels, whether they are a suffix, and whether the name is an IP address."""
    name = name_of(host)
    two = F.substring_index(name, ".", -2)
    return name, two, two.isin(*two_label), name.rlike(r"^(\[.*|[0-9]+(\.[0-9]+){3})$")


def suffix_of(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    name, two, listed, address = _levels(host, two_label)
    return F.when(address, name).when(listed, two).otherwise(F.substring_index(name, ".", -1))


def domain_of(host: Column, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    name, two, listed, address = _levels(host, two_label)
    return F.when(address, name).when(listed, F.substring_index(name, ".", -3)).otherwise(two)


def _below(a: np.ndarray, b: np.ndarray, x: float) -> np.ndarray:
    """The share of Beta(a, b) below x, for a, b > 0 and 0 < x < 1: the incomplete beta function's continued fraction,
    evaluated from its tail, on the side of the mean where it converges fast."""
    swapped = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swapped, b, a), np.where(swapped, a, b), np.where(swapped, 1 - x, x)
    fraction = np.ones(len(a))
    for m in range(100 + int(4 * math.sqrt(max(a.max(initial=0.0), b.max(initial=0.0)))), 0, -1):
        fraction = 1 + m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)) / fraction
        fraction = 1 - (p + m - 1) * (p + q + m - 1) * y / ((p + 2 * m - 2) * (p + 2 * m - 1)) / fraction
    log_beta = np.array([math.lgamma(u) + math.lgamma(v) - math.lgamma(u + v) for u, v in zip(p, q, strict=True)])
    area = np.exp(p * np.log(y) + q * np.log1p(-y) - log_beta) / (p * fraction)
    return np.where(swapped, 1 - area, area)


def share_below(a: Column, b: Column, x: float) -> Column:
    """The share of Beta(a, b) below x; a = 0 is all at zero, b = 0 all at one. One row a host, in Arrow batches."""

    def work(a: pd.Series, b: pd.Series) -> pd.Series:
        bad, good = a.to_numpy(float), b.to_numpy(float)
        share = np.where(bad <= 0, 1.0, 0.0)
        inner = (bad > 0) & (good > 0)
        share[inner] = _below(bad[inner], good[inner], x)
        return pd.Series(share)

    return F.pandas_udf(work, "double")(a, b)


def rule_columns(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits; null where none does."""
    text = verdict = None
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        text = F.when(fits, rule.text) if text is None else text.when(fits, rule.text)
        verdict = F.when(fits, rule.verdict) if verdict is None else verdict.when(fits, rule.verdict)
    return (F.lit(None).cast("string"),) * 2 if text is None else (text, verdict)


def _strength(groups: DataFrame, mean: float, least: float = 1.0, most: float = 1000.0) -> float:
    """Prior strength of a level by moments: 1/rho - 1, rho being the correlation within groups beyond chance."""
    n, bad = F.col("n"), F.col("bad")
    row = groups.where(n > 0).agg(
        F.count("*").alias("g"), F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.sum(n * (bad / n - mean) ** 2).alias("s"),
    ).first()
    if not row["g"] or row["g"] < 2 or not 0 < mean < 1:
        return most
    between = row["s"] / (mean * (1 - mean)) - (row["g"] - 1)
    room = row["n"] - row["nn"] / row["n"] - (row["g"] - 1)
    rho = between / room if room > 0 else 0.0
    return most if rho <= 0 else min(most, max(least, round(1 / rho - 1, 6)))


def host_reputation(hosts: DataFrame, threshold: float = 0.5, risk: float = 0.05, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """host, mean, below (the posterior's share under the threshold), blocked from hosts (host, n labelled, bad).

    The posterior's quantile at `risk` lies above the threshold just where less than `risk` of it lies below. Three numbers and an overall mean come to the driver; the levels themselves are joined as tables."""
    hosts = hosts.select("host", domain_of(F.col("host"), two_label).alias("domain"), suffix_of(F.col("host"), two_label).alias("suffix"), "n", "bad")
    domains = hosts.groupBy("domain").agg(F.max("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    mean = total["bad"] / total["n"] if total["n"] else 0.0
    k_suffix, k_domain, k_host = (_strength(level, mean) for level in (suffixes, domains, hosts))
    shrunk = lambda prior, k: (F.col("bad") + k * prior) / (F.col("n") + k)
    by_suffix = suffixes.select("suffix", shrunk(F.lit(mean), k_suffix).alias("suffix_mean"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", shrunk(F.col("suffix_mean"), k_domain).alias("domain_mean"))
    posterior = hosts.join(by_domain, "domain").select("host", (F.col("n") + k_host).alias("weight"), shrunk(F.col("domain_mean"), k_host).alias("mean"))
    judged = posterior.withColumn("below", share_below(F.col("mean") * F.col("weight"), (1 - F.col("mean")) * F.col("weight"), threshold))
    return judged.select("host", "mean", "below", (F.col("below") < risk).alias("blocked"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[Rule], threshold: float = 0.5, risk: float = 0.05, two_label: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages (page_id, url, outcome_key).

    outcomes (outcome_key, bad boolean) holds the labelled results; outcome_key may be null."""
    url = F.col("url")
    parts = pages.select("page_id", "outcome_key", host_of(url).alias("host"), path_of(url).alias("path"))
    known = outcomes.where("outcome_key is not null and bad is not null").groupBy("outcome_key").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    counted = parts.groupBy("host", "outcome_key").agg(F.count("*").alias("pages"))
    hosts = counted.join(known, "outcome_key", "left").groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("bad").isNotNull(), F.col("pages"))), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.col("bad") * F.col("pages")), F.lit(0)).alias("bad"),
    )
    reputation = host_reputation(written(hosts, "hosts"), threshold, risk, two_label).select("host", "blocked")
    rule, ruled = rule_columns(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("blocked"), "block").otherwise("allow")
    return parts.join(reputation, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(ruled, own).alias("verdict"))
