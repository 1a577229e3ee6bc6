"""URL filtering: rules first, and the reputation of hosts by empirical Bayes for what no rule decides.

Reputation. Labelled pages of a host are good (quality 1 and not toxic) or bad. The share of good pages has a beta prior
at each level: a suffix's is centred on all pages, a registered domain's on its suffix's posterior mean, a host's on its
domain's. How strongly a level is drawn to the one above is estimated from the table itself (moments of the
beta-binomial: `prior_strength`). A host is blocked if the upper bound of its posterior, the quantile `LEVEL` of its beta
distribution, is under `LEAST_GOOD`: it takes evidence to block, and a host without labels goes by its domain. As the
quantile is under a value if and only if the distribution has more than `LEVEL` of its mass there, that mass is what is
computed, with the continued fraction of the incomplete beta function, one host a row.

For its reputation, a host goes without user name, port and closing dots. Its suffix is its last label, or its last two if
they are one of `TWO_LEVEL` (a parameter); its registered domain has one label more. An address in numbers is a domain of
its own.

Rules are few and given by the caller; hosts may be many and are joined, not collected. Only sums by level reach the
driver: a handful of numbers.

Defined results. Null url, or one without `://`: host and path are empty. Null page id: judged, but has no label.
Labels: null quality or toxicity counts as not good; several for one id all count. Repeated rows: judged each. Empty tables:
no rows, or no labels (everything is allowed that no rule blocks). Extra columns: left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: (verdict, rule): host and path, `/` between them.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
LEVEL, LEAST_GOOD = 0.95, 0.5
#: Suffixes of two labels under which names are registered. Fixed values.
TWO_LEVEL = (
    *("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.za", "co.in", "co.jp", "ne.jp", "or.jp", "co.kr"),
    *("com.ar", "com.br", "com.cn", "com.hk", "com.mx", "com.sg", "com.tr", "com.tw"),
)
STRENGTH_BOUNDS = (1.0, 1000.0)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.regexp_extract(url, _URL, 2)


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is tested first
        of_host, _, of_path = text.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith("/" + of_path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def prior_strength(groups: DataFrame) -> tuple[float, float]:
    """(mean, strength) of the beta prior of groups with n labelled and g good: by moments, within `STRENGTH_BOUNDS`."""
    n, g = F.col("n").cast("double"), F.col("g").cast("double")
    row = groups.where("n > 0").agg(F.sum(n), F.sum(g), F.sum(n * n), F.count("*"), F.sum(g * g / n)).first()
    if not row[3]:
        return 0.5, STRENGTH_BOUNDS[0]
    total, good, squares, count, around = row
    mean = (good + 1) / (total + 2)
    rate = good / total
    within = rate * (1 - rate)
    spread = around - good * rate  # sum of n * (share - rate)^2
    room = within * (total - squares / total - (count - 1))
    alike = (spread - within * (count - 1)) / room if room > 0 else 0.0
    low, high = STRENGTH_BOUNDS
    return mean, high if alike <= 0 else min(high, max(low, 1 / alike - 1))


def site(host: Column) -> Column:
    """The host without user name, port and closing dots."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")


def levels(name: Column, two_level: Sequence[str] = TWO_LEVEL) -> tuple[Column, Column]:
    """Suffix and registered domain of a site."""
    number = name.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    two = F.substring_index(name, ".", -2)
    wide = two.isin(*two_level)
    suffix = F.when(number, "").when(wide, two).otherwise(F.substring_index(name, ".", -1))
    return suffix, F.when(number, name).when(wide, F.substring_index(name, ".", -3)).otherwise(two)


def mass_below(a: np.ndarray, b: np.ndarray, x: float) -> np.ndarray:
    """How much of each beta distribution lies under x: the regularised incomplete beta function.

    Its continued fraction converges in a number of steps that grows with the root of the larger parameter, on the side of the mean where x lies.
    """
    if not len(a):
        return np.zeros(0)
    turned = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    log_beta = np.array([math.lgamma(i) + math.lgamma(j) - math.lgamma(i + j) for i, j in zip(p, q, strict=True)])
    front = np.exp(p * np.log(z) + q * np.log1p(-z) - log_beta) / p
    # The fraction 1/(1 + d1/(1 + d2/(1 + ...))) from the back.
    value = np.ones(len(a))
    for k in range(40 + 4 * int(math.sqrt(max(p.max(), q.max()))), 0, -1):
        m = k // 2
        d = m * (q - m) * z / ((p + k - 1) * (p + k)) if k % 2 == 0 else -(p + m) * (p + q + m) * z / ((p + k - 1) * (p + k))
        value = 1 + d / value
    part = front / value
    return np.clip(np.where(turned, 1 - part, part), 0, 1)


def reputations(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", two_level: Sequence[str] = TWO_LEVEL) -> DataFrame:
    """(site, reputation, below): for every site, the posterior mean of its share of good pages, and how likely it is that the share is under `LEAST_GOOD`."""
    own = labels.select(labels["doc_id"].alias("id"), F.when((labels["quality"] == 1) & (labels["toxic"] == 0), 1).otherwise(0).alias("good"))
    seen = pages.select(pages[id_col].alias("id"), site(parts(pages[url_col])[0]).alias("site")).join(own, "id", "left")
    hosts = seen.groupBy("site").agg(F.count("good").alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("g"))
    suffix, domain = levels(F.col("site"), two_level)
    hosts = cut(hosts.select("site", suffix.alias("suffix"), domain.alias("domain"), "n", "g"))
    sums = (F.sum("n").alias("n"), F.sum("g").alias("g"))
    domains = hosts.groupBy("suffix", "domain").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums)
    mean, k_suffix = prior_strength(suffixes)
    _, k_domain = prior_strength(domains)
    _, k_host = prior_strength(hosts)

    def drawn(df: DataFrame, k: float, to: Column, name: str) -> DataFrame:
        return df.withColumn(name, (F.col("g") + k * to) / (F.col("n") + k))

    by_suffix = drawn(suffixes, k_suffix, F.lit(mean), "suffix_mean").select("suffix", "suffix_mean")
    by_domain = drawn(domains.join(by_suffix, "suffix"), k_domain, F.col("suffix_mean"), "domain_mean").select("domain", "domain_mean")
    by_host = hosts.join(by_domain, "domain")
    a, b = F.col("g") + k_host * F.col("domain_mean"), F.col("n") - F.col("g") + k_host * (1 - F.col("domain_mean"))
    below = F.pandas_udf(lambda a, b: pd.Series(mass_below(a.to_numpy(float), b.to_numpy(float), LEAST_GOOD)), "double")
    return by_host.select("site", a.alias("a"), b.alias("b")).select("site", (F.col("a") / (F.col("a") + F.col("b"))).alias("reputation"), below("a", "b").alias("below"))


def judged(pages: DataFrame, labels: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every page."""
    host, path = parts(pages[url_col])
    rows = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"), site(host).alias("site"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    # Checkpointed, so that the join has an exchange on both sides and Spark can split a host with very many pages.
    known = cut(reputations(pages, labels, id_col, url_col).select("site", (F.col("below") > LEVEL).alias("bad")))
    rows = rows.select("id", "host", "path", "site", rule.alias("rule"), verdict.alias("verdict")).join(known, "site")
    return rows.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("verdict", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))
