"""URL filters: rules by host and path, and the reputation of hosts by empirical Bayes.

Labelled pages are counted by host, registered domain and suffix.  Each level's rate of bad pages is shrunk towards
the level above through a beta prior with that level's posterior mean: suffixes towards all pages, domains towards their
suffix, hosts towards their domain.  The weight of a prior (in pages) is fitted to all labelled pages by moments: how much
more the members' rates differ from their parents' than binomial draws would.  A host is blocked if its posterior
gives at least CONFIDENCE to a rate of bad pages above `limit`.
"""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, staged


@dataclasses.dataclass(frozen=True)
class Rule:
    """`verdict` (allow or block) for urls on `host` and its subdomains whose path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: A host is blocked if its rate of bad pages is above LIMIT with this probability.
LIMIT, CONFIDENCE = 0.5, 0.95
#: Least and largest weight of a prior, in pages.
WEIGHTS = (1.0, 1e6)
#: Second labels that belong to a country's suffix (co.uk).
SECOND = ["ac", "co", "com", "edu", "gov", "net", "org"]
#: Steps of the integral on either side of the limit.
STEPS = 1000


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The rule that fits and is longest by host and path (ties: the first told), as a struct of name and verdict; else null."""
    out = F.lit(None).cast("struct<name string, verdict string>")
    for r in sorted(rules, key=lambda r: len(r.name), reverse=True)[::-1]:
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def suffix_of(host: Column) -> Column:
    """The last label, or two where the last is a country's and the one before is among SECOND; empty for addresses. Ports do not count."""
    labels = F.split(F.regexp_replace(host, ":[0-9]*$", ""), "\\.")
    last, second = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    two = (F.length(last) == 2) & second.isin(SECOND) & (F.size(labels) > 2)
    return F.when(host.rlike("^[0-9.]*(:[0-9]*)?$|\\]"), "").when(two, F.concat_ws(".", second, last)).otherwise(last)


def domain_of(host: Column) -> Column:
    """The suffix and one label more, without the port; the host itself where it has no suffix."""
    bare = F.regexp_replace(host, ":[0-9]*$", "")
    return F.when(suffix_of(host) == "", host).otherwise(F.call_function("substring_index", bare, F.lit("."), -F.size(F.split(suffix_of(host), "\\.")) - 1))


def prior_weight(n: str, bad: str, mean: str) -> Column:
    """Moment estimate of a beta prior's weight from members' counts and their parents' means (an aggregate).

    With intra-class correlation r, sum n (p - m)^2 / (m (1 - m)) of k members is expected to be k + r (sum n - k); the weight is 1 / r - 1.
    """
    n_, m = F.col(n), F.least(F.greatest(F.col(mean), F.lit(1e-6)), F.lit(1 - 1e-6))
    spread = F.sum(n_ * F.pow(F.col(bad) / n_ - m, 2) / (m * (1 - m)))
    r = (spread - F.count("*")) / (F.sum(n_) - F.count("*"))
    low, high = WEIGHTS
    return F.when((F.sum(n_) > F.count("*")) & (r > 1 / (1 + high)), F.greatest(F.lit(low), 1 / r - 1)).otherwise(F.lit(high))


def chance_above(a: Column, b: Column, limit: float) -> Column:
    """P(x > limit) for a beta(a, b) variable.

    The density of the log-odds is smooth for any a, b > 0 and falls off at least exponentially, so Simpson's rule on both sides of the
    limit gives it; the range covers 8 deviations and 25 decay lengths around the mode.
    """
    cut = math.log(limit / (1 - limit))
    mode, wide = F.log(a / b), 1 / a + 1 / b
    reach = 8 * F.sqrt(wide) + 25 * wide
    peak = a * F.log(a / (a + b)) + b * F.log(b / (a + b))

    def side(end: Column) -> Column:
        h = (end - cut) / STEPS

        def term(total: Column, k: Column) -> Column:
            x = cut + k * h
            # log of s^a (1 - s)^b at s = 1 / (1 + e^-x)
            log_s, log_rest = -F.greatest(-x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x))), -F.greatest(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))
            weight = F.when((k == 0) | (k == STEPS), 1.0).when(k % 2 == 1, 4.0).otherwise(2.0)
            return total + weight * F.exp(a * log_s + b * log_rest - peak)

        return F.abs(h) / 3 * F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(0.0), term)

    above = side(F.greatest(mode + reach, F.lit(cut + 1e-9)))
    below = side(F.least(mode - reach, F.lit(cut - 1e-9)))
    return above / (above + below)


def reputations(outcomes: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(host, domain, suffix, n, bad, a, b, chance) of every host of (host, bad): the posterior and the chance that its rate is above `limit`.

    Hosts without outcomes (null `bad`) have their domain's posterior mean with the hosts' prior weight.  Rows with a null host are not used.
    """
    # one partial aggregate over the pages; what follows has a row for each host at most
    hosts = outcomes.where("host is not null").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
    hosts = staged(hosts.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "bad"), "host-counts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
    level = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).withColumn("mean", F.lit(((total["bad"] or 0) + 0.5) / ((total["n"] or 0) + 1)))
    for name, below in (("suffix", "domain"), ("domain", "host"), ("host", None)):
        level = staged(level, f"{name}-level")
        weight = level.where("n > 0").agg(prior_weight("n", "bad", "mean").alias("w")).first()["w"]
        level = level.withColumns({"a": F.col("mean") * weight + F.col("bad"), "b": (1 - F.col("mean")) * weight + F.col("n") - F.col("bad")})
        if below:
            parents = level.select(name, (F.col("a") / (F.col("a") + F.col("b"))).alias("mean"))
            keys = ["suffix"] if below == "domain" else ["domain", "suffix"]
            members = hosts.groupBy(below, *keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
            level = members.join(parents, name)
    # no chance of CONFIDENCE without a mean of nearly as much of the limit (Markov), so few integrals are worked out
    mean = F.col("a") / (F.col("a") + F.col("b"))
    chance = F.when(mean >= CONFIDENCE * limit, chance_above(F.col("a"), F.col("b"), limit))
    return level.select("host", "domain", "suffix", "n", "bad", "a", "b", chance.alias("chance"))


def judge(
    pages: DataFrame, outcomes: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", limit: float = LIMIT, confidence: float = CONFIDENCE
) -> DataFrame:
    """id, host, path, rule and verdict of every row of `pages`, with its host's posterior mean of bad pages.

    `outcomes` (url, bad) are labelled pages.  The verdict is that of the longest rule that fits; without one, block if the host's chance of a
    rate of bad pages above `limit` is at least `confidence`, else allow.  Null urls and urls without `://` have an empty host
    and path, fit no rule and are judged as one host; null ids and rows that repeat are judged like any other; outcomes with a null label are
    not counted, a host without labels is judged by its domain; an empty table gives no rows; other columns are not read.
    """
    host, path, url = host_of(F.col(url_col)), path_of(F.col(url_col)), F.col(url_col)
    told = outcomes.select(host_of(F.col("url")).alias("host"), F.col("bad").cast("boolean").alias("bad"))
    known = reputations(told.unionByName(pages.select(host_of(url).alias("host"), F.lit(None).cast("boolean").alias("bad"))), limit)
    known = staged(known.select("host", (F.col("a") / (F.col("a") + F.col("b"))).alias("bad_rate"), "chance"), "reputations")
    read = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), ruled(host, path, rules).alias("r"))
    # hosts: Spark broadcasts them while they are few and splits a hot one beyond
    judged = read.join(known, "host", "left")
    blocked = F.coalesce(F.col("chance") >= confidence, F.lit(False))
    verdict = F.coalesce(F.col("r.verdict"), F.when(blocked, "block").otherwise("allow"))
    return judged.select("id", "host", "path", F.col("r.name").alias("rule"), verdict.alias("verdict"), F.round("bad_rate", 6).alias("bad_rate"))
