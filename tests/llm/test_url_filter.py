"""Hosts, rules, and the reputation of hosts with outcomes that differ."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfold.llm import url_filter as u
from tallyfold.llm.queries import RULES

URLS = [
    (1, "https://WWW.Example.COM/en/1?x=/es/", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
    (2, "http://example.com/en/", "example.com", "/en/", "example.com/en/", "block"),
    (3, "http://m.example.com/en", "m.example.com", "/en", "com/", "allow"),
    (4, "http://a.example.net/es/1#/fr/", "a.example.net", "/es/1", "net/es/", "block"),
    (5, "http://net/fr/", "net", "/fr/", "net/fr/", "block"),
    (6, "http://example.com", "example.com", "", None, None),
    (7, "http://notexample.com?x", "notexample.com", "", None, None),
    (8, "no scheme/en/", "", "", None, None),
    (9, None, "", "", None, None),
    (10, "http://xnet/es/", "xnet", "/es/", None, None),
    (None, "x://a.com/://b.net/es/", "a.com", "/://b.net/es/", "com/", "allow"),
    (11, "http://É.COM:80/\nq", "É.com:80", "/\nq", None, None),
]


def test_hosts_paths_and_rules(spark):
    more = "host string, path string, rule string, verdict string, n int, bad int"
    rows = [(i, url, "h", "p", "r", "v", 1, 2) for i, url, *_ in URLS]
    pages = spark.createDataFrame(rows, f"page_id long, url string, {more}")
    none = spark.createDataFrame([], "url string, bad boolean")
    got = {(r.id, r.host, r.path, r.rule, r.verdict) for r in u.judge(pages, none, RULES).collect()}
    assert got == {(i, host, path, rule, verdict or "allow") for i, _, host, path, rule, verdict in URLS}
    assert u.judge(pages.where("false"), none, RULES).count() == 0
    assert u.judge(pages.union(pages), none, RULES).count() == 2 * len(URLS)


def test_domains(spark):
    hosts = {"a.b.example.com": ("com", "example.com"), "x.co.uk": ("co.uk", "x.co.uk"), "w.x.co.uk:80": ("co.uk", "x.co.uk"), "co.uk": ("uk", "co.uk"), "localhost": ("localhost", "localhost"), "10.0.0.1:8": ("", "10.0.0.1:8"), "[::1]:8": ("", "[::1]:8"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    got = {r[0]: (r[1], r[2]) for r in df.select("host", u.suffix_of(F.col("host")), u.domain_of(F.col("host"))).collect()}
    assert got == hosts


def binomial_tail(a, b, x):
    """P(beta(a, b) > x) for whole a, b."""
    n = a + b - 1
    return sum(math.comb(n, k) * x**k * (1 - x) ** (n - k) for k in range(a))


def test_chance_above(spark):
    whole = [(1, 1), (1, 30), (30, 1), (12, 5), (300, 280), (40, 900), (2, 2)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in whole], "a double, b double")
    for limit in (0.1, 0.5, 0.52):
        got = {(r[0], r[1]): r[2] for r in df.select("a", "b", u.chance_above(F.col("a"), F.col("b"), limit)).collect()}
        assert all(got[a, b] == pytest.approx(binomial_tail(a, b, limit), abs=1e-6) for a, b in whole)
    # fractions, against a fine sum over draws of two gammas
    rng = np.random.default_rng(1)
    x, y = rng.gamma(0.3, size=400_000), rng.gamma(2.7, size=400_000)
    got = spark.range(1).select(u.chance_above(F.lit(0.3), F.lit(2.7), 0.2)).first()[0]
    assert got == pytest.approx(float((x / (x + y) > 0.2).mean()), abs=0.004)


def test_hosts_are_told_apart_and_small_ones_lean_on_their_domain(spark):
    rng, rows = np.random.default_rng(2), []

    def host(name, n, rate):
        rows.extend((f"http://{name}/x", bool(b)) for b in rng.random(n) < rate)

    for k in range(60):
        host(f"h{k}.fine{k % 12}.org", 40, 0.05)
    for k in range(20):
        host(f"h{k}.farm.org", 40, 0.9)
    host("new.farm.org", 1, 0.0)
    host("one.fine1.org", 1, 1.0)
    host("bad.fine2.org", 60, 0.95)
    outcomes = spark.createDataFrame(rows + [("http://h1.fine1.org/", None)], "url string, bad boolean")
    pages = outcomes.select("url").distinct().union(spark.createDataFrame([("http://unseen.farm.org/",), ("http://unseen.fine3.org/",)], "url string")).withColumn("page_id", F.monotonically_increasing_id())
    got = {r.host: r for r in u.judge(pages, outcomes, []).collect()}
    assert all(got[f"h{k}.farm.org"].verdict == "block" for k in range(20))
    assert all(got[f"h{k}.fine{k % 12}.org"].verdict == "allow" for k in range(60))
    assert got["bad.fine2.org"].verdict == "block" and got["one.fine1.org"].verdict == "allow"
    assert got["unseen.farm.org"].bad_rate > 0.5 > got["unseen.fine3.org"].bad_rate
    assert got["new.farm.org"].bad_rate > 0.5
