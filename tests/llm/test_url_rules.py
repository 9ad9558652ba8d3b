"""URL parts, explicit rules and association rules against plain versions."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from regatta.llm import queries, url_rules

LOWER = str.maketrans(url_rules.UPPER, url_rules.LOWER)
URLS = [
    None, "", "no scheme/x", "http://", "://h", "HTTP://WWW.Example.COM/en/1?x=1#y", "http://a.com", "http://com/",
    "http://xcom/", "ftp://é.net/es/É?#", "http://b.net/es/1/2//33", "http://b.net/fr?q&&r=1=2&=z", "x://a://b/c",
    "http://net/fr/", "http://a.example.com/en/", "http://www.example.com/en", "http://a.b.org/es/77#t?u", "http://o.org?",
    "http://m.org/" + "p/" * 50, "http://x.example.com/EN/", "http://www.example.com./en/", "http://u@c.com:80/a",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return host.translate(LOWER), path


def tokens(url):
    if url is None or "://" not in url:
        return set()
    scheme, rest = url.split("://", 1)
    host, path = parts(url)
    m = re.match(r"[^?#]*\?([^#]*)", rest)
    out = {("s", scheme.translate(LOWER)), ("t", host.split(".")[-1])}
    out |= {("h", x) for x in host.split(".")}
    out |= {("p", x) for x in re.sub("[0-9]+", "#", path).split("/")}
    out |= {("q", x.split("=")[0]) for x in (m[1] if m else "").split("&")}
    return {f"{a}:{b}" for a, b in out if b} | ({"f:"} if "#" in rest else set())


def explicit(url, rules):
    host, path = parts(url)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (len(r.host + r.path), r.host + r.path), default=None)
    return best


def brute(urls, rules, support, confidence, default="allow"):
    marked = [(tokens(u), explicit(u, rules)) for u in urls]
    known = [(t, r.verdict) for t, r in marked if r and t]
    counts, both = {}, {}
    for t, verdict in known:
        for n in range(1, len(t) + 1):
            for s in itertools.combinations(sorted(t), n):
                counts[s] = counts.get(s, 0) + 1
                both[s, verdict] = both.get((s, verdict), 0) + 1
    found = sorted(
        (-n / counts[s], -n, len(s), s, v) for (s, v), n in both.items()
        if n >= support * len(known) and n / counts[s] >= confidence
    )
    out = []
    for t, r in marked:
        best = next((f[4] for f in found if set(f[3]) <= t), default)
        out.append(r.verdict if r else best)
    return out


def test_parts_and_tokens(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    u = F.col("url")
    for r in df.select("url", url_rules.host_of(u).alias("h"), url_rules.path_of(u).alias("p"), url_rules.tokens_of(u).alias("t")).collect():
        assert (r.h, r.p) == parts(r.url)
        assert set(r.t) == tokens(r.url) and len(r.t) == len(set(r.t))


@pytest.mark.parametrize("block", [500, 2])
def test_judge_equals_plain_mining(spark, monkeypatch, block):
    monkeypatch.setattr(url_rules.matched, "__defaults__", (block,))
    urls = [u for u in URLS if not u or len(u) < 60] * 2 + [
        f"http://{h}.example.{t}/{p}/{i}" for i, (h, t, p) in enumerate(itertools.product(
            ["www", "m", "spam"], ["com", "net", "org"], ["en", "es", "fr"]))
    ]
    df = spark.createDataFrame([(i % 9, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = url_rules.judge(df.withColumn("n", F.monotonically_increasing_id()).repartition(3), queries.URL_RULES, min_support=0.1)
    rows = got.orderBy("n").collect()
    assert [(r.host, r.path) for r in rows] == [parts(u) for u in urls]
    rules = [explicit(u, queries.URL_RULES) for u in urls]
    assert [r.rule for r in rows] == [x and x.host + x.path for x in rules]
    assert [r.verdict for r in rows] == brute(urls, queries.URL_RULES, 0.1, 0.8)


def test_nothing_labelled(spark):
    df = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id long, url string")
    for rules in ([], queries.URL_RULES):
        assert [(r.rule, r.verdict) for r in url_rules.judge(df, rules).collect()] == [(None, "allow")] * 2
    assert url_rules.judge(df.limit(0), queries.URL_RULES).collect() == []


def test_pruned_rules_never_decide(spark):
    df = spark.createDataFrame(
        [(["a", "b"], "block"), (["a"], "block"), (["b"], "allow"), (["b", "c"], "allow"), ([], "allow"), (["a"], None)],
        "tokens array<string>, label string",
    )
    found = url_rules.mine(df, 0.1, 0.6)
    assert [(r.tokens, r.label) for r in found] == [(("a",), "block"), (("c",), "allow"), (("b",), "allow")]


def test_columns_of_any_name_stay(spark):
    names = ["rule_verdict", "_tokens", "tokens", "url", "row", "a.b", "label"]
    long = "http://example.com/en/" + "x/" * 50_000
    df = spark.createDataFrame(
        [(u, "old", *names) for u in (long, None, long)], ["at", "verdict", *names])
    found = url_rules.judge(df, queries.URL_RULES, url_col="at")
    assert found.columns == ["at", *names, "host", "path", "rule", "verdict"]
    got = found.collect()
    assert sorted((r["at"] or "", r["verdict"]) for r in got) == [("", "allow"), (long, "block"), (long, "block")]
    assert all([r[n] for n in names] == names for r in got)
