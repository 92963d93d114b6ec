"""Hosts, paths, rules and the spread of block decisions over links."""

import random

import pytest
from pyspark.sql import functions as F

from profilerec.llm import urls
from profilerec.llm.components import connected_components

RULES = [urls.Rule("allow", "com", "/"), urls.Rule("block", "bad.org", "/"), urls.Rule("allow", "bad.org", "/ok/"), urls.Rule("block", "x.org", "/p")]


def link(target):
    return f"<HEAD><link href='{target}' class=a rel=canonical></HEAD>"


def test_host_path_and_rules(spark):
    rows = ["http://A.Bad.ORG/q", "http://bad.org/ok/z?x#y", "http://notbad.org/", "http://bad.org", "no scheme", None, "http://x.org/page", "a://b.com/://c"]
    got = urls.filter_urls(spark.createDataFrame([(u, None) for u in rows], "url string, html string"), RULES).collect()
    by = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
    assert by["http://A.Bad.ORG/q"] == ("a.bad.org", "/q", "bad.org/", "block")
    assert by["http://bad.org/ok/z?x#y"] == ("bad.org", "/ok/z", "bad.org/ok/", "allow")
    assert by["http://notbad.org/"] == ("notbad.org", "/", None, "allow")
    assert by["http://bad.org"] == ("bad.org", "", None, "allow")
    assert by["no scheme"] == ("", "", None, "allow") and by[None] == ("", "", None, "allow")
    assert by["http://x.org/page"][2:] == ("x.org/p", "block")
    assert by["a://b.com/://c"] == ("b.com", "/://c", "com/", "allow")


def test_blocks_reach_aliases_but_not_explicitly_allowed_pages(spark):
    pages = [
        ("http://a.net/1", link("http://b.net/1")), ("http://b.net/1#frag", link("http://bad.org/1")), ("http://ok.com/1", link("http://bad.org/1")),
        ("http://c.net/1", "<meta http-equiv=refresh content='0; url=/2'>"), ("http://c.net/2", ""), ("http://c.net/2", ""), ("http://d.net/", None),
    ]
    redirects = spark.createDataFrame([("http://c.net/2", "http://bad.org/9"), (None, "http://d.net/"), ("http://d.net/", "http://d.net/")], "from_url string, to_url string")
    df = spark.createDataFrame(pages, "url string, html string").withColumn("verdict", F.lit("old"))
    got = [(r["url"], r["verdict"]) for r in urls.filter_urls(df, RULES, redirects=redirects).orderBy("url").collect()]
    assert got == [
        ("http://a.net/1", "block"), ("http://b.net/1#frag", "block"), ("http://c.net/1", "block"), ("http://c.net/2", "block"),
        ("http://c.net/2", "block"), ("http://d.net/", "allow"), ("http://ok.com/1", "allow"),
    ]
    assert urls.filter_urls(df.limit(0), RULES).collect() == []
    with pytest.raises(ValueError):
        urls.filter_urls(df, [urls.Rule("deny", "a", "/")])


def test_components_match_union_find(spark):
    random.seed(5)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(180)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (None, 3)]
    edges += [(2000 + i, 2001 + i) for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").collect() == []
