"""URL verdicts: contract by hand, components against union-find, spread over aliases against brute force."""
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tickloom.llm import url_filter as u

SCHEMA = "page_id long, url string, html string"


def verdicts(spark, rows, **kw):
    d = spark.createDataFrame(rows, SCHEMA)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in u.url_verdicts(d, **kw).collect()}


CONTRACT = [
    (1, "http://WWW.Example.NET/en/5?x=1#top", None, ("www.example.net", "/en/5", "example.net/en/", "allow")),
    (2, "https://a.example.net/fr/1", "", ("a.example.net", "/fr/1", "net/", "block")),
    (3, "https://a.example.com/de/1/", "<p>", ("a.example.com", "/de/1/", "example.com/de/", "block")),
    (4, "https://notexample.com/de/1", None, ("notexample.com", "/de/1", None, "allow")),
    (5, "https://x.org/fr/2.html", None, ("x.org", "/fr/2.html", "org/fr/", "allow")),
    (6, "https://x.org/de", None, ("x.org", "/de", None, "allow")),
    (7, "net/en/", None, ("", "", None, "allow")),
    (8, None, None, ("", "", None, "allow")),
    (9, "", None, ("", "", None, "allow")),
    (10, "https://a.net?q=http://b.org/fr/", None, ("a.net", "", None, "allow")),
    (11, "x://y://z/w", None, ("y:", "//z/w", None, "allow")),
    (12, "https://ÄB.Net/ok", None, ("Äb.net", "/ok", "net/", "block")),
    (13, "https://net/" + "a" * 100_000, "<link " * 50_000 + "é", ("net", "/" + "a" * 100_000, "net/", "block")),
    (None, "https://net/x", None, ("net", "/x", "net/", "block")),
]


def test_contract(spark):
    assert verdicts(spark, [c[:3] for c in CONTRACT]) == {c[0]: c[3] for c in CONTRACT}


def test_equals_sql(spark, tmp_path):
    rows = [c[:3] for c in CONTRACT] + LINKED + LINKED[:3]
    spark.createDataFrame(rows, SCHEMA).withColumn("rule", F.lit("x")).withColumn("host", F.lit(1)).coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = u.op12(spark, str(tmp_path))
    assert got.columns == ["page_id", "host", "path", "rule", "verdict"]
    want = con.execute(f"SELECT page_id, host, path, rule, verdict FROM ({u.OP12_SQL})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


LINKED = [
    (21, "http://a.org/x", '<head><LINK href="/y" rel=canonical></head>'),  # blocked through two steps
    (22, "https://a.org/y/", '<meta http-equiv="Refresh" content="0; URL=https://bad.net/z">'),
    (23, "https://www.a.org/y?utm_source=feed", None),
    (24, "https://b.org/q", "<link rel='canonical' href='https://bad.net/z2'>"),  # blocked, but an alias is allowed
    (25, "https://b.org/fr/q", "<link href='../q' rel='x'><link rel='canonical' href='//b.org/q'>"),
    (26, "https://c.org/fr/1", "<link rel=canonical href=https://bad.net/z>"),  # its own rule allows it; takes the block off its aliases
    (27, "https://d.org/r/s", "<link rel=canonical href=t?a=1&amp;b=2#f>"),
    (28, "https://d.org/r/t?a=1&b=2", "<meta content='5;url=HTTPS://E.example.com/de/9' http-equiv=refresh>"),
    (29, "https://f.org", "<link rel=canonical href=mailto:me@bad.net><link rel=canonical href=#x>"),
]


def test_aliases(spark):
    one = {k: v[3] for k, v in verdicts(spark, LINKED[:3]).items()}
    assert one == {21: "block", 22: "block", 23: "block"}
    two = {k: v[3] for k, v in verdicts(spark, LINKED).items()}
    assert two == {21: "allow", 22: "allow", 23: "allow", 24: "allow", 25: "allow", 26: "allow", 27: "block", 28: "block", 29: "allow"}
    moved = spark.createDataFrame([("https://f.org#a", "http://bad.net/w"), ("https://f.org", None), (None, "https://g.org/")], "src string, dst string")
    assert verdicts(spark, LINKED, redirects=moved)[29][3] == "block"


def test_rule_tables(spark):
    table = spark.createDataFrame([(v, h, p) for v, h, p in u.RULES], "verdict string, host string, path string")
    urls = spark.createDataFrame([(f"{a}{b}.{c}", p) for a in ("", "www.") for b in ("example", "x") for c in ("net", "com", "org") for p in ("", "/", "/de/1", "/en/", "/fr/x", "/e")], "host string, path string")
    both = [sorted(map(repr, u.ruled(urls, r).collect())) for r in (u.RULES, table)]
    assert both[0] == both[1]
    ties = spark.createDataFrame([("block", "a.org", "/b/"), ("allow", "a.org", "/b/")], "verdict string, host string, path string")
    for r in (ties, [tuple(x) for x in ties.collect()]):
        assert u.ruled(spark.createDataFrame([("a.org", "/b/c")], "host string, path string"), r).first()["by_rule"] == "allow"


@pytest.mark.parametrize("kind", ["random", "path", "hub", "hub last"])
def test_components(spark, kind):
    rng = random.Random(3)
    names = [f"{rng.random():.9f}" for _ in range(120)]
    if kind == "random":
        edges = [(rng.choice(names), rng.choice(names)) for _ in range(80)]
    elif kind == "path":
        edges = list(zip(names, names[1:]))
    else:
        hub = min(names) if kind == "hub" else max(names)
        edges = [(hub, n) if rng.random() < 0.5 else (n, hub) for n in names[:90]] + edges_of(rng, names[90:])
    up = {n: n for n in names}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    got = {r["node"]: r["root"] for r in u.connected(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: root(n) for n in names if root(n) != n}


def edges_of(rng, names):
    return [(rng.choice(names), rng.choice(names)) for _ in range(20)]


def test_empty(spark):
    assert verdicts(spark, []) == {}
