"""URL filter with redirect equivalence: rules decide, and what they block spreads to aliases of the same page.

Every address is judged by its longest fitting rule. Addresses are linked by redirects: those of a given table, the canonical
links and refreshes inside pages, and the usual ones of servers (http to https, `www.`, default ports, trailing slashes and
tracking parameters go). Connected components of these links are aliases of one page. An address without a rule is blocked if a
rule blocks one of its aliases and no rule allows one: an explicit allow takes precedence. Without either it is allowed. Targets
that are no page themselves are judged and spread their verdict too.

The components are found by DataFrame joins alone (`connected`): a round replaces each node's links by links to its smallest
neighbour (small star) and then lets what points to a node point to that node's smallest neighbour (large star), so the depth of
the links shrinks by about half each time, until every node points to its root. Minima are aggregated before any shuffle; a
hub's rows meet only in joins with one row on the other side, which Spark's adaptive skew join splits.

Rules are a list, compiled into one projection, or a table (host, path, verdict) of any size, which meets the distinct hosts
by their parent domains. Of rules that are equally long the allowing one wins, then the lower text.

A null url, or one without `://`, has an empty host and path, no rule and no alias but equal urls without a fragment; null urls have none. Empty
and very long urls and pages are ordinary: patterns read a page once and never past a tag. Repeated rows are judged alike, repeated
ids are kept. Missing or null html has no links. An empty table gives an empty result. Other columns, whatever their names, are ignored.
"""
from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .store import written

#: (verdict, host, path) of the registered query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SCHEME, PARTS = "(?s)^(.*?)://", "(?s)^.*?://([^/?#]*)([^?#]*)"
LINK = r"(?i)<link\s[^<>]*\brel\s*=\s*[\"']?canonical\b[^<>]*>"
REFRESH = r"(?i)<meta\s[^<>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^<>]*>"
HREF, TARGET = r"(?i)\bhref\s*=\s*[\"']?\s*([^\"'\s<>]+)", r"(?i)\burl\s*=\s*[\"']?\s*([^\"'\s<>;]+)"
TRACKING = r"(^|&)(utm_[a-z]+|gclid|fbclid)=[^&]*"


def lower_ascii(x: Column) -> Column:
    return F.translate(x, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    """A rule fits its host and all subdomains, where the path starts with the rule's."""
    return ((host == rule_host) | F.endswith(host, F.concat(F.lit("."), rule_host))) & F.startswith(path, rule_path)


def ruled(urls: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """urls (with host and path) and their rule and its verdict, both null without one."""
    if isinstance(rules, DataFrame):
        return _ruled_by_table(urls, rules)
    host, path = F.col("host"), F.col("path")
    best = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1] + r[2]))
    pick = lambda value: F.coalesce(F.lit(None).cast("string"), *[F.when(fits(host, path, F.lit(h), F.lit(p)), F.lit(value((v, h, p)))) for v, h, p in best])
    return urls.withColumns({"rule": pick(lambda r: r[1] + r[2]), "by_rule": pick(lambda r: r[0])})


def _ruled_by_table(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules of a host are found once for each distinct host, by equality with the host and each parent domain."""
    hosts = urls.select("host").distinct()
    labels = F.split("host", "[.]")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    at = hosts.withColumn("domain", F.explode(parents))
    text = F.concat("host", "path")
    rule = rules.select(F.col("host").alias("domain"), F.struct((-F.length(text)).alias("size"), (F.col("verdict") != "allow").alias("late"), text.alias("rule"), F.col("path").alias("start"), "verdict").alias("r"))
    own = at.join(rule, "domain").groupBy("host").agg(F.sort_array(F.collect_set("r")).alias("rules"))
    best = F.filter("rules", lambda r: F.startswith(F.col("path"), r["start"]))[0]
    j = urls.join(own, "host", "left").withColumn("_best", F.when(F.exists("rules", lambda r: F.startswith(F.col("path"), r["start"])), best))
    return j.select(*[urls[c] for c in urls.columns], F.col("_best.rule").alias("rule"), F.col("_best.verdict").alias("by_rule"))


def address(url: Column) -> Column:
    """url without its fragment, with scheme and host in lower case."""
    rest = F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^#]*)", 1)
    full = F.concat(lower_ascii(F.regexp_extract(url, SCHEME, 1)), F.lit("://"), host_of(url), rest)
    return F.when(F.contains(url, F.lit("://")), full).otherwise(F.regexp_replace(url, "(?s)#.*$", ""))


def usual(url: Column) -> Column:
    """Where servers usually redirect an address to: https, no `www.`, default port, trailing slash or tracking parameter."""
    host = F.regexp_replace(host_of(url), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    query = F.regexp_replace(F.regexp_replace(query, TRACKING, ""), "^&", "")
    web = F.regexp_extract(url, SCHEME, 1).isin("http", "https")
    return F.when(web, F.concat(F.lit("https://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def resolved(target: Column, base: Column) -> Column:
    """The address that a link in the page `base` leads to; null where it leads nowhere else."""
    t = F.replace(target, F.lit("&amp;"), F.lit("&"))
    scheme, host = F.regexp_extract(base, SCHEME, 1), host_of(base)
    top = F.concat(scheme, F.lit("://"), host)
    full = (F.when(t.rlike("(?i)^[a-z][a-z0-9+.-]*://"), t).when(F.startswith(t, F.lit("//")), F.concat(scheme, F.lit(":"), t))
            .when(F.startswith(t, F.lit("/")), F.concat(top, t)).when((t == "") | t.rlike("^[#?]|^[a-zA-Z][a-zA-Z0-9+.-]*:"), None)
            .otherwise(F.concat(top, F.regexp_replace(path_of(base), "[^/]*$", ""), F.when(F.endswith(path_of(base), F.lit("/")) | F.contains(path_of(base), F.lit("/")), "").otherwise("/"), t)))
    return F.when(F.contains(base, F.lit("://")), address(full))


def links_of(pages: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """src and dst of all links between addresses: canonical links, refreshes, the usual redirects and given ones (src, dst)."""
    html = F.coalesce(F.col("html"), F.lit("")) if "html" in pages.columns else F.lit("")
    inside = pages.select(address(F.col("url")).alias("src"), F.regexp_extract(F.regexp_extract(html, LINK, 0), HREF, 1).alias("a"),
                          F.regexp_extract(F.regexp_extract(html, REFRESH, 0), TARGET, 1).alias("b"))
    target = F.explode(F.array(*[F.when(F.col(c) != "", resolved(F.col(c), F.col("src"))) for c in "ab"]))
    # A link's text is rare; without one a page only sends its address.
    given = inside.select("src", target.alias("dst"))
    if redirects is not None:
        given = given.union(redirects.select(address(F.col("src")), address(F.col("dst"))))
    given = written(given.where("src <> dst").distinct(), "links")
    every = inside.select("src").union(given.select("dst")).union(given.select("src")).where("src IS NOT NULL").distinct()
    plain = every.select("src", usual(F.col("src")).alias("dst")).where("src <> dst")
    return written(given.union(plain).distinct(), "links")


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node connected to it) for the nodes of edges (a, b) that have a smaller one."""
    link = written(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct(), "edges")
    while True:
        low = lambda e: e.groupBy("hi").agg(F.min("lo").alias("low"))
        least = written(low(link), "least")
        small = link.join(least, "hi").where("lo <> low").select(F.col("lo").alias("hi"), F.col("low").alias("lo"))
        star = written(small.withColumn("moved", F.lit(True)).union(least.select("hi", "low", F.lit(False).alias("moved"))), "small")
        flat = star.select("hi", "lo").distinct()
        above = low(flat).select(F.col("hi").alias("lo"), "low")
        link = written(flat.join(above, "lo", "left").select("hi", F.coalesce("low", "lo").alias("lo"), F.col("low").isNotNull().alias("moved")).distinct(), "large")
        if star.where("moved").isEmpty() and link.where("moved").isEmpty():
            return link.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        link = link.select("hi", "lo").distinct()


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule (null without one), verdict (allow or block), source of the verdict (rule, alias or default)."""
    links = links_of(pages, redirects)
    node = F.md5("address")
    own = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address(F.col("url")).alias("address"))
    judged = written(ruled(own, rules).withColumn("node", node).drop("address"), "judged")
    # Targets that are no page are judged by their address.
    ends = links.select(F.explode(F.array("src", "dst")).alias("address")).distinct()
    more = ruled(ends.select("address", host_of(F.col("address")).alias("host"), path_of(F.col("address")).alias("path")), rules).select(node.alias("node"), "by_rule")
    said = judged.select("node", "by_rule").union(more).where("by_rule IS NOT NULL").groupBy("node").agg(F.bool_or(F.col("by_rule") == "block").alias("bad"), F.bool_or(F.col("by_rule") == "allow").alias("good"))
    roots = connected(links.select(F.md5("src").alias("a"), F.md5("dst").alias("b")))
    of_root = lambda d: d.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    bad = of_root(said).groupBy("root").agg(F.bool_or("bad").alias("bad"), F.bool_or("good").alias("good")).where("bad AND NOT good").select("root")
    everyone = roots.select("node", "root").union(bad.select(F.col("root").alias("node"), "root"))
    blocked = written(everyone.join(bad, "root", "left_semi").select("node").distinct().withColumn("alias", F.lit(True)), "blocked")
    j = judged.join(blocked, "node", "left")
    verdict = F.coalesce("by_rule", F.when(F.col("alias"), "block").otherwise("allow"))
    source = F.when(F.col("by_rule").isNotNull(), "rule").when(F.col("alias"), "alias").otherwise("default")
    return j.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), source.alias("source"))


def op12(spark, sf_dir: str) -> DataFrame:
    return url_verdicts(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict")


def _sql_lower(x: str) -> str:
    return f"translate({x}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


_HOST, _PATH = _sql_lower(f"regexp_extract({{0}}, '{PARTS}', 1)"), f"regexp_extract({{0}}, '{PARTS}', 2)"
_FIT = "({0}host = '{1}' OR ends_with({0}host, '.{1}')) AND starts_with({0}path, '{2}')"
_BEST = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
_Q = "'".join(["", "", ""])  # a quote inside an SQL text


def _rule(value) -> str:
    return "CASE " + " ".join(f"WHEN {_FIT.format('', h, p)} THEN '{value((v, h, p))}'" for v, h, p in _BEST) + " END"


def _text(pattern: str) -> str:
    return "'" + pattern.replace("'", _Q) + "'"


_ADDRESS = f"CASE WHEN contains({{0}}, '://') THEN {_sql_lower(f'regexp_extract({{0}}, {_text(SCHEME)}, 1)')} || '://' || {_HOST} || regexp_extract({{0}}, '(?s)^.*?://[^/?#]*([^#]*)', 1) ELSE regexp_replace({{0}}, '(?s)#.*$', '') END"
_QUERY = r"regexp_replace(regexp_replace(regexp_extract(src, '(?s)^[^?#]*\?([^#]*)', 1), '" + TRACKING + "', '', 'g'), '^&', '')"
_USUAL = f"CASE WHEN regexp_extract(src, {_text(SCHEME)}, 1) IN ('http', 'https') THEN 'https://' || regexp_replace({_HOST.format('src')}, '^www[.]|:(80|443)$', '', 'g') || regexp_replace({_PATH.format('src')}, '/+$', '') || CASE WHEN {_QUERY} <> '' THEN '?' || {_QUERY} ELSE '' END END"
_TOP = f"regexp_extract(src, {_text(SCHEME)}, 1) || '://' || {_HOST.format('src')}"
_FULL = f"""CASE WHEN regexp_matches(t, '(?i)^[a-z][a-z0-9+.-]*://') THEN t WHEN starts_with(t, '//') THEN regexp_extract(src, {_text(SCHEME)}, 1) || ':' || t WHEN starts_with(t, '/') THEN {_TOP} || t
  WHEN regexp_matches(t, '^[#?]|^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL ELSE {_TOP} || regexp_replace({_PATH.format('src')}, '[^/]*$', '') || CASE WHEN contains({_PATH.format('src')}, '/') THEN '' ELSE '/' END || t END"""
OP12_SQL = f"""
WITH RECURSIVE p AS (SELECT page_id, {_HOST.format("coalesce(url, '')")} AS host, {_PATH.format("coalesce(url, '')")} AS path, {_ADDRESS.format('url')} AS src, coalesce(html, '') AS html FROM pages),
f AS (SELECT src, replace(unnest([regexp_extract(regexp_extract(html, {_text(LINK)}, 0), {_text(HREF)}, 1), regexp_extract(regexp_extract(html, {_text(REFRESH)}, 0), {_text(TARGET)}, 1)]), '&amp;', '&') AS t FROM p),
g AS (SELECT src, {_FULL} AS dst FROM f WHERE t <> '' AND contains(src, '://')),
given AS (SELECT DISTINCT src, dst FROM (SELECT src, {_ADDRESS.format('dst')} AS dst FROM g) WHERE src <> dst),
every AS (SELECT src FROM p WHERE src IS NOT NULL UNION SELECT dst FROM given),
links AS (SELECT * FROM given UNION SELECT src, {_USUAL} FROM every WHERE src <> {_USUAL}),
either AS (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links),
nodes AS (SELECT src AS x FROM every UNION SELECT dst FROM links),
reach AS (SELECT x, x AS y FROM nodes UNION SELECT reach.x, either.b FROM reach JOIN either ON either.a = reach.y),
said AS (SELECT x AS y, {_rule(lambda r: r[0])} AS v FROM (SELECT x, {_HOST.format('x')} AS host, {_PATH.format('x')} AS path FROM nodes)),
spread AS (SELECT reach.x, bool_or(v = 'block') AND NOT bool_or(v = 'allow') AS bad FROM reach JOIN said USING (y) WHERE v IS NOT NULL GROUP BY reach.x)
SELECT page_id, host, path, {_rule(lambda r: r[1] + r[2])} AS rule, coalesce({_rule(lambda r: r[0])}, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM p LEFT JOIN spread ON spread.x = p.src
"""
