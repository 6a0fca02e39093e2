"""URL filters with redirect equivalence.

A rule is a host suffix and a path prefix with an action. Each url takes the longest rule that fits.
Redirects (``<meta http-equiv="refresh">``) and canonical links (``<link rel="canonical">``) found in the pages, and any
further edges given, make urls aliases of each other: the connected components of the distributed
graph. A url without a rule of its own is blocked if one of its aliases is blocked, unless an alias is
explicitly allowed: allow takes precedence. Without either it has the default verdict.

Nodes of the graph are host, path and query; scheme and fragment don't tell urls apart, and variants of a page
that differ in their query are aliases only where a link says so. Only urls with an
edge enter the graph. Rules are matched by equality of host suffixes with a small literal table.

Cases: a null url, or one without ``://``, has an empty host and path and never fits a rule; relative
link targets are taken from the page's own url; a link target without a host is no edge; repeated rows
are judged one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table
from .components import connected_components

#: (action, host and path).
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)
DEFAULT = "allow"

def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    """The query with its question mark; empty without one."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    return F.concat(host_of(url), path_of(url), query_of(url))


def best_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, action) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,action:string>")
    for action, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "allow", r[1])):  # a later branch goes first
        name, slash, prefix = rule.partition("/")
        name, prefix = name.lower(), slash + prefix
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))).otherwise(found)
    return found


def _attribute(tag: Column, name: str) -> Column:
    """A tag's attribute, quoted or not; empty if it has none."""
    return F.coalesce(*(F.nullif(F.regexp_extract(tag, rf"(?is)[\s\"']{name}\s*=\s*{p}", 1), F.lit("")) for p in (r'"([^"]*)"', r"'([^']*)'", r"([^\s\"'>]+)")), F.lit(""))


def declared_targets(html: Column) -> Column:
    """Targets of the canonical links and refresh redirects of a page."""
    links = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\b[^>]*>"), 0), lambda t: F.lower(_attribute(t, "rel")) == "canonical")
    metas = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), 0), lambda t: F.lower(_attribute(t, "http-equiv")) == "refresh")
    moved = F.transform(metas, lambda t: F.regexp_extract(_attribute(t, "content"), r"(?is)url\s*=\s*['\"]?([^'\"]*)", 1))
    return F.concat(F.transform(links, lambda t: _attribute(t, "href")), moved)


def absolute(target: Column, url: Column) -> Column:
    """A link target as a url; relative ones start from the page's own."""
    target = F.replace(F.trim(target), F.lit("&amp;"), F.lit("&"))
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*/(?:[^?#]*/)?)", 1)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(target.startswith("/"), F.concat(root, target))
        .otherwise(F.concat(F.when(folder == "", F.concat(root, F.lit("/"))).otherwise(folder), target))
    )


def page_edges(pages: DataFrame) -> DataFrame:
    """(source, target): urls and what their pages declare to be the same."""
    found = pages.filter(F.col("html").rlike(r"(?i)canonical|refresh") & F.col("url").contains("://"))
    found = found.select("url", F.explode(F.array_distinct(declared_targets(F.col("html")))).alias("target")).filter(F.trim("target") != "")
    return found.select(F.col("url").alias("source"), absolute(F.col("target"), F.col("url")).alias("target"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, edges: DataFrame | None = None, default: str = DEFAULT) -> DataFrame:
    """Per row of ``pages(page_id, url, html)``: page_id, host, path, rule, verdict, alias_of.

    ``edges(source, target)`` are known redirects beside those that the pages declare. alias_of is the
    smallest host, path and query of the url's component, null if it has no alias.
    """
    known = page_edges(pages)
    if edges is not None:
        known = known.unionByName(edges.select("source", "target"))
    node = {c: node_of(F.col(c)) for c in ("source", "target")}
    known = materialize(
        known.filter((host_of(F.col("source")) != "") & (host_of(F.col("target")) != "")).select(
            *(node[c].alias(n) for c, n in (("source", "a"), ("target", "b")))
        ),
        "aliases",
    )
    members = connected_components(known)
    at = (F.regexp_extract("node", r"(?s)^([^/?]*)", 1), F.regexp_extract("node", r"(?s)^[^/?]*([^?]*)", 1))
    action = best_rule(*at, rules)["action"]
    spread = members.withColumn("action", action).groupBy("component").agg(
        F.coalesce(F.bool_or(F.col("action") == "allow"), F.lit(False)).alias("allowed"),
        F.coalesce(F.bool_or(F.col("action") == "block"), F.lit(False)).alias("blocked"),
    )
    aliases = members.join(spread.withColumnRenamed("component", "c"), F.col("component") == F.col("c")).select("node", "component", "allowed", "blocked")
    judged = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), query_of(F.col("url")).alias("query"))
    judged = judged.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    joined = judged.join(aliases, F.when(F.col("host") != "", F.concat("host", "path", "query")) == F.col("node"), "left")
    passed = F.when(F.col("allowed"), F.lit("allow")).when(F.col("blocked"), F.lit("block")).otherwise(F.lit(default))
    return joined.select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", passed).alias("verdict"), F.col("component").alias("alias_of")
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


_PARTS = r"""translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract({u}, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, regexp_extract({u}, '(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)', 1) AS query"""
OP5_SQL = rf"""
WITH RECURSIVE rules(rule, action) AS (
  VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
named AS (SELECT row_number() OVER () AS nr, page_id, url, html, {_PARTS.format(u="coalesce(url, '')")} FROM pages),
tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS tag FROM named WHERE url LIKE '%://%'),
targets AS (
  SELECT url, regexp_extract(tag, '(?is)\shref\s*=\s*["'']([^"'']*)', 1) AS target FROM tags
  WHERE regexp_matches(tag, '(?is)^<link.*\srel\s*=\s*["'']?canonical["''\s>/]')
  UNION
  SELECT url, regexp_extract(tag, '(?is)\scontent\s*=.*url\s*=\s*[''"]?([^''"]*)', 1) FROM tags
  WHERE regexp_matches(tag, '(?is)^<meta.*\shttp-equiv\s*=\s*["'']?refresh["''\s>/]')),
whole AS (
  SELECT url, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    WHEN target LIKE '//%' THEN 'http:' || target
    WHEN target LIKE '/%' THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || target
    ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*/(?:[^?#]*/)?)', 1) || target END AS target
  FROM (SELECT url, replace(trim(target), '&amp;', '&') AS target FROM targets) WHERE target <> ''),
arcs AS (
  SELECT s.host || s.path || s.query AS a, t.host || t.path || t.query AS b
  FROM (SELECT url, target, {_PARTS.format(u="url")} FROM whole) s JOIN (SELECT url, target, {_PARTS.format(u="target")} FROM whole) t
    ON s.url = t.url AND s.target = t.target
  WHERE s.host <> '' AND t.host <> '' AND s.host || s.path || s.query <> t.host || t.path || t.query),
both_ways AS (SELECT a, b FROM arcs UNION SELECT b, a FROM arcs),
reach(node, other) AS (SELECT a, a FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON r.other = w.a),
fits AS (
  SELECT DISTINCT node, arg_max(action, length(rule)) OVER (PARTITION BY node) AS action
  FROM (SELECT node, regexp_extract(node, '(?s)^([^/?]*)', 1) AS host, regexp_extract(node, '(?s)^[^/?]*([^?]*)', 1) AS path FROM (SELECT DISTINCT node FROM reach)), rules
  WHERE ('.' || host) LIKE '%.' || split_part(rule, '/', 1) AND starts_with(path, substr(rule, strpos(rule, '/')))),
spread AS (
  SELECT r.node, min(r.other) AS alias_of, coalesce(bool_or(f.action = 'allow'), false) AS allowed, coalesce(bool_or(f.action = 'block'), false) AS blocked
  FROM reach r LEFT JOIN fits f ON r.other = f.node GROUP BY r.node),
best AS (
  SELECT nr, max_by(rule, length(rule)) AS rule, max_by(action, length(rule)) AS action FROM named, rules
  WHERE ('.' || host) LIKE '%.' || split_part(rule, '/', 1) AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY nr)
SELECT n.page_id, n.host, n.path, b.rule,
       coalesce(b.action, CASE WHEN s.allowed THEN 'allow' WHEN s.blocked THEN 'block' ELSE 'allow' END) AS verdict, s.alias_of
FROM named n LEFT JOIN best b ON n.nr = b.nr LEFT JOIN spread s ON n.host <> '' AND n.host || n.path || n.query = s.node
"""
