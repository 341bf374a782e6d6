"""URL block lists that follow redirects (DataFrame operations only).

A page's own rule decides first: rules are pairs of host and path prefix, a rule fits its
host and all subdomains, and of those that fit the longest wins. Rules are looked up by
equality, never by comparing every page with every rule: a page asks for each pair of a
suffix of its host and a prefix of its path that a rule may have.

Pages without a rule take the method's verdict. Redirects (all meta refresh tags, or a table
of them) and all canonical links are edges between addresses; a relative target is resolved
against its page's address, ``&amp;`` in it is ``&``, and a target of another scheme without
``://`` is no address. Connected components of those edges are addresses of one document. A component is blocked if a rule blocks one of its
addresses, unless a rule explicitly allows another: an allow takes precedence. Addresses
that no rule reaches are allowed.

Addresses are compared without fragment, with the scheme and host in lower case and
without a slash at the end. A null address, or one without ``://``, has an empty host and
path, no rule and no alias, and is allowed. Null html has no links. Repeated rows get
equal results. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from cairn.operators.components import connected_components
from cairn.plans.durable import Scratch

#: (verdict, host, path prefix)
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
_TAG = r"(?i)<(?:link|meta)\b[^>]*>"
_CANONICAL = r"""(?i)^<link\b[^>]*\brel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical(?:[\s>]|/>))"""
_REFRESH = r"""(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b"""
_HREF = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""
_URL = r"""(?i)\burl\s*=\s*["']?([^"'\s>]+)"""


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _host(url: Column) -> Column:
    return _ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def _path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """The form in which addresses are compared; null where there is none."""
    whole = F.regexp_replace(F.regexp_extract(url, r"(?s)^(.*?://[^#]*)", 1), r"/+$", "")
    scheme = F.substring_index(whole, "://", 1)
    rest = F.regexp_extract(whole, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.when(whole.contains("://"), F.concat(F.lower(scheme), F.lit("://"), _host(whole), rest))


def rule_table(spark, rules=None) -> DataFrame:
    rows = [{"verdict": v, "rule_host": h, "rule_path": p} for v, h, p in (RULES if rules is None else rules)]
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<verdict string, rule_host string, rule_path string>>")))


def _without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` steps."""
    steps = F.split(path, "/")
    last = F.element_at(steps, -1)
    walked = F.aggregate(steps, F.array().cast("array<string>"), lambda so, x: F.when(x == ".", so).when(x == "..", F.slice(so, 1, F.greatest(F.size(so) - 1, F.lit(1)))).otherwise(F.concat(so, F.array(x))))
    return F.concat(F.array_join(walked, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))


def resolved(base: Column, target: Column) -> Column:
    """A link's target as a whole address; null if it leads nowhere else."""
    to = F.replace(target, F.lit("&amp;"), F.lit("&"))
    origin = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    at = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    path, rest = F.regexp_extract(to, r"^([^?#]*)", 1), F.regexp_extract(to, r"^[^?#]*(.*)$", 1)
    folder = F.when(at == "", "/").otherwise(F.regexp_extract(at, r"(?s)^(.*/)", 1))
    return (
        F.when(to.contains("://") & to.rlike(r"(?i)^[a-z][a-z0-9+.\-]*://"), to)
        .when(to.startswith("//"), F.concat(F.substring_index(base, "://", 1), F.lit(":"), to))
        .when(to.startswith("#") | to.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:"), None)
        .when(to.startswith("?"), F.concat(origin, at, to))
        .otherwise(F.concat(origin, _without_dots(F.when(path.startswith("/"), path).otherwise(F.concat(folder, path))), rest))
    )


def link_edges(pages: DataFrame) -> DataFrame:
    """``(from_url, to_url)``: each page and all that it names as canonical or refreshes to, as whole addresses."""
    found = pages.where("html is not null and contains(url, '://')").where(F.col("html").rlike("(?i)canonical|http-equiv"))
    tags = F.filter(F.regexp_extract_all("html", F.lit(_TAG), 0), lambda t: t.rlike(_CANONICAL) | t.rlike(_REFRESH))
    to = F.transform(tags, lambda t: F.when(t.rlike(_CANONICAL), F.regexp_extract(t, _HREF, 1)).otherwise(F.regexp_extract(t, _URL, 1)))
    each = found.select("url", F.explode(to).alias("to")).where("to <> ''")
    return each.select(F.col("url").alias("from_url"), resolved(F.col("url"), F.col("to")).alias("to_url")).where("to_url is not null")


def with_rule(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``rule`` and ``verdict`` (null where none fits) to rows with ``host`` and ``path``.

    ``urls`` must have distinct ``(host, path)``. Only the path lengths and label counts that
    rules have are tried, so a long path makes no more rows than a short one.
    """
    shape = rules.agg(F.collect_set(F.length("rule_path")).alias("ls"), F.collect_set(F.size(F.split("rule_host", r"\."))).alias("ns")).first()  # distinct lengths: few
    tried = F.array([F.struct(F.substring_index("host", ".", -n).alias("rule_host"), F.substring("path", 1, k).alias("rule_path")) for n in shape["ns"] for k in shape["ls"]]) if shape["ls"] else F.expr("cast(array() as array<struct<rule_host string, rule_path string>>)")
    named = F.concat("rule_host", "rule_path")
    hits = (
        urls.select("host", "path", F.explode(F.array_distinct(tried)).alias("k")).select("host", "path", "k.*")
        .join(rules, ["rule_host", "rule_path"])
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length(named), F.col("verdict") == "allow", named.alias("rule"), "verdict")).alias("best"))
    )
    return urls.join(hits, ["host", "path"], "left").select(*urls.columns, F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))


def judge_urls(pages: DataFrame, rules: DataFrame | None = None, redirects: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, via)``; via: rule, alias or default.

    redirects: optional ``(from_url, to_url)``.
    """
    spark = pages.sparkSession
    rules = rule_table(spark) if rules is None else rules
    scratch = Scratch(spark, "url-filter")
    judged = pages.select("page_id", "url", _host(F.col("url")).alias("host"), _path(F.col("url")).alias("path"), address(F.col("url")).alias("address"))
    tried = with_rule(judged.select("host", "path").distinct(), rules)
    pages_ruled = judged.join(tried, ["host", "path"], "left")
    links = link_edges(pages)
    if redirects is not None:
        links = links.union(redirects.select("from_url", "to_url"))
    links = scratch.keep(links.select("from_url", "to_url", address(F.col("from_url")).alias("src"), address(F.col("to_url")).alias("dst")).where("src is not null and dst is not null"), "links")
    parts = connected_components(links, "src", "dst", scratch)
    # rules judge addresses as they are written: what makes two of them equal may take a slash from their end
    named = links.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("from_url").alias("url")), F.struct(F.col("dst").alias("node"), F.col("to_url").alias("url")))).alias("n")).select("n.node", _host(F.col("n.url")).alias("host"), _path(F.col("n.url")).alias("path")).distinct()
    ends = parts.join(named, "node")
    said = ends.join(with_rule(ends.select("host", "path").distinct(), rules), ["host", "path"]).groupBy("component").agg(F.max(F.col("verdict") == "allow").alias("allows"), F.max(F.col("verdict") == "block").alias("blocks"))
    alias = parts.join(said.where("blocks and not coalesce(allows, false)"), "component").select(F.col("node").alias("address"), F.lit(True).alias("aliased"))
    # pages without an address have no alias, however many they are
    met = pages_ruled.where("address is not null").join(alias, "address", "left").unionByName(pages_ruled.where("address is null").withColumn("aliased", F.lit(None).cast("boolean")))
    return met.select(
        "page_id", "host", "path", "rule",
        F.coalesce("verdict", F.when(F.col("aliased"), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("rule").isNotNull(), "rule").when(F.col("aliased"), "alias").otherwise("default").alias("via"),
    )


SQL = r"""
WITH RECURSIVE rules(verdict, rh, rp) AS (VALUES ('block','com','/en/'), ('allow','example.com','/en/7'), ('allow','net','/de/'), ('block','example.net','/de/8'), ('block','org','/es/')),
p AS (SELECT page_id, url, html,
        CASE WHEN contains(url, '://') THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
        CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path,
        CASE WHEN contains(url, '://') THEN lower(split_part(regexp_replace(regexp_extract(url, '(?s)^(.*?://[^#]*)', 1), '/+$', ''), '://', 1)) || '://' || translate(regexp_extract(regexp_replace(regexp_extract(url, '(?s)^(.*?://[^#]*)', 1), '/+$', ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(regexp_replace(regexp_extract(url, '(?s)^(.*?://[^#]*)', 1), '/+$', ''), '(?s)^.*?://[^/?#]*(.*)$', 1) END AS address
      FROM pages),
tags AS (
  SELECT url, CASE WHEN canonical THEN regexp_extract(t, '(?i)\bhref\s*=\s*["\x27]?([^"\x27\s>]+)', 1) ELSE regexp_extract(t, '(?i)\burl\s*=\s*["\x27]?([^"\x27\s>]+)', 1) END AS t
  FROM (SELECT url, t, regexp_matches(t, '(?i)^<link\b[^>]*\brel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|\x27(?:[^\x27]*\s)?canonical(?:\s[^\x27]*)?\x27|canonical(?:[\s>]|/>))') AS canonical,
               regexp_matches(t, '(?i)^<meta\b[^>]*\bhttp-equiv\s*=\s*["\x27]?refresh\b') AS refresh
        FROM (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS t FROM p WHERE contains(url, '://')))
  WHERE canonical OR refresh),
named AS (
  SELECT url, replace(t, '&amp;', '&') AS t, regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) AS origin, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS place FROM tags WHERE t <> ''),
steps AS (
  SELECT *, string_split(CASE WHEN starts_with(t, '/') THEN regexp_extract(t, '^([^?#]*)', 1) ELSE CASE WHEN place = '' THEN '/' ELSE regexp_extract(place, '(?s)^(.*/)', 1) END || regexp_extract(t, '^([^?#]*)', 1) END, '/') AS st FROM named),
walked AS (
  SELECT *, array_to_string(list_reduce([CAST([] AS VARCHAR[])] || list_transform(st, lambda x: [x]), lambda so, x: CASE WHEN x = ['.'] THEN so WHEN x = ['..'] THEN so[1:greatest(len(so) - 1, 1)] ELSE list_concat(so, x) END), '/')
    || CASE WHEN st[-1] IN ('.', '..') THEN '/' ELSE '' END || regexp_extract(t, '^[^?#]*(.*)$', 1) AS way FROM steps),
whole AS (
  SELECT url, CASE WHEN regexp_matches(t, '(?i)^[a-z][a-z0-9+.\-]*://') THEN t WHEN starts_with(t, '//') THEN split_part(url, '://', 1) || ':' || t
    WHEN starts_with(t, '#') OR regexp_matches(t, '(?i)^[a-z][a-z0-9+.\-]*:') THEN NULL WHEN starts_with(t, '?') THEN origin || place || t ELSE origin || way END AS t
  FROM walked),
links AS (
  SELECT lower(split_part(regexp_replace(regexp_extract(url, '(?s)^(.*?://[^#]*)', 1), '/+$', ''), '://', 1)) || '://' || translate(regexp_extract(regexp_replace(regexp_extract(url, '(?s)^(.*?://[^#]*)', 1), '/+$', ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(regexp_replace(regexp_extract(url, '(?s)^(.*?://[^#]*)', 1), '/+$', ''), '(?s)^.*?://[^/?#]*(.*)$', 1) AS a,
    lower(split_part(regexp_replace(regexp_extract(t, '(?s)^(.*?://[^#]*)', 1), '/+$', ''), '://', 1)) || '://' || translate(regexp_extract(regexp_replace(regexp_extract(t, '(?s)^(.*?://[^#]*)', 1), '/+$', ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(regexp_replace(regexp_extract(t, '(?s)^(.*?://[^#]*)', 1), '/+$', ''), '(?s)^.*?://[^/?#]*(.*)$', 1) AS b, url, t FROM whole WHERE contains(t, '://')),
reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links UNION SELECT a, a FROM links UNION SELECT b, b FROM links
  UNION SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.b = l.a),
nodes AS (SELECT DISTINCT address, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM (SELECT a AS address, url AS u FROM links UNION ALL SELECT b, t FROM links)),
every AS (SELECT DISTINCT host, path FROM (SELECT host, path FROM p UNION ALL SELECT host, path FROM nodes)),
ruled AS (
  SELECT host, path, rh || rp AS rule, verdict,
         row_number() OVER (PARTITION BY host, path ORDER BY length(rh || rp) DESC) AS k
  FROM every JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)),
best AS (SELECT * FROM ruled WHERE k = 1),
spread AS (
  SELECT r.a AS address, bool_or(coalesce(b.verdict = 'block', false)) AND NOT bool_or(coalesce(b.verdict = 'allow', false)) AS blocked
  FROM reach r JOIN nodes n ON n.address = r.b LEFT JOIN best b ON b.host = n.host AND b.path = n.path GROUP BY r.a)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, CASE WHEN s.blocked THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN b.rule IS NOT NULL THEN 'rule' WHEN s.blocked THEN 'alias' ELSE 'default' END AS via
FROM p LEFT JOIN best b ON b.host = p.host AND b.path = p.path LEFT JOIN spread s ON s.address = p.address
"""
