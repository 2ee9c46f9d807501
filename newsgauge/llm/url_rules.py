"""URL filters: host and path rules, and block decisions that follow redirects and canonical links.

A rule fits its host and all subdomains if the url's path starts with the rule's path; the longest
rule decides. A page without a rule of its own takes part in its alias group: the connected
component of redirect and canonical-link edges. It is blocked if a url of the group is blocked by
rule and none is allowed by rule, as an explicit allow takes precedence; else it is allowed. Urls
that are only linked to count too.

Edges come from ``<link rel="canonical">`` and ``<meta http-equiv="refresh">`` of the pages, and
from a table of redirects (``source``, ``target``) if one is given. Fragments and the case of scheme
and host do not tell urls apart.

Defined results: a null url, or one without ``://``, has empty host and path, no rule and no
aliases, and is allowed; repeated rows are judged alike; null html has no links; other columns are
not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsgauge.llm.components import components
from newsgauge.session import materialize


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", False),
    Rule("example.net", "/en/", True),
    Rule("example.com", "/de/", False),
    Rule("org", "/fr/", True),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"
_NODE = "(?s)^([^#]*?://)([^/?#]*)([^#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark or hash, with A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The name of the longest rule that fits, or null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        found = F.when(fits, F.lit(rule.name)).otherwise(found)
    return found


def _allows(name: Column, rules: tuple[Rule, ...], allow: bool) -> Column:
    return F.coalesce(name.isin([r.name for r in rules if r.allow == allow]), F.lit(False))


def node_of(url: Column) -> Column:
    """The url without fragment, scheme and host in lower case; null without ``://``."""
    front = F.concat(F.regexp_extract(url, _NODE, 1), F.regexp_extract(url, _NODE, 2))
    whole = F.concat(F.translate(front, _UPPER, _LOWER), F.regexp_extract(url, _NODE, 3))
    return F.nullif(whole, F.lit(""))


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?i)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)])


_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:"
_PIECES = "(?s)^([^/?#]*://[^/?#]*)([^?#]*)(.*)$"


def _without_dots(path: Column) -> Column:
    """A path whose ``.`` and ``..`` segments are carried out."""

    def step(made: Column, segment: Column) -> Column:
        return (
            F.when(segment == ".", made)
            .when(segment == "..", F.regexp_replace(made, "/[^/]*$", ""))
            .otherwise(F.concat(made, F.lit("/"), segment))
        )

    segments = F.split(path, "/")
    whole = F.aggregate(F.slice(segments, F.lit(2), F.size(segments)), F.lit(""), step)
    ends_in_folder = F.element_at(segments, -1).isin(".", "..")
    return F.when(path == "", path).otherwise(F.when(ends_in_folder, F.concat(whole, F.lit("/"))).otherwise(whole))


def _resolved(link: Column, url: Column) -> Column:
    """The absolute url a link of a page stands for, by the rules of RFC 3986."""
    root, path = F.regexp_extract(url, _PIECES, 1), F.regexp_extract(url, _PIECES, 2)
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    own = F.regexp_extract(link, "(?s)^([^?#]*)", 1)
    rest = F.regexp_extract(link, "(?s)^[^?#]*(.*)$", 1)
    folder = F.regexp_extract(path, "(?s)^(.*/)", 1)
    folder = F.when(folder == "", "/").otherwise(folder)
    whole = (
        F.when(link.rlike(_SCHEME), link)
        .when(link.startswith("//"), F.concat(F.substring_index(url, "//", 1), link))
        .when((own == "") & rest.startswith("?"), F.concat(root, path, rest))
        .when(own == "", F.concat(root, path, query, rest))
        .when(own.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(root, folder, link))
    )
    parts = [F.regexp_extract(whole, _PIECES, i) for i in (1, 2, 3)]
    return F.when(parts[0] == "", whole).otherwise(F.concat(parts[0], _without_dots(parts[1]), parts[2]))


def link_edges(pages: DataFrame) -> DataFrame:
    """``u, v``: each page's url and the urls its canonical link and refresh lead to."""
    tags = F.regexp_extract_all("html", F.lit(r"(?i)<(?:link|meta)\s[^>]*>"), F.lit(0))
    tag = F.col("tag")
    kind = (
        F.when(tag.rlike(r"""(?i)^<link[^>]*\srel\s*=\s*["']?[^"'>]*\bcanonical\b"""), "href")
        .when(tag.rlike(r"""(?i)^<meta[^>]*\shttp-equiv\s*=\s*["']?refresh\b"""), "content")
    )
    refresh = F.regexp_extract("found", r"(?i)url\s*=\s*['\"]?([^'\"]+)", 1)
    value = F.when(F.col("kind") == "href", _attribute(tag, "href")).otherwise(
        _attribute(tag, "content")
    )
    link = F.when(F.col("kind") == "href", F.col("found")).otherwise(refresh)
    return (
        pages.where(F.instr("url", "://") > 0)
        .select("url", F.explode(tags).alias("tag"))
        .select("url", "tag", kind.alias("kind"))
        .where("kind is not null")
        .select("url", "kind", value.alias("found"))
        .select("url", F.trim(F.replace(link, F.lit("&amp;"), F.lit("&"))).alias("link"))
        .where("link <> ''")
        .select("url", _resolved(F.col("link"), F.col("url")).alias("target"))
        .select(node_of(F.col("url")).alias("u"), node_of(F.col("target")).alias("v"))
    )


def blocked_aliases(edges: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``node`` of every url in a group with a block by rule and no allow by rule."""
    # Stored, as filters on the urls would otherwise repeat how they are made.
    stored = materialize(edges.sparkSession, edges, "links")
    members = components(stored).withColumn(
        "rule", rule_of(host_of(F.col("node")), path_of(F.col("node")), rules)
    )
    groups = members.groupBy("root").agg(
        F.max(_allows(F.col("rule"), rules, False)).alias("blocks"),
        F.max(_allows(F.col("rule"), rules, True)).alias("allows"),
    )
    return members.join(groups.where("blocks and not allows"), "root").select("node")


def url_verdicts(
    pages: DataFrame, rules: tuple[Rule, ...] = RULES, redirects: DataFrame | None = None
) -> DataFrame:
    """``page_id, host, path, rule, verdict``, one row per page."""
    edges = link_edges(pages.select(F.col("url").cast("string"), F.col("html").cast("string")))
    if redirects is not None:
        edges = edges.unionByName(
            redirects.select(node_of(F.col("source")).alias("u"), node_of(F.col("target")).alias("v"))
        )
    url = F.col("url").cast("string")
    rows = pages.select(
        "page_id", node_of(url).alias("node"), host_of(url).alias("host"), path_of(url).alias("path")
    ).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    aliases = blocked_aliases(edges, rules).withColumn("alias", F.lit(True))
    verdict = (
        F.when(_allows(F.col("rule"), rules, True), "allow")
        .when(_allows(F.col("rule"), rules, False) | F.coalesce("alias", F.lit(False)), "block")
        .otherwise("allow")
    )
    return rows.join(aliases, "node", "left").select(
        "page_id", "host", "path", "rule", verdict.alias("verdict")
    )


ORACLE = r"""
WITH RECURSIVE
tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\s[^>]*>')) AS tag
  FROM pages WHERE strpos(url, '://') > 0),
links AS (
  SELECT url, trim(replace(CASE
    WHEN regexp_matches(tag, '(?i)^<link[^>]*\srel\s*=\s*["'']?[^"''>]*\bcanonical\b')
    THEN regexp_extract(tag, '(?i)\shref\s*=\s*["'']?([^\s"''>]*)', 1)
    WHEN regexp_matches(tag, '(?i)^<meta[^>]*\shttp-equiv\s*=\s*["'']?refresh\b')
    THEN regexp_extract(tag, '(?i)url\s*=\s*[''"]?([^''">]+)', 1) END, '&amp;', '&')) AS link
  FROM tags),
split_links AS (
  SELECT url, link, regexp_extract(url, '(?s)^([^/?#]*://[^/?#]*)', 1) AS root,
    regexp_extract(url, '(?s)^[^/?#]*://[^/?#]*([^?#]*)', 1) AS page_path,
    regexp_extract(url, '(?s)^[^?#]*(\?[^#]*)', 1) AS query,
    regexp_extract(link, '(?s)^([^?#]*)', 1) AS own, regexp_extract(link, '(?s)^[^?#]*(.*)$', 1) AS rest
  FROM links WHERE link <> ''),
whole_links AS (
  SELECT url, CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN link
    WHEN starts_with(link, '//') THEN split_part(url, '//', 1) || link
    WHEN own = '' AND starts_with(rest, '?') THEN root || page_path || rest
    WHEN own = '' THEN root || page_path || query || rest
    WHEN starts_with(own, '/') THEN root || link
    ELSE root || CASE WHEN contains(page_path, '/') THEN regexp_extract(page_path, '(?s)^(.*/)', 1)
      ELSE '/' END || link END AS v
  FROM split_links),
pathed_links AS (
  SELECT url, v, regexp_extract(v, '(?s)^([^/?#]*://[^/?#]*)', 1) AS root,
    regexp_extract(v, '(?s)^[^/?#]*://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(v, '(?s)^[^/?#]*://[^/?#]*[^?#]*(.*)$', 1) AS rest FROM whole_links),
edges AS (
  SELECT url AS u, CASE WHEN root = '' OR path = '' THEN v ELSE root
    || list_reduce(str_split(path, '/')[2:], lambda made, x: CASE WHEN x = '.' THEN made
         WHEN x = '..' THEN regexp_replace(made, '/[^/]*$', '') ELSE made || '/' || x END, '')
    || CASE WHEN regexp_matches(path, '(^|/)\.\.?$') THEN '/' ELSE '' END || rest END AS v
  FROM pathed_links),
urls AS (SELECT url FROM pages UNION SELECT u FROM edges UNION SELECT v FROM edges),
parts AS (
  SELECT url, regexp_extract(url, '^([^#]*)', 1) AS node,
    CASE WHEN strpos(url, '://') > 0
      THEN lower(regexp_extract(url, '^.*?://([^/?#]*)', 1)) ELSE '' END AS host,
    CASE WHEN strpos(url, '://') > 0
      THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM urls WHERE url IS NOT NULL),
rules(rhost, rpath, act) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
  ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT url, arg_max(rhost || rpath, length(rhost || rpath)) AS rule,
    arg_max(act, length(rhost || rpath)) AS act
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost))
    AND starts_with(path, rpath) GROUP BY url),
judged AS (SELECT p.*, f.rule, f.act FROM parts p LEFT JOIN fits f USING (url)),
pairs AS (
  SELECT a.node AS x, b.node AS y FROM edges JOIN parts a ON a.url = u JOIN parts b ON b.url = v
  UNION SELECT b.node, a.node FROM edges JOIN parts a ON a.url = u JOIN parts b ON b.url = v),
reach(origin, node) AS (
  SELECT node, node FROM judged UNION SELECT origin, y FROM reach JOIN pairs ON x = node),
groups AS (
  SELECT origin AS node, bool_or(act = 'block') AS blocks, bool_or(act = 'allow') AS allows
  FROM reach r JOIN judged j ON j.node = r.node GROUP BY origin)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
  CASE WHEN act IS NOT NULL THEN act
    WHEN coalesce(blocks, false) AND NOT coalesce(allows, false) THEN 'block'
    ELSE 'allow' END AS verdict
FROM pages LEFT JOIN judged USING (url) LEFT JOIN groups ON groups.node = judged.node
"""
