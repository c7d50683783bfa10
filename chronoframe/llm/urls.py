"""URL filter whose block decisions follow redirects and canonical links.

Rules judge a url by host (with its subdomains) and path prefix; the longest
rule wins.  Pages point to other urls by ``<link rel=canonical>`` and by
``<meta http-equiv=refresh>``; over these edges connected components of urls
are built.  A url without a rule takes the decision of its component: allow if
some member is allowed by a rule, else block if some member is blocked, else
the default.  A url with a rule of its own keeps it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoframe.llm.common import materialize
from chronoframe.llm.components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"),
         Rule("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Struct ``size``, ``rule``, ``action`` of the longest rule that fits, or null; on a tie, allow."""
    fits = []
    for r in rules:
        own = (host == r.host) | host.endswith("." + r.host)
        fits.append(F.when(own & path.startswith(r.path), F.struct(
            F.lit(len(r.name)).alias("size"), F.lit(r.action == "allow").alias("allow"),
            F.lit(r.name).alias("rule"), F.lit(r.action).alias("action"))))
    return F.greatest(*fits, F.lit(None), F.lit(None))


def _plain_path(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments; those that lead above the root are dropped."""
    steps = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda done, x: (
        F.when(x == ".", done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.concat(done, F.array(x)))))
    return F.when(path.contains("/."), F.concat(F.array_join(steps, "/"), F.when(path.rlike(r"/\.\.?$"), "/").otherwise(""))).otherwise(path)


def url_key(url: Column) -> Column:
    """A url without scheme, fragment, dot segments and final slash; the host in lower case."""
    query = F.regexp_extract(url, r"(?s)^[^#]*?(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), F.regexp_replace(_plain_path(path_of(url)), "/+$", ""), query))


#: Character references that stand in attribute values; ``&amp;`` goes last.
ENTITIES = (("&#38;", "&amp;"), ("&#x26;", "&amp;"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"),
            ("&#47;", "/"), ("&#x2f;", "/"), ("&amp;", "&"))
_VALUE = r"""\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, without quotes, decoded and trimmed."""
    value = F.regexp_replace(F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}{_VALUE}", 1), r"(?s)^[\"'](.*)[\"']$", "$1")
    for code, char in ENTITIES:
        value = F.regexp_replace(value, f"(?i){code}", char)
    return F.trim(value)


def resolve(base: Column, target: Column) -> Column:
    """The absolute url of a link, or null if it is none (another scheme, or nothing but a fragment)."""
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    path, t = path_of(base), target
    folder = F.when(path.contains("/"), F.regexp_extract(path, r"(?s)^(.*/)", 1)).otherwise(F.lit("/"))
    return (F.when((t == "") | t.startswith("#"), F.lit(None)).when(t.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*://"), t)
            .when(t.rlike(r"(?s)^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None)).when(t.startswith("//"), F.concat(F.lit("http:"), t))
            .when(site == "", F.lit(None)).when(t.startswith("/"), F.concat(site, t)).when(t.startswith("?"), F.concat(site, path, t))
            .otherwise(F.concat(site, folder, t)))


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``a``, ``b``: url keys joined by a canonical link or a refresh redirect.

    All such tags of a page count, but not those inside comments; targets are
    decoded and resolved against the page's url or its ``<base href>``.
    """
    low = F.lower("h")
    some = pages.select(F.col(url).alias("u"), F.col(html).cast("string").alias("h")).filter(low.contains("canonical") | low.contains("refresh"))
    text = F.regexp_replace("h", r"(?s)<!--.*?(-->|$)", " ")
    tags = some.select("u", F.regexp_extract_all(text, F.lit(r"(?is)<(?:link|meta|base)\b[^>]*>"), F.lit(0)).alias("tags"))
    bases = F.filter("tags", lambda t: t.rlike(r"(?is)^<base"))
    based = tags.withColumn("first", F.get(bases, F.lit(0))).withColumn("href", F.when(F.col("first").isNotNull(), _attribute(F.col("first"), "href")))
    own = F.when(F.coalesce("href", F.lit("")) == "", F.col("u")).otherwise(F.coalesce(resolve(F.col("u"), F.col("href")), F.col("u")))
    rows = based.select("u", own.alias("base"), F.explode("tags").alias("t"))
    # a step at a time, so that no value is worked out again for each of its uses
    kinds = rows.select("u", "base", F.when(F.col("t").rlike(r"(?is)^<link"), F.lower(_attribute(F.col("t"), "rel"))).alias("rel"),
                        F.when(F.col("t").rlike(r"(?is)^<meta"), F.lower(_attribute(F.col("t"), "http-equiv"))).alias("equiv"), "t")
    link, fresh = F.array_contains(F.split("rel", r"\s+"), "canonical"), F.col("equiv") == "refresh"
    wanted = kinds.filter(link | fresh).select("u", "base", F.when(link, _attribute(F.col("t"), "href")).otherwise(F.trim(F.regexp_replace(
        F.regexp_extract(_attribute(F.col("t"), "content"), r"(?is)\burl\s*=\s*(.*)$", 1), r"(?s)^[\"']([^\"']*).*$", "$1"))).alias("t"))
    found = wanted.filter("t != ''").select("u", resolve(F.col("base"), F.col("t")).alias("t"))
    return found.select(url_key(F.col("u")).alias("a"), url_key(F.col("t")).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a != b")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, key: str = "page_id", url: str = "url",
               html: str = "html", default: str = "allow") -> DataFrame:
    """One row per page: key, ``host``, ``path``, ``rule``, ``verdict``.

    A null url, or one without ``://``, has empty host and path, fits no rule
    and gets the default; repeated urls share their component's decision; an
    empty table gives no rows.  Targets that are no pages themselves are judged
    by the rules as well and pass their decision on.
    """
    base = pages.select(F.col(key).alias("k"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"),
                        url_key(F.col(url)).alias("node"))
    ruled = base.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    comp = materialize(components(link_edges(pages, url, html)), "aliases")
    # a key is host, path and query, so it can be judged like a url
    as_url = F.concat(F.lit("http://"), F.col("node"), F.lit("/"))
    judged = comp.select("root", best_rule(host_of(as_url), path_of(as_url), rules)["action"].alias("action"))
    group = judged.groupBy("root").agg(
        F.max(F.when(F.col("action") == "allow", F.lit(2)).when(F.col("action") == "block", F.lit(1))).alias("rank"))
    decided = comp.join(group, "root").select("node", "rank")
    out = ruled.join(decided, "node", "left")
    own = F.col("best")["action"]
    via = F.when(F.col("rank") == 2, F.lit("allow")).when(F.col("rank") == 1, F.lit("block")).otherwise(F.lit(default))
    return out.select(F.col("k").alias(key), "host", "path", F.col("best")["rule"].alias("rule"),
                      F.coalesce(own, via).alias("verdict"))


ORACLE = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
    CASE WHEN coalesce(url, '') LIKE '%://%' THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
h AS (
  SELECT page_id, url, html,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(rest, '^[^#?]*(\?[^#]*)', 1) AS query
  FROM p),
r(action, rhost, rpath) AS (VALUES
  ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
n AS (
  SELECT h.*, CASE WHEN url LIKE '%://%' THEN host || regexp_replace(path, '/+$', '') || query END AS node FROM h),
best AS (
  SELECT page_id, node, host, path, rhost || rpath AS rule, action,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS i
  FROM n JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
e AS (
  SELECT node AS a, regexp_replace(regexp_extract(
    regexp_extract(html, '(?is)(<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>)', 1),
    '(?is)\bhref\s*=\s*["'']?https?://([^"''\s>]+)', 1), '/+$', '') AS b
  FROM n WHERE html ILIKE '%canonical%'),
u AS (SELECT a, b FROM e WHERE a <> b AND b <> '' UNION SELECT b, a FROM e WHERE a <> b AND b <> ''),
reach(a, b) AS (SELECT a, b FROM u UNION SELECT reach.a, u.b FROM reach JOIN u ON reach.b = u.a),
via AS (
  SELECT reach.a AS node, max(CASE best.action WHEN 'allow' THEN 2 ELSE 1 END) AS rank
  FROM reach JOIN best ON reach.b = best.node WHERE best.i = 1 GROUP BY reach.a)
SELECT n.page_id, n.host, n.path, best.rule,
       coalesce(best.action, CASE via.rank WHEN 2 THEN 'allow' WHEN 1 THEN 'block' END, 'allow') AS verdict
FROM n LEFT JOIN best ON n.page_id = best.page_id AND best.i = 1 LEFT JOIN via ON n.node = via.node
"""
