"""URL filters with redirect equivalence.

Rules name a host and a path prefix and allow or block. Pages that redirect to each other or name each
other as canonical are one equivalence class, found as a connected component of the link graph; a block of
one member reaches the aliases that have no rule of their own. An explicit allow goes first: a url's own
rule always decides for it, and a class in which any url is explicitly allowed passes no block on.

Every canonical link and every redirect of a page is an edge. Nodes of the graph are urls without scheme and fragment, an
empty path being ``/`` and dot segments gone (the columns host and path are as written). Links are resolved against the page's ``<base href>`` or its url. Null
urls and urls without ``://`` have empty host and path, fit no rule and are allowed. The longest fitting rule decides; of
fitting rules of one length an allow goes first, then the text in order, however many rules there are. Repeated rows are judged alike.
Html is searched whole, a tag ends at the next angle bracket. Empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Up to so many rules are literals of the plan; more are joined by host.
LITERAL_RULES = 256
CANONICAL = r"""(?is)<link\b(?=[^<>]*\brel\s*=\s*["']?canonical\b)[^<>]*?\bhref\s*=\s*["']?([^"'\s<>]+)"""
BASE = r"""(?is)<base\b[^<>]*?\bhref\s*=\s*["']?([^"'\s<>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^<>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^<>]*?\bcontent\s*=\s*["']?[^"'<>]*?\burl\s*=\s*["']?([^"'\s<>]+)"""


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path

    @classmethod
    def parse(cls, text: str, allow: bool) -> "Rule":
        host, slash, path = text.partition("/")
        return cls(host.lower(), slash + path, allow)


RULES = [Rule.parse(t, a) for t, a in (("org/", True), ("example.org/es/", False), ("example.org/en/1", False), ("com/fr/", True), ("com/de/", False))]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def node_of(url: Column) -> Column:
    """Host, path (``/`` if empty, without dot segments) and query; null where there is no host."""
    return let(url, lambda u: F.when(host_of(u) != "", F.concat(host_of(u), without_dots(F.concat(F.when(path_of(u) == "", F.lit("/")).otherwise(F.lit("")), path_of(u))), query_of(u))))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))


def without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments: each ``..`` takes the segment before it away, a last one of either leaves a slash."""

    def whole(parts: Column) -> Column:
        kept = F.aggregate(
            parts, F.array().cast("array<string>"),
            lambda out, p: F.when(p == ".", out).when(p == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p))),
        )
        end = F.get(parts, F.size(parts) - 1).isin(".", "..")
        return let(kept, lambda k: F.concat(F.lit("/"), F.array_join(k, "/"), F.when(end & (F.size(k) > 0), F.lit("/")).otherwise(F.lit(""))))

    return let(path, lambda p: F.when(p.startswith("/") & F.contains(p, F.lit("/.")), let(F.slice(F.split(p, "/", -1), 2, 1 << 30), whole)).otherwise(p))


def resolved(base: Column, href: Column) -> Column:
    """A link target as an absolute url by RFC 3986, 5.2: relative to the base's folder or host, a query alone on the base's path.
    Null for empty and fragment-only links, other schemes, and relative links where the base has no host. Dot segments go in ``node_of``."""
    href = F.regexp_replace(F.regexp_replace(F.trim(href), "&amp;", "&"), "(?s)#.*$", "")

    def target(b: Column, h: Column) -> Column:
        root = F.when(host_of(b) != "", F.concat(F.lit("http://"), host_of(b)))
        own = F.when(path_of(b) == "", F.lit("/")).otherwise(path_of(b))
        return (
            F.when(h == "", F.lit(None))
            .when(h.rlike(r"(?i)^https?://"), h)
            .when(h.startswith("//"), F.concat(F.lit("http:"), h))
            .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(h.startswith("/"), F.concat(root, h))
            .when(h.startswith("?"), F.concat(root, own, h))
            .otherwise(F.concat(root, F.regexp_replace(own, r"[^/]*$", ""), h))
        )

    return let(F.struct(base.alias("b"), href.alias("h")), lambda x: target(x["b"], x["h"]))


def with_rule(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """Add ``rule`` and ``rule_allow`` of the deciding rule to rows with host and path."""
    best: dict[str, Rule] = {}
    for r in rules:
        if r.text not in best or r.allow:
            best[r.text] = r
    rules = sorted(best.values(), key=lambda r: (-len(r.text), not r.allow, r.text))
    if len(rules) <= LITERAL_RULES:
        fit = [(((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path), r) for r in rules]
        text, allow = F.lit(None).cast("string"), F.lit(None).cast("boolean")
        for cond, r in reversed(fit):
            text, allow = F.when(cond, F.lit(r.text)).otherwise(text), F.when(cond, F.lit(r.allow)).otherwise(allow)
        return df.withColumns({"rule": text, "rule_allow": allow})
    known = df.sparkSession.createDataFrame([(r.host, r.path, r.text, r.allow, i) for i, r in enumerate(rules)], "rule_host string, rule_path string, rule string, rule_allow boolean, place int")
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hits = df.select("host", "path").distinct().select("host", "path", F.explode(tails).alias("rule_host")).join(known, "rule_host").where(F.expr("startswith(path, rule_path)"))
    top = hits.groupBy("host", "path").agg(F.min(F.struct("place", "rule", "rule_allow")).alias("top")).select("host", "path", "top.rule", "top.rule_allow")
    return df.join(top, ["host", "path"], "left")


def judge(pages: DataFrame, rules: list[Rule], scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, inherited) for every page; inherited tells a block taken from an alias."""
    url, html = F.col(url_col).cast("string"), F.col(html_col).cast("string")
    links = F.concat(*[F.regexp_extract_all(html, F.lit(x), 1) for x in (CANONICAL, REFRESH)])
    edges = (
        pages.where(html.rlike(r"(?i)canonical|http-equiv"))
        .select(url.alias("url"), F.coalesce(resolved(url, F.regexp_extract(html, BASE, 1)), url).alias("base"), F.explode(links).alias("href"))
        .select(node_of(F.col("url")).alias("a"), node_of(resolved(F.col("base"), F.col("href"))).alias("b"))
    )
    parts = connected_components(edges, scratch, "aliases")
    nodes = with_rule(parts.select("node", "component", F.regexp_extract("node", r"(?s)^([^/?]*)", 1).alias("host"), F.regexp_extract("node", r"(?s)^[^/?]*([^?]*)", 1).alias("path")), rules)
    classes = nodes.groupBy("component").agg(F.coalesce(F.bool_or(~F.col("rule_allow")) & ~F.coalesce(F.bool_or("rule_allow"), F.lit(False)), F.lit(False)).alias("blocked"))
    tainted = parts.join(classes.where("blocked"), "component").select("node", F.lit(True).alias("tainted"))
    rows = with_rule(pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node")), rules)
    inherited = F.col("rule").isNull() & F.coalesce("tainted", F.lit(False))
    verdict = F.when(F.col("rule").isNotNull(), F.when(F.col("rule_allow"), "allow").otherwise("block")).when(inherited, "block").otherwise("allow")
    return rows.join(tainted, "node", "left").select(id_col, "host", "path", "rule", verdict.alias("verdict"), inherited.alias("inherited"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES, Scratch(spark, "url-filter"))


#: The rule part in SQL; the sets of aliases are recursive in SQL and tested against brute force, and no page
#: of the synthetic tables names a canonical url or redirects, so here every unruled page is allowed.
ORACLE = r"""
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN url ELSE '' END AS url FROM pages),
p AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rule, h, s, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict, false AS inherited FROM p LEFT JOIN best USING (page_id)
"""
