"""URL filter: prefix rules, and block decisions carried along redirects and canonical links.

Pages that redirect to each other or name each other as canonical are aliases.
Aliases form connected components over URLs, found in a distributed way. A
page that a rule fits has that rule's verdict. Any other page takes the
verdict of its component: allow if a rule explicitly allows any member,
else block if a rule blocks any member, else allow.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, read

#: (verdict, host, path prefix); a rule fits its host and all subdomains.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path of a url: both empty without '://' or for a null url."""
    known = url.isNotNull() & F.contains(url, F.lit("://"))
    rest = F.substring_index(url, "://", 1)
    rest = F.substr(url, F.length(rest) + 4)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(known, host).otherwise(""), F.when(known, path).otherwise("")


def best_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as struct(n, rule, verdict), or null. Rules of equal length: the last by text."""
    fits = [
        F.when(
            ((host == F.lit(h)) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(len(h) + len(p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in rules
    ]
    return F.array_max(F.array_compact(F.array(*fits)))


def node_key(url: Column) -> Column:
    """A page's identity for aliases: its url without fragment, scheme and host in lower case; null without '://'."""
    bare = F.regexp_extract(url, r"^([^#]*)", 1)
    head = F.regexp_extract(bare, r"^([^/?]*://[^/?]*)", 1)
    key = F.concat(F.translate(head, UPPER, LOWER), F.substr(bare, F.length(head) + 1))
    key = F.when(F.length(head) == F.length(bare), F.concat(key, F.lit("/"))).otherwise(key)
    return F.when(F.contains(url, F.lit("://")) & (head != ""), key)


def resolved(href: Column, base: Column) -> Column:
    """An absolute url of href as found on a page at base; null if it can't be one."""
    href = F.trim(F.replace(F.replace(href, F.lit("&amp;"), F.lit("&")), F.lit("\n"), F.lit("")))
    root = F.regexp_extract(base, r"^([^/?#]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([^/?#]*://[^?#]*/)", 1)
    folder = F.when(F.length(folder) > F.length(root), folder).otherwise(F.concat(root, F.lit("/")))
    return (
        F.when(href.isNull() | (href == "") | F.startswith(href, F.lit("#")), None)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, r"^([^:/?#]*:)", 1), href))
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None)
        .when(F.startswith(href, F.lit("/")), F.concat(root, href))
        .when(F.startswith(href, F.lit("?")), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), href))
        .otherwise(F.concat(folder, href))
    )


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x bound to a variable: however often f names it, it is computed once, and generated code stays small."""
    return F.transform(F.array(x), f)[0]


def page_links(pages: DataFrame) -> DataFrame:
    """Alias edges (a, b) between urls that the pages' html declares.

    <link rel="canonical" href> and <meta http-equiv="refresh" content="0; url=">
    count, outside comments and scripts. A page whose url has no '://' has no edges.
    """
    html = F.coalesce("html", F.lit(""))
    # What is left open goes to the end of the text, so that no end is looked for twice.
    body = F.regexp_replace(html, r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*+>|\z)|<style\b.*?(?:</style\s*+>|\z)", " ")
    likely = pages.where(html.rlike(r"(?i)canonical|http-equiv")).select("url", body.alias("_body"))
    tags = likely.select("url", F.explode(F.regexp_extract_all("_body", F.lit(r"(?is)<(?:link|meta)\b[^>]*+(?:>|\z)"), F.lit(0))).alias("tag"))

    def value(tag: Column, name: str) -> Column:
        """An attribute's value without its quotes; empty if it isn't there."""
        pattern = r"(?is)[\s\"']" + name + r"""\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)"""
        return F.regexp_replace(F.regexp_extract(tag, pattern, 1), r"""^["']|["']$""", "")

    def target(t: Column) -> Column:
        canonical = t["link"] & t["rel"].rlike(r"(?i)(^|\s)canonical(\s|$)")
        refresh = ~t["link"] & t["equiv"].rlike(r"(?i)^\s*refresh\s*$")
        return F.when(canonical, t["href"]).when(refresh, F.regexp_extract(t["content"], r"(?is)\burl\s*=\s*['\"]?([^'\"]*)", 1))

    names = {"rel": "rel", "equiv": "http-equiv", "href": "href", "content": "content"}
    taken = once(F.col("tag"), lambda t: F.struct(t.rlike(r"(?is)^<link\b").alias("link"), *[value(t, v).alias(k) for k, v in names.items()]))
    href = once(taken, target)
    to = once(F.struct("url", href.alias("href")), lambda r: resolved(r["href"], r["url"]))
    found = tags.select(once(F.col("url"), node_key).alias("a"), once(to, node_key).alias("b"))
    return found.where("a is not null and b is not null")


def judge(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, url, host, path, rule, verdict, alias for every row of pages (page_id, url, html).

    redirects: further alias edges (source_url, target_url), such as a crawl's
    redirect log. rule is the fitting rule's text or null; verdict is allow or
    block; alias tells whether the verdict came from an alias. Null urls and
    urls without '://' have empty host and path, no rule and no alias, and are
    allowed. Repeated rows each get their row. An empty table gives an empty result.

    Only alias edges and the keys of pages are shuffled, never html. A url that
    very many rows share, or a component with very many pages, is one row of
    aggregated flags on one side of the joins.
    """
    host, path = host_path(F.col("url"))
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("_best", best_rule(F.col("host"), F.col("path"), rules)).withColumn("_key", node_key(F.col("url")))
    edges = page_links(pages.select("url", "html"))
    if redirects is not None:
        edges = edges.union(redirects.select(node_key(F.col("source_url")).alias("a"), node_key(F.col("target_url")).alias("b")))
    groups = components(edges)
    # An alias that isn't a page itself still counts: its own rule is judged by its url.
    alias_host, alias_path = host_path(F.col("node"))
    flags = groups.withColumn("_v", best_rule(alias_host, alias_path, rules)["verdict"]).groupBy("component").agg(
        F.max((F.col("_v") == "allow").cast("int")).alias("_allow"), F.max((F.col("_v") == "block").cast("int")).alias("_block")
    )
    by_key = groups.join(flags, "component").select(F.col("node").alias("_key"), F.when(F.col("_allow") == 1, "allow").when(F.col("_block") == 1, "block").alias("_carried"))
    out = judged.join(by_key, "_key", "left")
    rule = F.col("_best.rule")
    return out.select(
        "page_id", "url", "host", "path", rule.alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.col("_carried"), F.lit("allow")).alias("verdict"),
        (rule.isNull() & F.col("_carried").isNotNull()).alias("alias"),
    )


def op4_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url: page_id, host, path, rule, verdict."""
    return judge(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def _sql_rules() -> str:
    return ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)


def _sql_attribute(name: str) -> str:
    return rf"""regexp_replace(regexp_extract(tag, '(?is)[\s"'']{name}\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), '^["'']|["'']$', '', 'g')"""


#: Verdicts by rules, and by aliases through canonical and refresh tags whose targets are absolute.
OP4_SQL = rf"""
WITH RECURSIVE rules(verdict, h, p) AS (VALUES {_sql_rules()}),
base AS (SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, url,
  CASE WHEN rest IS NULL THEN '' ELSE translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') END AS host,
  CASE WHEN rest IS NULL THEN '' ELSE regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) END AS path FROM base),
tags AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?(-->|\z)|<script\b.*?(</script\s*>|\z)|<style\b.*?(</style\s*>|\z)', ' ', 'g'), '(?is)<(?:link|meta)\b[^>]*(?:>|\z)')) AS tag
  FROM pages WHERE regexp_matches(html, '(?i)canonical|http-equiv')),
targets AS (SELECT url, CASE
  WHEN regexp_matches(tag, '(?is)^<link\b') THEN CASE WHEN regexp_matches({_sql_attribute("rel")}, '(?i)(^|\s)canonical(\s|$)') THEN {_sql_attribute("href")} END
  WHEN regexp_matches({_sql_attribute("http-equiv")}, '(?i)^\s*refresh\s*$') THEN regexp_extract({_sql_attribute("content")}, '(?is)\burl\s*=\s*[''"]?([^''"]*)', 1) END AS target FROM tags),
urls AS (SELECT url FROM pages UNION SELECT target FROM targets),
keys AS (SELECT url, regexp_replace(url, '#.*$', '') AS bare, translate(regexp_extract(url, '^([^/?#]*://[^/?#]*)', 1), '{UPPER}', '{LOWER}') AS head FROM urls WHERE contains(url, '://')),
nodes AS (SELECT url, head || CASE WHEN length(head) = length(bare) THEN '/' ELSE substr(bare, length(head) + 1) END AS k FROM keys WHERE head <> ''),
edges AS (SELECT a.k AS a, b.k AS b FROM targets t JOIN nodes a ON a.url = t.url JOIN nodes b ON b.url = t.target),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach AS (SELECT a AS n, a AS m FROM both_ways UNION SELECT r.n, e.b FROM reach r JOIN both_ways e ON e.a = r.m),
ends AS (SELECT DISTINCT m, regexp_extract(m, '://([^/?]*)', 1) AS host, regexp_extract(m, '://[^/?]*([^?]*)', 1) AS path FROM reach),
fit AS (SELECT host, path, max({{'n': length(r.h) + length(r.p), 'rule': r.h || r.p, 'verdict': r.verdict}}) AS best
  FROM (SELECT host, path FROM parts UNION SELECT host, path FROM ends) x JOIN rules r ON (host = r.h OR ends_with(host, '.' || r.h)) AND starts_with(path, r.p) GROUP BY host, path),
carried AS (SELECT r.n, CASE WHEN bool_or(f.best.verdict = 'allow') THEN 'allow' WHEN bool_or(f.best.verdict = 'block') THEN 'block' END AS v
  FROM reach r JOIN ends e ON e.m = r.m JOIN fit f ON f.host = e.host AND f.path = e.path GROUP BY r.n)
SELECT p.page_id, p.host, p.path, f.best.rule AS rule, coalesce(f.best.verdict, c.v, 'allow') AS verdict
FROM parts p LEFT JOIN fit f ON f.host = p.host AND f.path = p.path LEFT JOIN nodes n ON n.url = p.url LEFT JOIN carried c ON c.n = n.k
"""
