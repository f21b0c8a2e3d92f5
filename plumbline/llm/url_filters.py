r"""URL rules whose decisions spread over redirect and canonical-link equivalence.

Pages that name another address as their canonical one, or that redirect to it, are the same page by other names.
Their edges form components; a component of which any address is blocked by a rule is blocked, unless any of its
addresses is allowed by a rule: allow goes before block. A page's own rule goes before its component's decision.

Edge cases: a null url, or one without ``://``, has an empty host and path and fits no rule; a null html has no
links; repeated pages each get their verdict; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import table
from plumbline.llm.components import components

#: (verdict, host, path) of every rule of the query.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL_TAG = r"(?i)<link\s[^>]*rel\s*=\s*[\"']?canonical[^>]*>"
HREF = r"(?i)href\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH = r"(?i)<meta\s[^>]*http-equiv\s*=\s*[\"']?refresh[^>]*url\s*=\s*[\"']?([^\"'\s>]+)"


def host_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(F.concat(F.substring(url, F.instr(url, "://") + 3, F.length(url))), "#", 1)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1)


def address(url: Column) -> Column:
    """What names a page: host, path and query, without scheme and fragment; null if there is no host."""
    host, path = host_path(url)
    query = F.regexp_extract(F.substring_index(url, "#", 1), r"(\?[\s\S]*)$", 1)
    return F.when(host != "", F.concat(host, F.when(path == "", "/").otherwise(path), query))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b) addresses joined by a canonical link or a meta refresh in ``html``."""
    canonical = F.regexp_extract(F.regexp_extract("html", CANONICAL_TAG, 0), HREF, 1)
    refresh = F.regexp_extract("html", REFRESH, 1)
    has = F.lower("html").contains("canonical") | F.lower("html").contains("http-equiv")
    links = pages.where(has).select("url", F.explode(F.array(canonical, refresh)).alias("to")).where("to <> ''")
    host, path = host_path(F.col("url"))
    scheme = F.substring_index("url", "://", 1)
    full = (
        F.when(F.col("to").contains("://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(scheme, F.lit(":"), "to"))
        .when(F.col("to").startswith("/"), F.concat(scheme, F.lit("://"), host, "to"))
        .otherwise(F.concat(scheme, F.lit("://"), host, F.regexp_extract(F.concat(F.lit("/"), path), r"^/(.*/|)[^/]*$", 1), "to"))
    )
    return links.select(address(F.col("url")).alias("a"), address(full).alias("b"))


def judge(pages: DataFrame, edges: DataFrame | None = None, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page. ``edges``: more (a, b) equivalences, such as a redirect log."""
    host, path = host_path(F.col("url"))
    links = link_edges(pages)
    if edges is not None:
        links = links.unionByName(edges.select("a", "b"))
    member = components(links)
    at, sub = host_path(F.concat(F.lit("x://"), F.col("node")))
    decided = (
        member.withColumn("_own", rule_of(at, sub, rules)["verdict"])
        .groupBy("component")
        .agg(F.max(F.col("_own") == "allow").alias("_allow"), F.max(F.col("_own") == "block").alias("_block"))
        .where("_block and not _allow")
    )
    blocked = member.join(decided, "component", "left_semi").select(F.col("node").alias("_address"), F.lit(True).alias("_blocked"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), address(F.col("url")).alias("_address"))
    judged = judged.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules)).join(blocked, "_address", "left")
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("_blocked"), "block"), F.lit("allow"))
    return judged.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"))


def op6_redirect_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


#: The same in DuckDB SQL; the components by a recursive search, which small tables can afford.
OP6_SQL = r"""
WITH RECURSIVE
u AS (SELECT page_id, url, html, CASE WHEN strpos(coalesce(url, ''), '://') > 0
        THEN string_split(substr(url, strpos(url, '://') + 3), '#')[1] ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, html,
        translate(regexp_extract(rest, '^[^/?]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?]*([^?]*)', 1) AS path, regexp_extract(rest, '(\?[\s\S]*)$', 1) AS query FROM u),
a AS (SELECT *, CASE WHEN host <> '' THEN host || CASE WHEN path = '' THEN '/' ELSE path END || query END AS address FROM p),
links AS (SELECT a.url, address, host, path, unnest([
        regexp_extract(regexp_extract(html, '(?i)<link\s[^>]*rel\s*=\s*["'']?canonical[^>]*>', 0), '(?i)href\s*=\s*["'']?([^"''\s>]+)', 1),
        regexp_extract(html, '(?i)<meta\s[^>]*http-equiv\s*=\s*["'']?refresh[^>]*url\s*=\s*["'']?([^"''\s>]+)', 1)]) AS target
      FROM a WHERE html IS NOT NULL),
absolute AS (SELECT address AS x, CASE
        WHEN contains(target, '://') THEN substr(target, strpos(target, '://') + 3)
        WHEN starts_with(target, '//') THEN substr(target, 3)
        WHEN starts_with(target, '/') THEN host || target
        ELSE host || regexp_extract('/' || path, '^/(.*/|)[^/]*$', 1) || target END AS y FROM links WHERE target <> ''),
named AS (SELECT x, translate(regexp_extract(string_split(y, '#')[1], '^[^/?]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
        regexp_extract(string_split(y, '#')[1], '^[^/?]*([^?]*)', 1) AS s, regexp_extract(string_split(y, '#')[1], '(\?[\s\S]*)$', 1) AS q FROM absolute),
edges AS (SELECT x, h || CASE WHEN s = '' THEN '/' ELSE s END || q AS y FROM named WHERE h <> '' AND x IS NOT NULL),
both_ways AS (SELECT x, y FROM edges UNION SELECT y, x FROM edges),
reach AS (SELECT x AS node, x AS other FROM both_ways UNION SELECT r.node, e.y FROM reach r JOIN both_ways e ON e.x = r.other),
rules(verdict, rule_host, rule_path) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
        ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
marked AS (SELECT node, max(CASE WHEN best = 'allow' THEN 1 ELSE 0 END) AS allowed, max(CASE WHEN best = 'block' THEN 1 ELSE 0 END) AS blocked
      FROM (SELECT node, other, (SELECT arg_max(verdict, length(rule_host || rule_path)) FROM rules
              WHERE ('.' || regexp_extract(other, '^[^/]*', 0)) LIKE ('%.' || rule_host)
                AND starts_with(regexp_extract(other, '^[^/]*([^?]*)', 1), rule_path)) AS best FROM reach) GROUP BY node)
SELECT a.page_id, a.host, a.path, r.rule,
       coalesce(r.verdict, CASE WHEN m.blocked = 1 AND m.allowed = 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT a.*, (SELECT arg_max({'rule': rule_host || rule_path, 'verdict': verdict}, length(rule_host || rule_path)) FROM rules
        WHERE (a.host = rule_host OR ends_with(a.host, '.' || rule_host)) AND starts_with(a.path, rule_path)) AS r FROM a) a
LEFT JOIN marked m ON m.node = a.address
"""
