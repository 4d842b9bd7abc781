"""URL filters with redirect equivalence, DataFrames only."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.components import components
from logloom.llm.shared import cut, lower_ascii


class Rule(NamedTuple):
    verdict: str  # "allow" or "block"
    host: str
    path: str


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring(_u, instr(_u, '://') + 3)"))


def host_path(df: DataFrame, url_col: str) -> DataFrame:
    """Add ``host`` and ``path``; both are empty for a null url or one without ``://``."""
    rest = F.coalesce(_rest(F.col("_u")), F.lit(""))
    df = df.withColumn("_u", F.col(url_col)).withColumn("_rest", rest)
    host = lower_ascii(F.regexp_extract("_rest", "^[^/?#]*", 0))
    path = F.regexp_extract("_rest", "^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": host, "path": path}).drop("_u", "_rest")


def _let(value: Column, f) -> Column:
    """``f(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def node(url: Column) -> Column:
    """A url as a node: lower-case host and all up to the fragment, whatever the scheme; else null."""
    rest = F.regexp_extract(url, "(?s)^.*?://([^#]*)", 1)
    lowered = lambda r: F.concat(lower_ascii(F.regexp_extract(r, "^[^/?]*", 0)), F.regexp_extract(r, "(?s)^[^/?]*(.*)", 1))
    return F.when(F.instr(url, "://") > 0, _let(rest, lowered))


def matching_rule(rules: Sequence[Rule]) -> Column:
    """The longest rule that fits ``host`` and ``path`` as (text, verdict), or null.

    Of equally long rules allow goes before block.  The rule list is a parameter
    and part of the plan.
    """
    best_first = sorted(rules, key=lambda r: (-len(r.host + r.path), r.verdict != "allow"))
    known = F.array(*[F.struct(F.lit(r.host + r.path).alias("text"), F.lit(r.verdict).alias("verdict"), F.lit(r.host).alias("host"), F.lit("." + r.host).alias("tail"), F.lit(r.path).alias("path")) for r in best_first])
    fits = lambda r: ((F.col("host") == r["host"]) | F.endswith(F.col("host"), r["tail"])) & F.startswith(F.col("path"), r["path"])
    return F.get(F.filter(known, fits), F.lit(0))


LINK_TAG = r"(?i)<(?:link|meta)\b[^>]*>"
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>"
CANONICAL = r"(?i)\brel\s*=\s*[\"']?[^\"'>]*\bcanonical\b"
REFRESH = r"(?i)\bhttp-equiv\s*=\s*[\"']?refresh\b"
HREF = r"(?i)\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
TARGET = r"(?i)\burl\s*=\s*(?:&quot;|')?([^\"'>\s]+)"


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(a, b)``: nodes joined by a canonical link or a redirect of the page.

    Comments and scripts are skipped.  Relative targets are resolved against
    the page's host and folder; targets in other schemes are ignored.
    """
    h = F.col(html_col)
    some = h.rlike(r"(?i)<link\b[^>]*\bcanonical\b") | h.rlike(r"(?i)<meta\b[^>]*\brefresh\b")
    seen = pages.where(some & F.col(url_col).isNotNull()).select(F.col(url_col).alias("url"), F.regexp_replace(h, HIDDEN, "").alias("_html"))
    tags = seen.select("url", F.explode(F.regexp_extract_all("_html", F.lit(LINK_TAG), F.lit(0))).alias("tag"))
    href = F.concat(*[F.regexp_extract("tag", HREF, i) for i in (1, 2, 3)])
    to = F.when(F.col("tag").rlike(CANONICAL), href).when(F.col("tag").rlike(REFRESH), F.regexp_extract("tag", TARGET, 1))
    tags = tags.select("url", F.trim(F.replace(to, F.lit("&amp;"), F.lit("&"))).alias("to")).where("to <> ''")
    scheme, site = F.regexp_extract("url", "(?s)^.*?://", 0), F.regexp_extract("url", "(?s)^.*?://[^/?#]*", 0)
    folder = F.regexp_extract("url", "(?s)^.*?://[^?#]*/", 0)
    whole = (
        F.when(F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("to"))
        .when(F.col("to").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .when(F.col("to").startswith("//"), F.concat(F.lit("http:"), F.col("to")))
        .when(F.col("to").startswith("/"), F.concat(site, F.col("to")))
        .when(F.length(folder) > F.length(scheme), F.concat(folder, F.col("to")))
        .otherwise(F.concat(site, F.lit("/"), F.col("to")))
    )
    ends = tags.select(node(F.col("url")).alias("a"), _let(whole, node).alias("b"))
    return ends.where("a is not null and b is not null and a <> b").distinct()


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every page.

    A fitting rule decides.  Pages without one are aliases of all urls in their
    component of redirects and canonical links: if any url there (a page or only
    a target) is blocked by a rule the page is blocked, else it is allowed.  So
    an explicit allow goes before what aliases say.  Null and malformed urls
    have no aliases and are allowed; existing columns of these names are
    replaced.  Page contents are read for links; they are moved only if the
    caller keeps that column.
    """
    edges = cut(page_links(pages, url_col, html_col))
    best = matching_rule(rules)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    placed = nodes.join(components(edges, "a", "b").withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("node", F.coalesce("root", "node").alias("root"))
    bad = host_path(placed.withColumn("_full", F.concat(F.lit("http://"), "node")), "_full").where(best["verdict"] == "block").select(F.col("root").alias("_bad")).distinct()
    aliases = placed.join(bad, F.col("root") == F.col("_bad"), "left_semi").select(F.col("node").alias("_alias"))
    judged = host_path(pages.drop("host", "path", "rule", "verdict"), url_col).withColumns({"_best": best, "_node": node(F.col(url_col))})
    # Pages without a node would all meet in one task: they get keys of their own that no node has.
    own = F.concat(F.lit("\u0000"), F.xxhash64(*[F.col(f"`{c}`") for c in pages.columns if c not in (html_col, "host", "path", "rule", "verdict")]).cast("string"))
    told = judged.withColumn("_key", F.coalesce("_node", own)).join(aliases, F.col("_key") == F.col("_alias"), "left").drop("_key")
    decided = F.coalesce("_best.verdict", F.when(F.col("_alias").isNotNull(), "block"), F.lit("allow"))
    return told.withColumns({"rule": F.col("_best.text"), "verdict": decided}).drop("_best", "_node", "_alias")


def _node_sql(url: str) -> str:
    rest = f"regexp_extract({url}, '(?s)^.*?://([^#]*)', 1)"
    host = f"regexp_extract({rest}, '^[^/?]*')"
    lower = f"translate({host}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"CASE WHEN instr({url}, '://') > 0 THEN {lower} || substr({rest}, length({host}) + 1) END"


def filter_sql(rules: Sequence[Rule]) -> str:
    """The query's rows in DuckDB's SQL."""

    def parts(url: str) -> str:
        rest = f"CASE WHEN instr({url}, '://') > 0 THEN substr({url}, instr({url}, '://') + 3) ELSE '' END"
        return f"translate(regexp_extract({rest}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) AS path"

    values = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in rules)
    q = lambda s: s.replace("'", "''")
    refs = " || ".join(f"regexp_extract(tag, '{q(HREF)}', {i})" for i in (1, 2, 3))
    return f"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES {values}),
tags AS (SELECT url, unnest(regexp_extract_all(regexp_replace(html, '{q(HIDDEN)}', '', 'g'), '{q(LINK_TAG)}')) AS tag FROM pages WHERE url IS NOT NULL),
refs AS (SELECT url, trim(replace(CASE WHEN regexp_matches(tag, '{q(CANONICAL)}') THEN {refs}
    WHEN regexp_matches(tag, '{q(REFRESH)}') THEN regexp_extract(tag, '{q(TARGET)}', 1) END, '&amp;', '&')) AS ref FROM tags),
whole AS (SELECT url, CASE WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN ref
    WHEN regexp_matches(ref, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL
    WHEN starts_with(ref, '//') THEN 'http:' || ref
    WHEN starts_with(ref, '/') THEN regexp_extract(url, '(?s)^.*?://[^/?#]*') || ref
    WHEN length(regexp_extract(url, '(?s)^.*?://[^?#]*/')) > length(regexp_extract(url, '(?s)^.*?://')) THEN regexp_extract(url, '(?s)^.*?://[^?#]*/') || ref
    ELSE regexp_extract(url, '(?s)^.*?://[^/?#]*') || '/' || ref END AS target FROM refs WHERE ref <> ''),
one_way AS (SELECT DISTINCT {_node_sql("url")} AS a, {_node_sql("target")} AS b FROM whole),
edges AS (SELECT a, b FROM one_way WHERE a <> b UNION SELECT b, a FROM one_way WHERE a <> b),
nodes AS (SELECT DISTINCT a AS node, {parts("('http://' || a)")} FROM edges),
ruled AS (SELECT node, arg_max(r.verdict, length(r.host || r.path)) AS verdict FROM nodes n JOIN rules r
    ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path) GROUP BY node),
reached AS (SELECT node FROM ruled WHERE verdict = 'block' UNION SELECT e.b FROM reached JOIN edges e ON e.a = reached.node),
p AS (SELECT row_number() OVER () AS i, page_id, {_node_sql("url")} AS node, {parts("url")} FROM pages),
own AS (SELECT i, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict FROM p JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY i)
SELECT page_id, coalesce(p.host, '') AS host, coalesce(p.path, '') AS path, own.rule,
       coalesce(own.verdict, CASE WHEN p.node IN (SELECT node FROM reached) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN own USING (i)
"""
