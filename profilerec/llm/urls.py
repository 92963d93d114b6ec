"""URL filter by redirect equivalence: block decisions reach every alias of a blocked page."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilerec.llm.components import connected_components

#: Rules are literals of the plan, so their number is bounded; more are refused, never cut.
MAX_RULES = 2000

CANONICAL = r"""(?is)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["'][^"'>]*?\burl\s*=\s*([^"'\s>]+)"""


class Rule(NamedTuple):
    action: str  # allow or block
    host: str
    path: str


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lowered; else empty."""
    found = F.regexp_extract(_rest(url), "^([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule (host and path together, then host) that fits, as a struct (rule, action), or null.

    A rule fits its host and all subdomains where the path starts with the rule's path. Of an allow
    and a block rule for the same host and path, the allow rule wins.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules, at most {MAX_RULES} can be part of one plan")
    for r in rules:
        if r.action not in ("allow", "block"):
            raise ValueError(f"unknown action {r.action!r}")
    ranked = sorted(rules, key=lambda r: (-len(r.host + r.path), -len(r.host), r.action))
    cases = None
    for r in ranked:
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.action).alias("action"))
        cases = F.when(fits, value) if cases is None else cases.when(fits, value)
    none = F.lit(None).cast("struct<rule:string,action:string>")
    return none if cases is None else cases


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(from_url, to_url): canonical links and client redirects named by each page, as absolute urls.

    Relative targets that begin with ``/`` take the page's scheme and host, ``//`` its scheme; other
    relative targets are left out.
    """
    page, body = F.col(url), F.coalesce(F.col(html), F.lit(""))
    targets = pages.select(
        page.alias("from_url"),
        F.explode(F.array(F.regexp_extract(body, CANONICAL, 1), F.regexp_extract(body, REFRESH, 1))).alias("t"),
    ).where("t <> ''")
    scheme = F.substring_index("from_url", "://", 1)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(_rest(F.col("from_url")), "^([^/?#]*)", 1))
    absolute = (
        F.when(F.instr("t", "://") > 0, F.col("t"))
        .when(F.col("t").startswith("//"), F.concat(scheme, F.lit(":"), F.col("t")))
        .when(F.col("t").startswith("/"), F.concat(site, F.col("t")))
    )
    return targets.select("from_url", absolute.alias("to_url")).where("to_url is not null")


def _node(url: Column) -> Column:
    """Urls that differ in their fragment alone name one resource."""
    return F.substring_index(url, "#", 1)


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", html: str | None = "html",
                redirects: DataFrame | None = None) -> DataFrame:
    """``pages`` with host, path, rule and verdict (``allow`` or ``block``).

    A page that a rule fits gets the rule's action; an explicit allow therefore also holds in a
    blocked component. Any other page is blocked if its component of redirects (``redirects``:
    from_url, to_url) and canonical links holds a blocked url, be it a page or only a link's target;
    else it is allowed. Null urls have an empty host and path, no links, and are allowed. Repeated
    urls get the same verdict, one row per input row; columns of ``pages`` named like the added ones
    are replaced. Empty tables give empty tables.
    """
    added = ["host", "path", "rule", "verdict"]
    clean = F.coalesce(F.col(url), F.lit(""))
    rows = pages.drop(*[c for c in added if c != url and c in pages.columns])
    judged = (
        rows.withColumn("_url", clean).withColumn("_host", host(F.col("_url"))).withColumn("_path", path(F.col("_url")))
        .withColumn("_rule", matching_rule(F.col("_host"), F.col("_path"), rules)).withColumn("_node", _node(F.col(url)))
    )
    links = [page_edges(pages, url, html)] if html else []
    if redirects is not None:
        links.append(redirects.select("from_url", "to_url"))
    if links:
        edges = links[0] if len(links) == 1 else links[0].union(links[1])
        nodes = connected_components(edges.select(_node(F.col("from_url")).alias("a"), _node(F.col("to_url")).alias("b")), "a", "b")
        rule = matching_rule(host(F.col("node")), path(F.col("node")), rules)
        blocked = nodes.where(rule["action"] == "block").select("component").distinct()
        tainted = nodes.join(blocked, "component", "left_semi").select(F.col("node").alias("_node"), F.lit(True).alias("_tainted"))
        judged = judged.join(tainted, "_node", "left")
    else:
        judged = judged.withColumn("_tainted", F.lit(None).cast("boolean"))
    verdict = F.coalesce(F.col("_rule.action"), F.when(F.col("_tainted"), "block"), F.lit("allow"))
    return judged.select(
        *[F.col(c) for c in rows.columns], F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("_rule.rule").alias("rule"), verdict.alias("verdict"),
    )
