"""URL rules, and block decisions that spread over redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import plain, stored
from sievework.llm.components import components

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)"
_BLANK = r"[\t\n\f\r ]"
# Comments, elements whose content is plain text, and tags, so that each is read where a browser reads it. The
# quantifiers of groups are possessive: Java matches those in a loop, however many attributes a tag has.
_ATTRIBUTES = rf"""(?:[^>=]++|={_BLANK}*+(?:"[^"]*+"|'[^']*+')|=)*+"""
_PLAIN = "|".join(
    rf"<{name}(?:[\t\n\f\r /]{_ATTRIBUTES})?(?:>.*?(?:</{name}(?=[\t\n\f\r />])|\z)|\z)"
    for name in ("script", "style", "textarea", "title", "iframe", "xmp")
)
_MARKUP = rf"(?is)<!--(?:>|->|.*?(?:-->|--!>|\z))|{_PLAIN}|</?[a-z]{_ATTRIBUTES}(?:>|\z)"
_ATTRIBUTE = rf"""(?s)([^\t\n\f\r />=]+){_BLANK}*={_BLANK}*("[^"]*"|'[^']*'|[^\t\n\f\r >]+)|[^\t\n\f\r />=]+"""
_VALUE = rf"""(?s)^[^=]*={_BLANK}*(?:"([^"]*)"|'([^']*)'|(.*))$"""
_REFRESH = rf"""(?is)^{_BLANK}*[0-9.]+{_BLANK}*[;,]?{_BLANK}*(?:url{_BLANK}*={_BLANK}*)?(?:"([^"]*).*|'([^']*).*|(.*))$"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def resource_of(url: Column) -> Column:
    """What two spellings of one address share: host, path and query; null without a host."""
    key = F.concat(host_of(url), path_of(url), F.regexp_extract(url, _URL, 3))
    return F.when(host_of(url) != "", key)


def _ordered(rules: Sequence[tuple[str, str, str]]) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0], r[1] + r[2]))


def matching(host: Column, path: Column, rules: Sequence[tuple[str, str, str]], what: int | None) -> Column:
    """Of the longest rule (verdict, host, path) that fits: its text, or its verdict if ``what`` is 0.

    A rule fits its host and that host's subdomains where the path starts with the rule's path. Of rules
    of equal length allow comes first.
    """
    out = F.lit(None).cast("string")
    for rule in reversed(_ordered(rules)):
        fits = ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])
        out = F.when(fits, F.lit(rule[1] + rule[2] if what is None else rule[what])).otherwise(out)
    return out


def _target(page_url: Column, link: Column) -> Column:
    """The address a link means on a page; null if it names no page, or only a part of this one."""
    base = F.concat(F.regexp_extract(page_url, r"(?s)^(.*?)://", 1), F.lit("://"), host_of(page_url))
    link = F.replace(F.regexp_replace(link, rf"^{_BLANK}+|{_BLANK}+$", ""), F.lit("&amp;"), F.lit("&"))
    folder = F.regexp_replace(path_of(page_url), r"[^/]*$", "")
    return (
        F.when((link == "") | link.startswith("#"), None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), link)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), None)
        .when(link.startswith("//"), F.concat(F.lit("http:"), link))
        .when(link.startswith("/"), F.concat(base, link))
        .when(link.startswith("?"), F.concat(base, path_of(page_url), link))
        .otherwise(F.concat(base, F.when(folder == "", "/").otherwise(folder), link))
    )


def _one_of_three(text: Column, pattern: str) -> Column:
    return F.concat(*(F.regexp_extract(text, pattern, k) for k in (1, 2, 3)))


def _attribute(attributes: str, name: str) -> Column:
    """Value of the first attribute of this name; null without one."""
    named = F.filter(attributes, lambda a: a.rlike(rf"(?i)^{name}{_BLANK}*="))
    return _one_of_three(F.get(named, F.lit(0)), _VALUE)


def link_edges(pages: DataFrame) -> DataFrame:
    """(a, b) resources of pages (url, html) and of all their canonical links and refreshes.

    Tags inside comments, scripts, styles, titles and text fields are no tags; attribute values may hold ``>``.
    Dot segments and a base element are not resolved.
    """
    tags = F.filter(
        F.regexp_extract_all("html", F.lit(_MARKUP), F.lit(0)), lambda t: t.rlike(r"(?is)^<(?:link|meta)[\t\n\f\r /].*>$")
    )
    found = pages.select("url", F.explode(tags).alias("tag"))
    body = F.regexp_replace("tag", r"(?s)^<[A-Za-z]+|>$", "")
    found = found.withColumn("is_link", F.col("tag").rlike("(?i)^<link"))
    found = found.withColumn("attributes", F.regexp_extract_all(body, F.lit(_ATTRIBUTE), F.lit(0)))
    canonical = F.col("is_link") & _attribute("attributes", "rel").rlike(rf"(?i)(?:^|{_BLANK})canonical(?:{_BLANK}|$)")
    refresh = ~F.col("is_link") & _attribute("attributes", "http-equiv").rlike("(?i)^refresh$")
    link = F.when(canonical, _attribute("attributes", "href")).when(
        refresh, _one_of_three(_attribute("attributes", "content"), _REFRESH)
    )
    found = found.withColumn("link", link).where("link is not null")
    edges = found.select(
        resource_of(F.col("url")).alias("a"), resource_of(_target(F.col("url"), F.col("link"))).alias("b")
    )
    return edges.where("a is not null and b is not null")


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], redirects: DataFrame | None = None
) -> DataFrame:
    """page_id, host, path, rule and verdict of every page row.

    A url with a rule of its own has that rule's verdict: an explicit allow is not overruled. Any other is
    blocked if a resource joined to it by redirects or canonical links, over any number of steps, is blocked
    by a rule; else it is allowed. Resources that only links name count as well. ``redirects`` (source,
    target) adds logged redirects to the canonical links and refreshes found in the html.

    A null url, or one without ``://``, has empty host and path and no aliases. Repeated rows are judged
    each. Other columns are not read. An empty table gives no rows.
    """
    html = "html:string" if "html" in pages.columns else None
    base = plain(pages, page_id="page_id:long", url="url:string", **({"html": html} if html else {}))
    if html:
        edges = link_edges(base.select("url", "html").where("html is not null"))
    else:
        edges = base.select(*(F.lit(None).cast("string").alias(k) for k in "ab")).where(F.lit(False))
    if redirects is not None:
        logged = plain(redirects, source="source:string", target="target:string")
        edges = edges.union(logged.select(resource_of(F.col("source")), resource_of(F.col("target"))))
    edges = stored(edges.where("a is not null and b is not null and a != b").distinct(), "links")
    # A resource has the form host/path?query, so a scheme in front makes it a url again.
    known = components(edges).withColumn("url", F.concat(F.lit("x://"), "node"))
    known = known.withColumn("own", matching(host_of(F.col("url")), path_of(F.col("url")), rules, 0))
    bad = known.where("own = 'block'").select("component").distinct()
    spread = known.where("own is null").join(bad, "component").select(F.col("node").alias("resource"))
    judged = base.drop("html").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    judged = judged.withColumns(
        {
            "rule": matching(F.col("host"), F.col("path"), rules, None),
            "own": matching(F.col("host"), F.col("path"), rules, 0),
            "resource": resource_of(F.col("url")),
        }
    )
    hit = spread.withColumn("hit", F.lit(True))
    verdict = F.coalesce("own", F.when(F.col("hit"), "block").otherwise("allow"))
    return judged.join(hit, "resource", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"))
