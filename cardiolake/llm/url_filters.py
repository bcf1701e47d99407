"""URL filters with redirect equivalence (DataFrame functions only).

Rules ``(host, path, verdict)`` fit a host and its subdomains when the url's path starts with the rule's; the longest fitting
rule wins (host plus path; ties to the smaller rule text). Urls that redirects, refresh headers in the markup or canonical
links tie together form components, found by distributed star rounds. A url without a rule of its own is blocked when its
component has a blocked url; a url with its own allow rule stays allowed whatever its aliases are, and shields nothing else.

Aliases are compared without their fragment, with scheme and host in small letters and ``/`` for an empty path. Links are taken from
every ``<link rel=canonical>`` and ``<meta http-equiv=refresh>`` outside of comments (protocol-relative, root-relative and plain
relative targets are resolved, with their ``.`` and ``..``), and from a table of redirects where given.

Defined cases: a null url or one without ``://`` has empty host and path, no rule and no alias, and is allowed; null HTML has
no links; rows that repeat a page each get a row; very long urls and pages are taken whole; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _node(url: Column) -> Column:
    """A url as a node of the graph of aliases."""
    site = F.translate(F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), UPPER, LOWER)
    rest = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"(?s)^.*?://[^/?#]*", "")
    return F.when(url.contains("://"), F.concat(site, F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def _without_dots(url: Column) -> Column:
    """A url whose path has its ``.`` and ``..`` resolved."""
    site, path = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1), path_of(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    parts = F.split(path, "/", -1)
    up = lambda a: F.when(F.size(a) > 1, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", up(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    # a path that ends in a dot part is a folder
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(F.arrays_overlap(parts, F.array(F.lit("."), F.lit(".."))), F.concat(site, F.array_join(kept, "/"), query)).otherwise(url)


# Comments and elements whose content is no markup, each up to its end or the page's.
_NO_MARKUP = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|xmp|iframe|noembed|noframes|noscript|template)(?=[\s/>]).*?(?:</\1(?=[\s/>]|\z)|\z)"
# A tag that may hold a link; quoted values may hold a ">". The bound keeps the matcher's stack small: a tag of over a thousand quoted
# values is taken for text.
_TAG = r"""(?is)<(?:link|meta)(?=[\s/>])(?:[^>"']++|"[^"]*+"|'[^']*+'){0,2000}+>"""
_ATTRIBUTE = r"""(?s)([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*)))?"""


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(src, dst)`` from canonical links and refreshes in the markup of ``pages``."""
    page = pages.where(F.col(html).rlike("(?i)canonical|http-equiv") & F.col(url).contains("://")).select(F.regexp_replace(F.col(url), r"(?s)#.*$", "").alias("src"), F.regexp_replace(html, _NO_MARKUP, " ").alias("h"))
    tags = page.select("src", F.explode(F.regexp_extract_all("h", F.lit(_TAG), F.lit(0))).alias("tag"))
    # attributes one by one, so that neither names inside other values nor longer names count; the first of a name does
    pairs = F.transform(F.regexp_extract_all(F.regexp_replace("tag", r"(?s)^<[A-Za-z]+|/?>$", ""), F.lit(_ATTRIBUTE), F.lit(0)), lambda x: F.struct(F.lower(F.regexp_extract(x, _ATTRIBUTE, 1)).alias("name"), F.concat(*[F.regexp_extract(x, _ATTRIBUTE, i) for i in (2, 3, 4)]).alias("value")))
    named = tags.select("src", F.lower(F.regexp_extract("tag", "^<([A-Za-z]+)", 1)).alias("tag"), pairs.alias("pairs"))
    value = lambda name: F.get(F.filter("pairs", lambda x: x["name"] == name), F.lit(0))["value"]
    words = F.split(F.lower(value("rel")), r"[ \t\n\f\r]+")
    canonical = F.when((F.col("tag") == "link") & F.array_contains(words, "canonical"), F.regexp_replace(value("href"), r"^[ \t\n\f\r]+|[ \t\n\f\r]+$", ""))
    refresh = F.when((F.col("tag") == "meta") & (F.lower(F.trim(value("http-equiv"))) == "refresh"), F.regexp_extract(value("content"), r"""(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*["']?\s*([^"'\s]+)""", 1))
    link = named.select("src", F.coalesce(canonical, refresh).alias("to")).where("to <> ''").withColumn("to", F.replace("to", F.lit("&amp;"), F.lit("&")))
    scheme, site = F.regexp_extract("src", r"(?s)^(.*?):", 1), F.regexp_extract("src", r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract("src", r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    to = F.col("to")
    whole = F.when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.startswith("//"), F.concat(scheme, F.lit(":"), to)).when(to.startswith("/"), F.concat(site, to)).otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), to))
    return link.select(_node(F.col("src")).alias("src"), _node(_without_dots(whole)).alias("dst"))


def apply_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (distinct, in column ``url``) with ``host``, ``path``, ``rule`` and ``own`` (the rule's verdict).

    Every suffix of a host meets the rules of that host by an equi-join; the rows of a hot suffix can be split, and Spark
    broadcasts the rules only while they are small."""
    u = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    r = rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("own"))
    fit = u.where("host <> ''").select("url", "path", F.explode(suffixes).alias("rule_host")).join(r, "rule_host").where(F.col("path").startswith(F.col("rule_path")))
    text = F.concat("rule_host", "rule_path")
    best = fit.groupBy("url").agg(F.min(F.struct((-F.length(text)).alias("n"), text.alias("rule"), "own")).alias("b")).select("url", "b.rule", "b.own")
    return u.join(best, "url", "left")


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """``(page_id, host, path, rule, verdict, alias_blocked)`` of every row of ``pages(page_id, url, html)``.

    ``rules(host, path, verdict)``; ``redirects(src, dst)`` adds edges between urls."""
    links = page_links(pages)
    if redirects is not None:
        links = links.union(redirects.select(_node(F.col("src")), _node(F.col("dst"))))
    label = connected_components(links)
    known = pages.select("url").where("url IS NOT NULL").distinct()
    own = apply_rules(known, rules)
    # only urls of components carry decisions further; targets may lie outside of the table
    tied = apply_rules(label.select(F.col("node").alias("url")), rules).where("own = 'block'").select(F.col("url").alias("node"))
    hit = label.join(tied, "node").select("component").distinct()
    blocked = label.join(hit, "component").select("node", F.lit(True).alias("alias_blocked"))
    out = own.withColumn("node", _node(F.col("url"))).join(blocked, "node", "left").drop("node")
    verdict = F.when(F.col("own").isNotNull(), F.col("own")).when(F.col("alias_blocked"), "block").otherwise("allow")
    out = out.select("url", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("alias_blocked", F.lit(False)).alias("alias_blocked"))
    got = pages.select("page_id", "url").join(out, "url", "left")
    return got.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.coalesce("alias_blocked", F.lit(False)).alias("alias_blocked"))
