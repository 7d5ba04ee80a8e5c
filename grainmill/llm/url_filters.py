"""Operator 13: URL rules by host and path, with decisions to block carried to aliases along redirects and canonical links."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm.common import drop_table, small, table
from grainmill.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST, PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"
#: What browsers do not read as tags.
UNREAD = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
LINK, META = r"(?is)<link\s[^>]*>", r"(?is)<meta\s[^>]*>"
CANONICAL, REFRESH = r"""(?is)\srel\s*=\s*["']?canonical["'\s/>]""", r"""(?is)\shttp-equiv\s*=\s*["']?refresh["'\s/>]"""
HREF, CONTENT = r"""(?is)\shref\s*=\s*["']?\s*([^"'\s>]+)""", r"""(?is)url\s*=\s*["']?\s*([^"'\s>]+)"""


class Rule(NamedTuple):
    """verdict: allow or block; host: it and its subdomains; path: how a url's path begins."""

    verdict: str
    host: str
    path: str


def host(url: Column) -> Column:
    """Between the first :// and the next / ? # or end, A-Z in lower case; empty for nulls and without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, HOST, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """Behind the host, up to ? # or end."""
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")


def with_rule(df: DataFrame, rules: DataFrame, host: str = "host", path: str = "path", to: str = "_rule") -> DataFrame:
    """df with the longest of the rules that fit, as `to`: a struct of rule (host and path) and verdict; null if none fits.

    Rules are grouped by host and by its number of labels; for each such number the last labels of df's hosts are looked up,
    by a broadcast if the rules are few (counted), else by a join. Rows of df are neither repeated nor regrouped.
    Of rules of one length the one of the longer host comes first, of equal ones with both verdicts the one that allows.
    """
    clean = rules.select(F.translate("host", UPPER, LOWER).alias("h"), F.coalesce("path", F.lit("")).alias("p"), "verdict").where("h IS NOT NULL AND verdict IS NOT NULL")
    entry = F.struct(F.length(F.concat("h", "p")).alias("n"), F.length("h").alias("hn"), (F.col("verdict") == "allow").alias("ok"), F.concat("h", "p").alias("rule"), "verdict", F.col("p").alias("path"))
    hosts = table(clean.withColumn("m", F.size(F.split("h", r"\."))).groupBy("m", "h").agg(F.collect_set(entry).alias("of"), F.sum(F.length("h") + F.length("p") + 64).alias("bytes")), "rules")
    fits = []
    for m, n, most in sorted(tuple(r) for r in hosts.groupBy("m").agg(F.count("*"), F.max("bytes")).collect()):  # one row for each number of labels
        side = hosts.where(F.col("m") == m).select(F.col("h").alias("_gm_key"), F.col("of").alias(f"_gm_{m}"))
        df = df.withColumn("_gm_key", F.substring_index(host, ".", -m)).join(small(side, most, n), "_gm_key", "left").drop("_gm_key")
        fits.append(f"_gm_{m}")
    if not fits:
        return df.withColumn(to, F.lit(None).cast("struct<rule: string, verdict: string>"))
    best = F.array_max(F.concat(*[F.filter(F.coalesce(c, F.array().cast(hosts.schema["of"].dataType)), lambda r: F.startswith(df[path], r["path"])) for c in fits]))
    return df.withColumn("_gm_best", best).withColumn(to, F.when(F.col("_gm_best").isNotNull(), F.struct("_gm_best.rule", "_gm_best.verdict"))).drop("_gm_best", *fits)


def url_key(url: Column) -> Column:
    """What tells urls apart: scheme and host in lower case, an empty path as /, without the fragment. Null for nulls and without ://."""
    scheme, query = F.translate(F.regexp_extract(url, r"(?s)^(.*?)://", 1), UPPER, LOWER), F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    at = path(url)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host(url), F.when(at == "", "/").otherwise(at), query))


def resolved(link: Column, base: Column) -> Column:
    """A link of the page `base` as a whole url. Dot segments stay as they are."""
    link = F.replace(link, F.lit("&amp;"), F.lit("&"))
    scheme, site = F.regexp_extract(base, r"(?s)^(.*?)://", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path(base), r"(?s)^(.*/)", 1), F.lit("")), F.lit("/"))
    return (
        F.when(F.regexp_like(link, F.lit(r"(?i)^[a-z][a-z0-9+.-]*://")), link).when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(site, link)).when(F.startswith(link, F.lit("?")), F.concat(site, path(base), link)).when(F.startswith(link, F.lit("#")), base)
        .otherwise(F.concat(site, folder, link))
    )


def page_links(pages: DataFrame) -> DataFrame:
    """a, b: keys of each page's url and of what its canonical link and its refreshes lead to; not to itself."""
    html = F.regexp_replace(F.coalesce("html", F.lit("")), UNREAD, " ")
    tags = lambda pattern, kind, value: F.transform(F.filter(F.regexp_extract_all("_h", F.lit(pattern), F.lit(0)), lambda t: F.regexp_like(t, F.lit(kind))), lambda t: F.regexp_extract(t, value, 1))
    # A page without any such tag is not taken apart.
    some = F.regexp_like(F.coalesce("html", F.lit("")), F.lit(r"(?i)canonical|refresh"))
    held = pages.where(F.instr("url", "://") > 0).where(some).select(F.col("url").alias("_u"), html.alias("_h"))
    links = held.select("_u", F.explode(F.concat(tags(LINK, CANONICAL, HREF), tags(META, REFRESH, CONTENT))).alias("_l")).where("_l != ''")
    return links.select(url_key(F.col("_u")).alias("a"), url_key(resolved(F.col("_l"), F.col("_u"))).alias("b")).where("a != b").distinct()


def blocked_aliases(links: DataFrame, rules: DataFrame) -> DataFrame:
    """key: urls of links (a, b: url keys) that no rule fits and that links, in either direction, connect to one that a rule blocks.

    Urls get numbers from a written table, so different ones are never taken as one. Links are written before their ends
    are looked up, and the blocked components before their members are: a url that very many pages lead to is split.
    """
    links = table(links, "links")
    urls = links.select(F.col("a").alias("key")).union(links.select("b")).distinct()
    nodes = table(with_rule(urls.withColumns({"host": host(F.col("key")), "path": path(F.col("key"))}), rules).select("key", F.monotonically_increasing_id().alias("node"), F.col("_rule.verdict").alias("verdict")), "urls")
    number = lambda end: nodes.select(F.col("key").alias(end), F.col("node").alias(f"n{end}"))
    edges = table(links.join(small(number("a"), 256), "a").join(small(number("b"), 256), "b").select(F.col("na").alias("a"), F.col("nb").alias("b")), "edges")
    member = table(connected_components(edges), "members")
    of = nodes.join(small(member, 16), "node")
    blocked = table(of.where("verdict = 'block'").select("root").distinct(), "blocked")
    out = table(nodes.where("verdict IS NULL").join(small(member, 16), "node").join(small(blocked, 8), "root", "left_semi").select("key"), "aliases")
    for t in (links, nodes, edges, member, blocked):
        drop_table(t)
    return out


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, alias of every page.

    A rule fits its host and all subdomains if the url's path begins with the rule's; the longest decides, whatever
    aliases say: an explicit allow is never overruled. A url that no rule fits is blocked (alias: true) if redirects and
    canonical links, followed in both directions and over any number of urls, connect it to one that a rule blocks; else
    it is allowed. Links are those of the pages' own tags (canonical links, refreshes) and of `redirects` (src, dst: whole
    urls, such as a crawler's log); urls that are no pages themselves connect others as well.

    Null urls and such without :// have an empty host and path, fit no rule and are allowed. A null html has no links.
    Pages with one url get one verdict; repeated rows are returned each. An empty table gives no rows; columns of
    other names do not matter. Long pages are searched whole.
    """
    links = page_links(pages)
    if redirects is not None:
        logged = redirects.select(url_key(F.col("src")).alias("a"), url_key(F.col("dst")).alias("b")).where("a != b")
        links = links.unionByName(logged).distinct()
    aliases = blocked_aliases(links, rules).withColumn("_alias", F.lit(True))
    rows = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), url_key(F.col("url")).alias("key"))
    rows = with_rule(rows, rules).join(small(aliases, 256), "key", "left")
    hit = F.col("_rule").isNull() & F.coalesce("_alias", F.lit(False))
    return rows.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", F.when(hit, "block").otherwise("allow")).alias("verdict"), hit.alias("alias"))
