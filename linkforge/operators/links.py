"""Link routing and discovery: one CASE for the reason, aggregates for first occurrences, ranks and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from linkforge.functions.text import any_in, text_of, tokens
from linkforge.functions.urls import absolute, defragment, fragment, host, normalize_url, part, path
from linkforge.operators.lines import is_donate_link, starts_with_any
from linkforge.operators.ordering import first_wins
from linkforge.profile import DEFAULT, Profile


def is_detail_url(url: Column, p: Profile = DEFAULT) -> Column:
    return any_in(F.lower(path(url)), p.detail_markers)


def is_discovery_url(url: Column, p: Profile = DEFAULT) -> Column:
    rooted = F.concat(F.rtrim(path(url), F.lit("/")), F.lit("/"))
    return rooted.isin(*p.discovery_paths) | F.contains(rooted, F.lit(p.listing_path))


def is_pagination(url: Column, rel: Column, css: Column) -> Column:
    query = F.concat(F.lit("&"), part(url, 4), F.lit("&"))
    return query.rlike("&(page|paged)=[^&]") | any_in(F.lower(F.concat_ws(" ", rel, css)), ("next", "prev", "pagination"))


def route_links(links: DataFrame, page_url: Column, p: Profile = DEFAULT) -> DataFrame:
    """page, pos, url, reason for links (page, pos, href, text, rel, css). Reasons: candidate, or why a link is
    left out; links to fragments of the page itself are dropped without one."""
    l = links.withColumn("_final", page_url).withColumn("_bare", defragment(F.trim("href"))).withColumn("_frag", fragment(F.trim("href")))
    l = l.withColumn("_abs", normalize_url(absolute(F.col("_final"), F.col("_bare"))))
    silent = (F.col("_frag") != "") & ((F.col("_bare") == "") | (F.col("_abs") == normalize_url(F.col("_final"))))
    donate = is_donate_link(F.col("text"), F.col("href"), F.col("css"))
    other = starts_with_any(F.col("_bare"), ("mailto:", "tel:", "javascript:"))
    u = F.col("_abs")
    reason = (
        F.when(donate, "donate_link_ignored")
        .when((F.col("_frag") != "") & (F.col("_bare") == ""), None)
        .when(F.col("_bare") == "", "empty_or_fragment_link")
        .when(other, "non_http_link")
        .when(silent, None)
        .when(host(u) != p.archive_host, "external_website")
        .when(is_pagination(u, F.col("rel"), F.col("css")), "pagination_not_authorized")
        .when(is_detail_url(u, p), "candidate")
        .when(is_discovery_url(u, p), "archive_or_discovery_page_outside_boundary")
        .otherwise("internal_non_installation_link")
    )
    shown = F.when(reason.isin("empty_or_fragment_link", "non_http_link"), F.col("href")).otherwise(u)
    return l.select("page", "pos", shown.alias("url"), reason.alias("reason")).where("reason is not null")


def candidates(routed: DataFrame) -> DataFrame:
    """The first place of each candidate of a page, in order."""
    return first_wins(routed.where("reason = 'candidate'"), [F.col("page"), F.col("url")], F.col("pos"))


def first_per_group(df: DataFrame, group: list[str], key: Column, order: str, most: int) -> DataFrame:
    """Distinct by key (first wins) and capped per group, in order. The cap is the operator's purpose."""
    one = first_wins(df, [*[F.col(g) for g in group], key], F.col(order))
    return one.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(order))).where(F.col("_n") <= most).drop("_n")


def same_domain(df: DataFrame, seed: Column, url: Column, group: list[str], order: str, most: int = 200) -> DataFrame:
    resolved = df.withColumn("url", defragment(absolute(seed, url))).where(host(F.col("url")) == host(seed))
    return first_per_group(resolved, group, F.col("url"), order, most)


def sitemap_urls(xml: Column) -> Column:
    """Every loc of a sitemap or sitemap index, in order; nothing recurses."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda u: F.replace(u, F.lit("&amp;"), F.lit("&")))


def rank_candidates(df: DataFrame, record_text: Column, url: str = "url") -> DataFrame:
    """Five points for each token of a record in a URL; those without any go; by falling score, then URL."""
    words = F.filter(tokens(record_text), lambda t: F.length(t) > 2)
    low = F.lower(text_of(F.col(url)))
    return df.withColumn("score", 5 * F.size(F.filter(words, lambda t: F.contains(low, t)))).where("score > 0").orderBy(F.desc("score"), url)
