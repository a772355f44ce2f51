"""URL functions. URLs are taken apart by one pattern, leniently: host names with underscores and paths with
blanks do not make them NULL, as they would with the built-in parser."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from linkforge.functions.text import any_in, clean_cell, lit_array, strip, text_of

#: Query parameters that only track visitors.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid")
#: scheme, authority, path, query, fragment
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, which: int) -> Column:
    return F.regexp_extract(url, PARTS, which)


def host(url: Column) -> Column:
    """Lower-case host without user and port; '' if there is none."""
    return F.lower(F.regexp_extract(text_of(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/?#]*@)?([^/:?#]+)", 1))


def path(url: Column) -> Column:
    return part(text_of(url), 3)


def fragment(url: Column) -> Column:
    return part(text_of(url), 5)


def defragment(url: Column) -> Column:
    return F.regexp_replace(url, "(?s)#.*$", "")


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def normalize_url(url: Column) -> Column:
    """Lower-case scheme and authority, no tracking parameters, parameters sorted and encoded anew, no fragment."""
    u = strip(url)
    pairs = F.filter(F.split(part(u, 4), "&"), lambda p: p != "")
    named = F.transform(pairs, lambda p: F.struct(_decode(F.substring_index(p, "=", 1)).alias("k"), F.when(F.contains(p, F.lit("=")), _decode(F.regexp_replace(p, "^[^=]*=", ""))).otherwise("").alias("v")))
    kept = F.array_sort(F.filter(named, lambda p: ~p["k"].isin(*TRACKING)))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))), "&")
    scheme, authority = F.lower(part(u, 1)), F.lower(part(u, 2))
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(authority != "", F.concat(F.lit("//"), authority)).otherwise(""),
        part(u, 3),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
    )


def candidate_url(url: Column) -> Column:
    """The normalized URL with its fragment attached again."""
    f = fragment(strip(url))
    return F.when(f != "", F.concat(normalize_url(url), F.lit("#"), f)).otherwise(normalize_url(url))


def absolute(base: Column, href: Column) -> Column:
    """``href`` resolved against ``base``: absolute, protocol-relative, rooted, query, fragment or relative path.
    Dot segments are removed."""
    root = F.concat(part(base, 1), F.lit("://"), part(base, 2))
    folder = F.regexp_replace(part(base, 3), "[^/]*$", "")
    joined = (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(part(base, 1), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href == "", base)
        .when(href.startswith("?"), F.concat(root, part(base, 3), href))
        .when(href.startswith("#"), F.concat(defragment(base), href))
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), href))
    )
    for _ in range(3):  # a/../ and ./ inside the path
        joined = F.regexp_replace(F.regexp_replace(joined, r"(?<=[^:/]/)\./", ""), r"(?<=[^:/])/(?!\.\./)[^/?#]+/\.\./", "/")
    return joined


def is_http(url: Column) -> Column:
    """An absolute http(s) URL with an authority."""
    return text_of(url).rlike("(?i)^https?://[^/?#]+")


def http_url(url: Column) -> Column:
    """The cleaned cell if it is an http(s) URL, else ''."""
    cell = clean_cell(url)
    return F.when(is_http(cell), cell).otherwise("")


def url_year(url: Column) -> Column:
    """The year of a yyyy parameter, else of a /19dd/ or /20dd/ path segment; NULL if none."""
    given = F.regexp_extract(text_of(url), r"[?&]yyyy=((?:19|20)\d{2})(?:&|#|$)", 1)
    segment = F.regexp_extract(F.concat(path(url), F.lit("/")), r"/((?:19|20)\d{2})/", 1)
    return F.coalesce(F.nullif(given, F.lit("")), F.nullif(segment, F.lit("")))


def collection(url: Column) -> Column:
    """The last segment of the path; NULL for the root."""
    return F.nullif(F.element_at(F.split(F.btrim(path(url), F.lit("/")), "/"), -1), F.lit(""))


def page_kind(url: Column, detail_markers, listing_path: str) -> Column:
    """Detail page, listing, filtered listing or unsupported page, by path and query."""
    rooted = F.concat(F.rtrim(path(url), F.lit("/")), F.lit("/"))
    return (
        F.when(any_in(F.lower(path(url)), detail_markers), "single installation detail page")
        .when((rooted == listing_path) & (part(url, 4) != ""), "filtered archive listing page")
        .when(rooted == listing_path, "archive listing page")
        .otherwise("unsupported page")
    )


def uid_of(url: Column, pattern: str = "a2I[A-Za-z0-9]+") -> Column:
    """A record id carried as the whole fragment; NULL if there is none."""
    return F.nullif(F.regexp_extract(text_of(url), f"#({pattern})$", 1), F.lit(""))


def external_domain(url: Column, own_host: str) -> Column:
    """Host without 'www.', NULL for the own archive."""
    h = host(url)
    return F.when((h != "") & ~h.endswith(own_host), F.regexp_replace(h, r"^www\.", ""))


def host_in(url: Column, fragments) -> Column:
    return any_in(host(url), fragments)


#: Parts of URLs that are no pictures of a project.
REJECTED = ("logo", "favicon", "avatar", "profile", "sprite", "icon-", "/icon")


def rejected_image(url: Column) -> Column:
    return any_in(F.lower(text_of(url)), REJECTED)


#: Pages of a personal site that tell who its owner is.
ABOUT_PATHS = ("/about", "/about/", "/about-me", "/about-me/", "/bio", "/bio/", "/artist", "/artist/", "/contact", "/contact/")
FEED_PATHS = ("/feed", "/rss", "/rss.xml", "/atom.xml")


def site_urls(seed: Column, paths=ABOUT_PATHS) -> Column:
    """The seed and the given paths on its host, distinct in order."""
    base = F.concat(part(seed, 1), F.lit("://"), part(seed, 2))
    return F.when(is_http(seed), F.array_distinct(F.concat(F.array(seed), F.transform(lit_array(paths), lambda p: F.concat(base, p))))).otherwise(F.array(seed))


def blocked_host(url: Column, domains) -> Column:
    """The host is, or is below, one of the domains; no host counts as blocked."""
    h = host(url)
    below = F.lit(False)
    for d in domains:
        below = below | (h == d) | h.endswith("." + d)
    return (h == "") | below
