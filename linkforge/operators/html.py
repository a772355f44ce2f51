"""HTML pages to events, links, metadata and detail records.

Tokenizing HTML needs a state machine, so pages pass through the standard parser in Arrow batches; everything
after the events is relational."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from linkforge.functions.text import clean_text, first_present, normalize_title, artist_names, strip_site_suffix
from linkforge.functions.urls import absolute, is_http, host, normalize_url, url_year
from linkforge.functions.values import completeness, record_id
from linkforge.runtime import ship

# Tags that end a line of text.
BLOCK_TAGS = frozenset("address article aside blockquote br div dl dt dd figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
# Class or id tokens of detail pages and the field that text below them belongs to.
TOKEN_FIELDS = {
    "title": "title", "installation-title": "title", "art-title": "title", "artist": "artist", "artists": "artist", "artist-name": "artist",
    "artist-collective": "artist_collective", "collective": "artist_collective", "artist-location": "artist_location", "description": "description",
    "materials": "materials", "dimensions": "dimensions", "location-on-site": "location_on_site", "site-location": "location_on_site",
    "photographer": "photographer_credit", "photographer-credit": "photographer_credit", "image-credit": "image_credit_text", "credit": "image_credit_text",
    "event-name": "event_name", "event-theme": "event_theme", "installation-type": "installation_type", "honoraria-status": "honoraria_status",
    "funding-status": "funding_status", "year": "year", "project-url": "project_url",
}
FIELDS = tuple(dict.fromkeys(TOKEN_FIELDS.values()))


def _clean(text: str | None) -> str:
    return " ".join((text or "").split())


class _Page(HTMLParser):
    """One pass over a page: line events, links, meta values and text by field."""

    def __init__(self, tokens: dict[str, str] = TOKEN_FIELDS):
        super().__init__(convert_charrefs=True)
        self.tokens = tokens
        self.events: list[dict] = []
        self.links: list[dict] = []
        self.meta: dict[str, str] = {}
        self.fields: dict[str, list[str]] = {}
        self._hrefs: list[str | None] = []
        self._anchors: list[int] = []
        self._open: list[tuple[str, frozenset[str]]] = []

    def _event(self, kind: str, value: str = "", href: str | None = None, alt: str | None = None) -> None:
        self.events.append({"pos": len(self.events), "kind": kind, "value": value, "href": href, "alt": alt})

    def handle_starttag(self, tag, attrs):
        a = {k.lower(): v for k, v in attrs}
        names = set((a.get("class") or "").lower().split()) | ({a["id"].lower()} if a.get("id") else set())
        found = {self.tokens[n] for n in names if n in self.tokens} | ({"h1", "title"} if tag == "h1" else set())
        self._open.append((tag, frozenset(found)))
        if tag in BLOCK_TAGS:
            self._event("break")
        if tag == "a":
            self._hrefs.append(a.get("href"))
            if a.get("href"):
                self._anchors.append(len(self.links))
                self.links.append({"pos": len(self.links), "href": a["href"], "text": "", "rel": a.get("rel"), "css": a.get("class")})
        elif tag == "img" and a.get("src"):
            self._event("image", a["src"], alt=a.get("alt"))
        elif tag == "link" and a.get("href"):
            rel = (a.get("rel") or "").lower()
            if rel == "canonical":
                self.meta["canonical"] = a["href"]
            elif "alternate" in rel and any(x in (a.get("type") or "").lower() for x in ("rss", "atom", "xml")):
                self.meta["feed"] = self.meta.get("feed") or a["href"]
        elif tag == "meta":
            name = (a.get("property") or a.get("name") or "").lower()
            if name in ("og:image", "twitter:image", "twitter:image:src") and "image" not in self.meta:
                self.meta["image"] = (a.get("content") or "").strip()

    def handle_endtag(self, tag):
        if self._open:
            self._open.pop()
        if tag == "a":
            if self._hrefs:
                self._hrefs.pop()
            if self._anchors:
                self._anchors.pop()
        if tag in BLOCK_TAGS:
            self._event("break")

    def handle_data(self, data):
        text = _clean(data)
        if not text:
            return
        self._event("text", text, href=self._hrefs[-1] if self._hrefs else None)
        if self._anchors:
            link = self.links[self._anchors[-1]]
            link["text"] = _clean(f"{link['text']} {text}")
        if self._open and self._open[-1][0] == "title":
            self.meta["title"] = _clean(f"{self.meta.get('title', '')} {text}")
        for key in frozenset().union(*(names for _, names in self._open)):
            self.fields.setdefault(key, []).append(text)


_EVENT = "struct<pos:int,kind:string,value:string,href:string,alt:string>"
_LINK = "struct<pos:int,href:string,text:string,rel:string,css:string>"
SCHEMA = f"events array<{_EVENT}>, links array<{_LINK}>, title string, canonical string, image string, feed string, fields map<string,string>, error string"
_ARROW = [
    ("events", pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("value", pa.string()), ("href", pa.string()), ("alt", pa.string())]))),
    ("links", pa.list_(pa.struct([("pos", pa.int32()), ("href", pa.string()), ("text", pa.string()), ("rel", pa.string()), ("css", pa.string())]))),
    *[(n, pa.string()) for n in ("title", "canonical", "image", "feed")],
    ("fields", pa.map_(pa.string(), pa.string())),
    ("error", pa.string()),
]
#: Rows that one step of the parser turns into Python objects.
STEP = 64


def parse_pages(pages: DataFrame, page: str = "page_id", html: str = "html", tokens: dict[str, str] = TOKEN_FIELDS) -> DataFrame:
    """page (its own type), events, links, title, canonical, image, feed, fields, error for every page. A page
    that fails to parse keeps what came before and its error; it fails no other."""
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                out: dict[str, list] = {n: [] for n, _ in _ARROW}
                for text in part.column("html").to_pylist():
                    parser, error = _Page(tokens), None
                    try:
                        parser.feed(text or "")
                        parser.close()
                    except Exception as e:
                        error = str(e)
                    out["events"].append(parser.events)
                    out["links"].append(parser.links)
                    for n in ("title", "canonical", "image", "feed"):
                        out[n].append(parser.meta.get(n))
                    out["fields"].append([(k, _clean(" ".join(v))) for k, v in sorted(parser.fields.items())])
                    out["error"].append(error)
                yield pa.RecordBatch.from_arrays([part.column("page"), *[pa.array(out[n], t) for n, t in _ARROW]], names=["page", *[n for n, _ in _ARROW]])

    kind = dict(pages.dtypes)[page]
    return pages.select(F.col(page).alias("page"), F.col(html).alias("html")).mapInArrow(run, f"page {kind}, {SCHEMA}")


def page_events(parsed: DataFrame) -> DataFrame:
    return parsed.select("page", F.explode("events").alias("e")).select("page", "e.*")


def page_links(parsed: DataFrame) -> DataFrame:
    return parsed.select("page", F.explode("links").alias("e")).select("page", "e.*")


def hrefs(html: Column) -> Column:
    """Targets of links with double-quoted href, by pattern alone: for pages where exactness allows it."""
    return F.regexp_extract_all(html, F.lit(r'(?is)<a\b[^>]*?\bhref="([^"]*)"'), F.lit(1))


def title_text(html: Column) -> Column:
    return F.nullif(clean_text(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


#: Fields of a record that completeness does not consider.
UNCOUNTED = ("missing_fields", "warnings", "parsing_errors", "needs_manual_review", "extraction_confidence")


def finalize(records: DataFrame) -> DataFrame:
    """Add missing_fields, warnings, extraction_confidence and needs_manual_review."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "[]")
    wanted = ("title", "artist_display_text", "description", "primary_image_url", "photographer_credit")
    have = [c for c in wanted if c in records.columns]
    missing = F.array_compact(F.array(*[F.when(empty(c), F.lit(c)) if c in have else F.lit(c) for c in wanted]))
    said = (("artist_display_text", "Artist information was not found."), ("primary_image_url", "No image URL was found."), ("photographer_credit", "Photographer credit was not found."))
    records = records.withColumn("missing_fields", missing)
    return records.withColumns({
        "warnings": F.array_compact(F.array(*[F.when(F.array_contains("missing_fields", f), F.lit(w)) for f, w in said])),
        "extraction_confidence": completeness([F.col(c) for c in records.columns if c not in UNCOUNTED]),
        "needs_manual_review": F.size("missing_fields") > 0,
    })


def detail_records(parsed: DataFrame, url: Column, own_host: str) -> DataFrame:
    """One record for each detail page: fields by class or id of any open ancestor, images, external links."""
    f = lambda k: F.nullif(F.col("fields")[k], F.lit(""))
    images = F.array_distinct(F.transform(F.filter("events", lambda e: e["kind"] == "image"), lambda e: normalize_url(absolute(F.col("source_url"), e["value"]))))
    outside = F.filter(F.transform("links", lambda x: absolute(F.col("source_url"), x["href"])), lambda u: is_http(u) & (host(u) != own_host))
    base = parsed.withColumn("source_url", url)
    canonical = F.when(F.col("canonical").isNotNull(), absolute(F.col("source_url"), F.col("canonical"))).otherwise(F.col("source_url"))
    out = base.select(
        "page", "source_url", normalize_url(canonical).alias("canonical_source_url"), record_id(normalize_url(canonical)).alias("record_id"),
        first_present(f("title"), f("h1"), strip_site_suffix(F.col("title"))).alias("title"), f("artist").alias("artist_display_text"),
        *[f(k).alias(k) for k in FIELDS if k not in ("title", "artist", "year", "project_url")],
        F.coalesce(f("year"), url_year(F.col("source_url"))).alias("year"), images.alias("image_urls"), F.array_distinct(outside).alias("external_links"), "error",
    )
    out = out.withColumns({"normalized_title": normalize_title(F.col("title")), "artist_names": artist_names(F.col("artist_display_text")), "primary_image_url": F.get("image_urls", F.lit(0)), "website_url": F.get("external_links", F.lit(0))})
    return finalize(out)
