"""Listing pages to records: tokens, lines, starts, blocks, fields, images; detail pages to records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from linkforge.functions.text import artist_names, first_present, normalize_title
from linkforge.functions.urls import absolute, candidate_url, host, normalize_url, uid_of, url_year
from linkforge.functions.values import record_id
from linkforge.operators.html import finalize, page_events, parse_pages
from linkforge.operators.lines import block_fields, block_images, blocks, coalesce_lines, record_starts
from linkforge.profile import DEFAULT, Profile


def inline_records(pages: DataFrame, page_url: Column, p: Profile = DEFAULT) -> DataFrame:
    """Records of listing pages (page_id, url, html): position, source_url, title, labelled fields, images."""
    events = page_events(parse_pages(pages))
    records = block_images(block_fields(blocks(record_starts(coalesce_lines(events)))), events)
    own = pages.select(F.col("page_id").alias("page"), page_url.alias("_page_url"))
    out = records.join(own, "page")
    target = absolute(F.col("_page_url"), F.coalesce("title_href", F.lit("")))
    source = F.when(F.col("title_href").isNotNull() & (host(target) == p.archive_host), candidate_url(target)).otherwise(normalize_url(F.col("_page_url")))
    out = out.withColumn("source_url", source).withColumn("image_urls", F.array_distinct(F.transform("image_urls", lambda u: normalize_url(absolute(F.col("_page_url"), u)))))
    return out.drop("title_href", "title_pos")


def installation_records(inline: DataFrame, archive_url: Column, p: Profile = DEFAULT) -> DataFrame:
    """Inline records as installation records with completeness and warnings."""
    out = inline.select(
        "page", "source_position", record_id(F.col("source_url")).alias("record_id"), "source_url", F.col("source_url").alias("canonical_source_url"), archive_url.alias("source_archive_url"), "title",
        normalize_title(F.col("title")).alias("normalized_title"), first_present(F.col("year"), url_year(archive_url)).alias("year"), F.lit("Installation").alias("installation_type"),
        "artist_display_text", artist_names(F.col("artist_display_text")).alias("artist_names"), "artist_location", "description", "website_url", F.col("website_url").alias("project_url"),
        F.array_compact(F.array("website_url")).alias("external_links"), "image_urls", F.get("image_urls", F.lit(0)).alias("primary_image_url"), "image_alt_text",
        F.lit(None).cast("string").alias("photographer_credit"), uid_of(F.col("source_url"), p.uid_pattern).alias("uid"),
    )
    return finalize(out)
