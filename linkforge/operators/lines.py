"""Ordered text lines: runs, record starts and blocks, as windows over (page, position).

A page is one document, so the windows' partitions are bounded by a page's size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from linkforge.functions.text import any_in, clean_text, text_of

LABELS = ("by:", "from:", "year:", "url:", "contact:")


def starts_with_any(c: Column, prefixes) -> Column:
    low, out = F.lower(text_of(c)), F.lit(False)
    for p in prefixes:
        out = out | low.startswith(p)
    return out


def is_metadata_line(text: Column) -> Column:
    return starts_with_any(text, LABELS)


def is_donate_link(text: Column, href: Column, css: Column | None = None) -> Column:
    """A link that asks for money: says so outright, or mentions it and has it in its class or target."""
    css = F.lit(None).cast("string") if css is None else css
    combined = F.lower(F.concat_ws(" ", text, href, css))
    target = any_in(F.lower(text_of(href)), ("/donate", "donation")) | F.contains(F.lower(text_of(css)), F.lit("donate"))
    return F.contains(combined, F.lit("donate to this project")) | (F.contains(combined, F.lit("donate")) & target)


def is_no_title(text: Column, href: Column) -> Column:
    """A line that is a link or an address rather than a title."""
    return (
        is_donate_link(text, href)
        | starts_with_any(href, ("mailto:", "tel:"))
        | text_of(text).rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")
        | starts_with_any(text, ("http://", "https://"))
    )


def islands(df: DataFrame, group: list[str], order: str, change: Column) -> DataFrame:
    """Number runs of rows: ``island`` grows by one where ``change`` holds."""
    return df.withColumn("island", F.sum(F.when(change, 1).otherwise(0)).over(Window.partitionBy(*group).orderBy(order)))


def coalesce_lines(events: DataFrame) -> DataFrame:
    """(page, line, text, href) from events (page, pos, kind, value, href): consecutive texts join to one line
    until a break or another link target; a missing target is a value of its own. Images do not break lines."""
    w = Window.partitionBy("page").orderBy("pos")
    flow = events.where("kind in ('break', 'text')").withColumn("_text", F.col("kind") == "text")
    previous = F.lag(F.struct("kind", "href")).over(w)
    change = previous.isNull() | (F.col("kind") == "break") | (previous["kind"] == "break") | ~previous["href"].eqNullSafe(F.col("href"))
    runs = islands(flow.withColumn("_change", change), ["page"], "pos", F.col("_change")).where("_text")
    lines = runs.groupBy("page", "island").agg(F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("parts"), F.first("href").alias("href"))
    text = clean_text(F.array_join(F.transform("parts", lambda p: p["value"]), " "))
    out = lines.select("page", F.col("parts")[0]["pos"].alias("pos"), text.alias("text"), "href").where("text != ''")
    return out.withColumn("line", F.row_number().over(w))


def record_starts(lines: DataFrame, ahead: int = 4) -> DataFrame:
    """Add ``is_start``: no label, link or '...archive' line, with a 'by:' and a 'year:' among the next lines."""
    nxt = Window.partitionBy("page").orderBy("line").rowsBetween(1, ahead)
    has = lambda p: F.coalesce(F.max(starts_with_any(F.col("text"), (p,)).cast("int")).over(nxt), F.lit(0)) == 1
    plain = ~is_metadata_line(F.col("text")) & ~is_no_title(F.col("text"), F.col("href")) & ~F.lower("text").endswith("archive")
    return lines.withColumn("is_start", plain & has("by:") & has("year:"))


def blocks(lines: DataFrame) -> DataFrame:
    """Lines from the first start on, with ``block`` counting starts."""
    return islands(lines, ["page"], "line", F.col("is_start")).withColumnRenamed("island", "block").where("block > 0")


def block_fields(lines: DataFrame) -> DataFrame:
    """One record for each block: position, title and its link, the labelled values, description.

    Labels: the first line with the prefix, after its colon. The URL prefers the line's own link, then its
    text, then the next line's link or URL. The description is what follows 'year:' up to 'url:' or
    'contact:', without label and link lines."""
    w = Window.partitionBy("page", "block").orderBy("line")
    has = lambda *p: starts_with_any(F.col("text"), p)
    marked = (
        lines.withColumn("next_text", F.lead("text").over(w)).withColumn("next_href", F.lead("href").over(w))
        .withColumn("years", F.sum(has("year:").cast("int")).over(w))
        .withColumn("ends", F.sum(F.when(has("url:", "contact:") & (F.col("years") > 0), 1).otherwise(0)).over(w))
    )
    value = clean_text(F.regexp_replace("text", r"(?s)^[^:]*:", ""))
    next_url = F.coalesce(F.col("next_href"), F.when(starts_with_any(F.col("next_text"), ("http://", "https://")), F.col("next_text")))
    url = F.coalesce(F.nullif("href", F.lit("")), F.nullif(value, F.lit("")), next_url)
    labelled = lambda p, v: F.min_by(v, F.when(has(p), F.col("line")))
    body = (F.col("years") > 0) & (F.col("ends") == 0) & ~is_metadata_line(F.col("text")) & ~is_no_title(F.col("text"), F.col("href"))
    parts = F.sort_array(F.collect_list(F.when(body, F.struct("line", "text"))))
    return marked.groupBy("page", "block").agg(
        F.min_by("text", "line").alias("title"),
        F.min_by("href", "line").alias("title_href"),
        F.min_by("pos", "line").alias("title_pos"),
        labelled("by:", value).alias("artist_display_text"),
        labelled("from:", value).alias("artist_location"),
        labelled("year:", value).alias("year"),
        labelled("url:", url).alias("website_url"),
        labelled("contact:", value).alias("contact"),
        F.nullif(clean_text(F.array_join(F.transform(parts, lambda x: x["text"]), " ")), F.lit("")).alias("description"),
    ).withColumnRenamed("block", "source_position")


def block_images(records: DataFrame, events: DataFrame) -> DataFrame:
    """Images after each record's title event up to the next record's, distinct in order, with the first
    non-empty alternative text. Titles and images are ordered together, so one window finds the owner."""
    titles = records.select("page", F.col("title_pos").alias("pos"), "source_position", F.lit(None).cast("string").alias("value"), F.lit(None).cast("string").alias("alt"))
    images = events.where("kind = 'image'").select("page", "pos", F.lit(None).cast("long").alias("source_position"), "value", "alt")
    owner = F.last("source_position", ignorenulls=True).over(Window.partitionBy("page").orderBy("pos"))
    owned = titles.unionByName(images).withColumn("owner", owner).where("value is not null and owner is not null")
    found = owned.groupBy("page", F.col("owner").alias("source_position")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "value"))).alias("_i"),
        F.min_by("alt", F.when(text_of(F.col("alt")) != "", F.col("pos"))).alias("image_alt_text"),
    )
    found = found.select("page", "source_position", F.array_distinct(F.transform("_i", lambda x: x["value"])).alias("image_urls"), "image_alt_text")
    return records.join(found, ["page", "source_position"], "left").withColumn("image_urls", F.coalesce("image_urls", F.array().cast("array<string>")))
