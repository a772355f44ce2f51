"""Verification: targets of a scope, matched to archive and listing, scored, decided, summarised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from linkforge.functions.text import blank, bool_text, joined, normalize_title, score_text, text_of
from linkforge.operators.lookup import Index, fallback_lookup, keyed_union
from linkforge.operators.ordering import best_by, first_wins, last_wins
from linkforge.operators.rules.decide import attribution, image_active, match_status, match_warnings, scores
from linkforge.profile import DEFAULT, Profile
from linkforge.runtime import checkpointed

TARGET = ("uid", "title", "artist", "description", "image_urls", "image_alt_text", "source", "_ord")


def _target(df: DataFrame, source: str, **cols: Column) -> DataFrame:
    empty = {"image_urls": F.array().cast("array<string>")}
    return df.select(*[cols.get(c, F.lit(source) if c == "source" else F.col(c) if c == "_ord" else empty.get(c, F.lit(None).cast("string"))).alias(c) for c in TARGET])


def targets_from_export(df: DataFrame) -> DataFrame:
    o = F.col("original")
    return _target(df, "export", uid=F.col("uid"), title=F.col("title"), artist=o["artist_display_text"], description=o["description"], image_urls=F.array_compact(F.array(o["primary_image_url"])), image_alt_text=o["image_alt_text"])


def targets_from_listing(df: DataFrame) -> DataFrame:
    return _target(df, "listing", uid=F.col("uid"), title=F.col("title"), description=F.col("description"))


def targets_from_archive(df: DataFrame) -> DataFrame:
    return _target(df, "archive", uid=F.col("uid"), title=F.col("title"), artist=F.col("artist_display_text"), description=F.col("description"), image_urls=F.col("image_urls"), image_alt_text=F.col("image_alt_text"))


def select_targets(scope: str, archive: DataFrame, listing: DataFrame, export: DataFrame | None = None) -> DataFrame:
    """Targets of a scope; 'all' is a keyed union in which the archive wins and the listing fills gaps."""
    if scope == "export":
        return targets_from_export(export)
    if scope == "listing":
        return targets_from_listing(listing)
    if scope == "archive":
        return targets_from_archive(archive)
    key = F.coalesce(blank(F.col("uid")), normalize_title(F.col("title")))
    # of equal archive rows the last stands, of equal listing rows the first
    parts = [last_wins(targets_from_archive(archive), [key], F.col("_ord")), first_wins(targets_from_listing(listing), [key], F.col("_ord"))]
    return keyed_union([p.withColumn("_ord", F.lit(0)) for p in parts], key, F.col("_ord"))


def archive_records(blocks: DataFrame) -> DataFrame:
    """One record per identifier: the one with most images, artist, description (earliest among equals); those
    without identifier once per title, and only if no identified record has the title."""
    full = lambda c: F.when(text_of(F.col(c)) != "", 1).otherwise(0)
    rank = 2 * F.size("image_urls") + full("artist_display_text") + full("description") + full("uid")
    df = blocks.withColumn("normalized_title", normalize_title(F.col("title")))
    known = best_by(df.where("coalesce(uid, '') != ''"), [F.col("uid")], rank, F.col("_ord"))
    other = best_by(df.where("coalesce(uid, '') = ''"), [F.col("normalized_title")], rank, F.col("_ord"))
    return known.unionByName(other.join(known.select("normalized_title").distinct(), "normalized_title", "left_anti")).orderBy("normalized_title", "title")


def verify(targets: DataFrame, archive: DataFrame, listing: DataFrame, probes: DataFrame | None = None, p: Profile = DEFAULT) -> DataFrame:
    """One result for each target, by lower-cased title. ``probes`` (url, status, content_type, content_length) tells
    which images answer; without it none is active."""
    key = normalize_title(F.col("title"))
    idx = lambda df: Index(df, F.col("uid"), [normalize_title(F.col("title"))], F.col("_ord"))
    df = fallback_lookup(fallback_lookup(targets, idx(archive), F.col("uid"), [key], "archive"), idx(listing), F.col("uid"), [key], "www")
    a, w = F.col("archive"), F.col("www")
    urls = F.array_distinct(F.filter(F.concat(F.coalesce(a["image_urls"], F.array().cast("array<string>")), F.col("image_urls")), lambda u: text_of(u) != ""))
    df = df.withColumn("urls", F.when(a.isNotNull(), urls).otherwise(F.array().cast("array<string>"))).withColumn("_id", F.monotonically_increasing_id())
    df = checkpointed(df)  # images are joined back by _id, so it must not be computed twice
    rows = df.select("_id", F.coalesce(blank(a["image_alt_text"]), F.col("image_alt_text")).alias("alt"), a["canonical_source_url"].alias("page"), F.posexplode("urls").alias("pos", "url"))
    if probes is None:
        rows = rows.withColumn("active", F.lit(False)).withColumn("review", F.lit(False)).withColumn("credit", F.lit(None).cast("string"))
    else:
        said = attribution(F.col("url"), F.col("alt"), p)
        rows = rows.join(probes, "url", "left").withColumn("active", image_active(F.col("status"), F.col("content_type"), F.col("content_length")))
        rows = rows.withColumn("_a", said).withColumn("review", F.col("_a.review_required")).withColumn("credit", F.col("_a.credit_text"))
    images = rows.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.col("url").alias("image_url"), F.col("active").alias("link_active"), F.col("review").alias("review_required"), F.col("credit").alias("credit_text"), F.col("page").alias("source_page_url")))).alias("images"))
    df = df.join(images, "_id", "left").withColumn("s", F.when(a.isNotNull(), scores(
        F.struct("uid", "title", "artist", "description"), F.struct(a["uid"].alias("uid"), a["title"].alias("title"), a["artist_display_text"].alias("artist"), a["description"].alias("description"))
    )))
    live = F.filter("images", lambda i: i["link_active"])
    df = df.withColumn("active_image_count", F.coalesce(F.size(live), F.lit(0))).withColumn("image_count", F.size("urls"))
    df = df.withColumn("hero", F.coalesce(F.get(live, F.lit(0)), F.get("images", F.lit(0))))
    review = F.coalesce(F.col("hero.review_required"), F.lit(False))
    warned = F.concat(match_warnings(F.col("s")), F.array_compact(F.array(F.when(review, F.lit("Hero image attribution requires review.")))))
    df = df.withColumn("warnings", F.when(a.isNotNull(), warned).otherwise(F.array(F.lit("No matching archive record was found."))))
    status = F.when(a.isNull(), "unresolved").otherwise(match_status(F.col("s.title"), F.col("s.uid_match"), F.size("warnings"), F.col("active_image_count"), F.col("image_count"), review))
    return df.select(
        F.coalesce(a["title"], F.col("title")).alias("project_title"), F.coalesce(a["normalized_title"], F.col("title")).alias("normalized_title"), status.alias("verification_status"),
        a["uid"].alias("archive_uid"), a["canonical_source_url"].alias("archive_url"), w["title"].alias("www_title"), w["uid"].alias("www_uid"), F.col("s.title").alias("title_match_score"),
        F.col("s.artist").alias("artist_match_score"), F.col("s.description").alias("description_match_score"), F.col("s.uid_match").alias("uid_match"), a["artist_display_text"].alias("archive_artist"),
        F.col("artist").alias("export_artist"), "image_count", "active_image_count", F.col("hero.image_url").alias("hero_image_url"), F.col("hero.link_active").alias("hero_image_active"),
        F.col("hero.credit_text").alias("public_credit"), "warnings", "images", "source",
    ).orderBy(F.lower("project_title"))


def flat_report(results: DataFrame) -> DataFrame:
    """Results as text cells: scores with two decimals, True or False, warnings joined."""
    out = []
    for name, kind in results.drop("images").dtypes:
        c = F.col(name)
        out.append((score_text(c) if kind == "double" else bool_text(c) if kind == "boolean" else joined(c, " | ") if kind.startswith("array") else text_of(c.cast("string"))).alias(name))
    return results.select(*out)


def summary(results: DataFrame) -> DataFrame:
    """Per status: results, images, active and inactive images."""
    sums = [F.sum("image_count").alias("images"), F.sum("active_image_count").alias("active")]
    return results.groupBy("verification_status").agg(F.count(F.lit(1)).alias("results"), *sums).withColumn("inactive", F.col("images") - F.col("active")).orderBy("verification_status")


def first_titles(rows: DataFrame) -> DataFrame:
    return first_wins(rows, [normalize_title(F.col("title"))], F.col("_ord"))
