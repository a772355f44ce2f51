"""Identity resolution: classified credits, evidence from page tables, merged people, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from linkforge.functions.text import alias_mentioned, blank, text_of
from linkforge.functions.urls import host
from linkforge.operators.links import first_per_group
from linkforge.operators.ordering import last_wins, merged_people
from linkforge.operators.people import alias_linked, has_context, is_noise_url, people_in, should_fetch
from linkforge.operators.rules.credit import is_legal_name, with_credit
from linkforge.profile import DEFAULT, Profile
from linkforge.runtime import checkpointed

ALIAS_TYPES = ("alias_or_unknown", "alias_pair")


def candidates(verified: DataFrame, statuses=("verified_online", "verified"), only_needing_search: bool = False, aliases_only: bool = False, limit: int | None = None) -> DataFrame:
    """Verified rows with their classified credit as ``c``, by lower-cased title."""
    df = with_credit(verified.where(F.col("verification_status").isin(*statuses)), "archive_artist", "c")
    if only_needing_search or aliases_only:
        df = checkpointed(df)  # else the filters below go through the whole classification once more, which makes planning explode
    if only_needing_search:
        df = df.where("c.needs_search")
    if aliases_only:
        df = df.where(F.col("c.credit_type").isin(*ALIAS_TYPES))
    df = df.orderBy(F.lower("project_title"), "archive_uid")
    return df.limit(limit) if limit else df


def evidence(rows: DataFrame, pages: DataFrame, most: int = 6, p: Profile = DEFAULT) -> DataFrame:
    """Pages (key, url, pos, text) that may tell who stands behind an alias: the artist's own, and others that
    mention it; a few each, in order."""
    joined = rows.select("key", "archive_artist", "artist_website").join(pages, "key").where(should_fetch(F.col("url")) & ~is_noise_url(F.col("url")))
    own = F.coalesce(host(F.col("url")) == F.nullif(host(F.col("artist_website")), F.lit("")), F.lit(False))
    told = own | alias_mentioned(F.col("archive_artist"), F.col("text")) | alias_mentioned(F.col("archive_artist"), F.col("url"))
    return first_per_group(joined.withColumn("own", own).where(told), ["key"], F.col("url"), "pos", most)


def resolve(rows: DataFrame, pages: DataFrame | None = None, p: Profile = DEFAULT) -> DataFrame:
    """Rows (key, archive_artist, artist_website, c) with resolved_people, legal_name, alias_name, identity_status.

    Seeds are the credit's own people; pages add people on role lines and names linked to the alias. A legal
    name is taken from evidence of 0.75 or more; for pure aliases only from linked names or 0.9 and more."""
    c = F.col("c")
    rows = checkpointed(rows)  # the classified credits are read several times, and planned once
    seeds = rows.select("key", F.posexplode(c["named_people"]).alias("pos", "name")).select("key", "pos", "name", F.lit("credited").alias("role"), F.lit(0.7).alias("confidence"))
    found = seeds.where(is_legal_name(F.col("name")))
    if pages is not None:
        told = evidence(rows, pages, p=p)
        order = told.select("key", "url", F.col("pos").alias("page"))
        plain = people_in(told, ["key", "url"], "text", 0.55, p)
        linked = alias_linked(told.where(F.col("own") | has_context(F.col("text"), p)).withColumnRenamed("archive_artist", "alias"), ["key", "url"], "text", "alias")
        for i, part in enumerate((plain, linked)):
            # among equals: the credit's own people, then by page, kind of evidence and place on the page
            place = (F.col("page").cast("long") + 1) * 2_000_000 + i * 1_000_000 + F.col("pos")
            rows_of = part.join(order, ["key", "url"]).select("key", "page", F.posexplode("people").alias("pos", "p")).select("key", place.alias("pos"), "p.name", "p.role", "p.confidence")
            found = found.unionByName(rows_of)
    people = merged_people(found.withColumn("pos", F.col("pos").cast("long")), ["key"])
    df = checkpointed(rows.join(people, "key", "left")).withColumn("people", F.coalesce("people", F.array().cast("array<struct<pos:bigint,name:string,role:string,confidence:double>>")))
    alias = c["credit_type"].isin(*ALIAS_TYPES)
    official = [n.lower() for n in p.official_names] or [""]
    good = F.filter("people", lambda x: (x["confidence"] >= 0.75) & is_legal_name(x["name"]) & ~F.lower(x["name"]).isin(*official) & (~alias | (x["role"] == "alias_linked") | (x["confidence"] >= 0.9)))
    top = F.get(good, F.lit(0))["name"]
    taken = F.when(c["credit_type"].isin(*ALIAS_TYPES, "collective", "hybrid"), top)
    df = df.withColumn("legal_name", F.coalesce(blank(c["legal_name"]), taken))
    df = df.withColumn("alias_name", F.coalesce(blank(c["alias_name"]), F.when(alias & F.col("legal_name").isNotNull(), F.col("archive_artist"))))
    return df.withColumn("identity_status", status(c, F.col("legal_name"), F.col("alias_name"), F.col("people")))


def status(c: Column, legal: Column, alias: Column, people: Column) -> Column:
    """resolved, partial, needs_review or unresolved."""
    both = legal.isNotNull() & alias.isNotNull()
    linked = F.exists(people, lambda x: (x["role"] == "alias_linked") & (x["confidence"] >= 0.9))
    strong = F.exists(people, lambda x: (x["confidence"] >= 0.75) & is_legal_name(x["name"]))
    return (
        F.when(both & (c["credit_type"] == "person_with_alias"), "resolved")
        .when(both & c["credit_type"].isin(*ALIAS_TYPES) & linked, "resolved")
        .when(c["credit_type"].isin("person", "multi_person") & (F.size(c["named_people"]) > 0), "resolved")
        .when(c["needs_search"] & strong, "partial")
        .when(c["needs_search"], "needs_review")
        .when(legal.isNotNull(), "resolved")
        .otherwise("unresolved")
    )


def overlay(existing: DataFrame, new: DataFrame) -> DataFrame:
    """New results over existing ones by identifier, else lower-cased title; by title."""
    both = existing.withColumn("_v", F.lit(0)).unionByName(new.withColumn("_v", F.lit(1)), allowMissingColumns=True)
    key = F.coalesce(blank(F.col("archive_uid")), F.lower(text_of(F.col("project_title"))))
    return last_wins(both, [key], F.col("_v")).drop("_v").orderBy(F.lower("project_title"))


def report_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("identity_status", "credit_type").agg(F.count(F.lit(1)).alias("n")).orderBy("identity_status", "credit_type")
