"""The year ingest: five lookups from the listing, fields by precedence, flags, provenance, facets, view."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from linkforge.functions.text import blank, first_nonblank, lit_array, normalize_title, slugify, text_of
from linkforge.operators.lookup import Index, fallback_lookup, identity_conflict
from linkforge.operators.rules.contributor import identity_is_useful, person_or_org, with_cached_contributor, with_local_contributor
from linkforge.operators.rules.decide import ATTENTION, choose_hero, format_flags, missing_required, review_priority, split_flags, upload_ready
from linkforge.profile import DEFAULT, Profile
from linkforge.runtime import checkpointed

VERIFICATION = ("archive_uid", "www_uid", "archive_url", "archive_artist", "verification_status", "hero_image_url", "hero_image_active", "public_credit")
IDENTITY = ("uid", "archive_credit", "credit_type", "legal_name", "alias_name", "alias_confidence", "collective_name", "named_people", "identity_status", "artist_website")


@dataclass(frozen=True)
class Caches:
    """Cached tables, each with its keys (uid, title, year where its title key has one) and _ord."""

    verification: DataFrame
    archive: DataFrame
    images: DataFrame
    collector: DataFrame
    identity: DataFrame


def _index(df: DataFrame, uid: Column, title: str, with_year: bool = True, veto: Column | None = None) -> Index:
    titles = [normalize_title(F.col(title))] + ([F.col("year").cast("string")] if with_year else [])
    return Index(df, uid, titles, F.col("_ord"), veto)


def looked_up(base: DataFrame, c: Caches) -> DataFrame:
    """The listing with a struct for each cache. All lookups use the listing's own identifier."""
    title, year = normalize_title(F.col("title")), F.col("year").cast("string")
    for name, index in (
        ("verification", _index(c.verification, F.coalesce(blank(F.col("archive_uid")), blank(F.col("www_uid"))), "project_title")),
        ("archive", _index(c.archive, F.col("uid"), "title")),
        ("images", _index(c.images, F.col("archive_uid"), "project_title", with_year=False)),
        ("collector", _index(c.collector, F.col("uid"), "title")),
        ("identity", _index(c.identity, F.col("uid"), "project_title", veto=identity_conflict())),
    ):
        keys = [title, year] if len(index.titles) == 2 else [title]
        base = fallback_lookup(base, index, F.col("uid"), keys, name)
    return base


def ingest_rows(listing: DataFrame, caches: Caches, p: Profile = DEFAULT) -> DataFrame:
    """One row for each listing row: fields, review flags and source_provenance.

    The looked-up rows are checkpointed: several sinks read them, and the joins' constraints would otherwise be
    carried through every rule, which makes planning explode."""
    df = checkpointed(looked_up(listing, caches))
    v, a, m, o, i = F.col("verification"), F.col("archive"), F.col("collector.mapped"), F.col("collector.original"), F.col("identity")
    df = df.withColumn("event_uid", text_of(first_nonblank(F.col("uid"), v["archive_uid"], v["www_uid"], a["uid"])))
    credit = text_of(first_nonblank(i["archive_credit"], a["artist_display_text"], v["archive_artist"], o["artist_display_text"], m["contributor_name"]))
    df = df.withColumn("source_credit", credit)
    df = with_cached_contributor(with_local_contributor(df, "source_credit", "_local"), "identity", F.col("source_credit"), "_cached")
    df = df.withColumn("_useful", identity_is_useful(i)).withColumn("who", F.when(F.col("_useful"), F.col("_cached")).otherwise(F.col("_local"))).drop("_local", "_cached")
    df = df.withColumns({
        "honorarium_status": text_of(first_nonblank(o["honoraria_status"], o["honorarium_status"])),
        "proof_external_url": text_of(first_nonblank(a["canonical_source_url"], v["archive_url"], F.col("legacy_link"), F.col("artist_url"), m["proof_external_url"])),
        "contributor_website": text_of(first_nonblank(i["artist_website"], a["website_url"], F.col("artist_url"), m["contributor_website"])),
        "project_summary": text_of(first_nonblank(a["description"], F.col("description"), m["project_summary"])),
        "project_location": text_of(first_nonblank(a["artist_location"], m["project_location"], o["artist_location"])),
    })
    pictures = F.struct(
        m["hero_image_url"].alias("hero_image_url"), o["primary_image_url"].alias("primary_image_url"), m["public_credit_language"].alias("public_credit"),
        o["image_credit_text"].alias("image_credit_text"), o["canonical_source_url"].alias("canonical_source_url"), m["proof_external_url"].alias("proof_external_url"),
    )
    df = df.withColumn("hero", choose_hero(v, F.col("images"), a, pictures, p))
    # a repeated identifier flags its second and later rows, a repeated title all of them
    by_uid = F.row_number().over(Window.partitionBy("event_uid").orderBy("_ord"))
    by_title = F.count(F.lit(1)).over(Window.partitionBy("normalized_title"))
    df = df.withColumn("_again", (F.col("event_uid") != "") & (by_uid > 1)).withColumn("_shared", by_title > 1)
    when = lambda cond, flag: F.when(cond, F.lit(flag))
    lead = F.array_compact(F.array(when(F.col("_again"), "duplicate_candidate"), when(v.isNull() & a.isNull(), "missing_archive_cache"), when(F.col("_shared"), "duplicate_candidate")))
    flags = F.concat(lead, F.col("who.review_flags"), F.array_compact(F.array(when(F.col("honorarium_status") == "", "honorarium_unknown"))), F.col("hero.flags"))
    provenance = F.array_compact(F.array(
        F.lit("www"), when(v.isNotNull(), "verification"), when(a.isNotNull(), "archive_index"), when(F.col("images").isNotNull(), "image_manifest"), when(F.col("collector").isNotNull(), "collector_export"),
        F.when(F.col("_useful"), "identity_report").otherwise("identity_local_fallback"), F.when(F.col("hero.provenance") != "", F.concat(F.lit("hero:"), F.col("hero.provenance"))),
    ))
    title, name, who = F.col("title"), F.col("who.display_name"), F.col("who")
    grouped = who["kind"].isin("collective", "studio", "organization", "theme_camp", "multiple")
    return df.select(
        title.alias("project_title"), F.coalesce(F.nullif(slugify(title), F.lit("")), F.concat(F.lit("event-"), F.col("year").cast("string"), F.lit("-untitled"))).alias("project_slug"),
        text_of(F.col("kind")).alias("project_type"), F.col("year").cast("string").alias("project_year"), "project_location", "project_summary", F.col("hero.url").alias("hero_image_url"),
        name.alias("contributor_name"), slugify(name).alias("contributor_slug"), F.lit("Artist").alias("role_title"), "contributor_website",
        F.when(grouped, "Collective project").otherwise("").alias("collaboration_status"), F.concat(F.lit("Artist contribution to "), title).alias("contribution_title"),
        F.col("project_summary").alias("what_they_did"), F.col("hero.attribution").alias("public_credit_language"), F.coalesce(blank(v["verification_status"]), F.lit("documented")).alias("verification_status"),
        title.alias("proof_title"), F.lit("Installation detail page").alias("proof_type"), "proof_external_url", F.col("project_summary").alias("proof_description"),
        "event_uid", F.col("year").cast("string").alias("event_year"), F.lit(p.event_name).alias("event_name"), text_of(F.col("address")).alias("event_address"), "honorarium_status",
        text_of(F.col("camp")).alias("theme_camp"), text_of(F.col("kind")).alias("installation_type"), who["source_credit"].alias("source_artist_credit"), name.alias("contributor_display_name"),
        who["additional_credits"].alias("additional_contributor_credits"), who["kind"].alias("contributor_kind"), who["first_name"].alias("contributor_first_name"), who["last_name"].alias("contributor_last_name"),
        who["alias_name"].alias("alias_name"), who["alias_confidence"].alias("alias_confidence"), F.col("hero.url").alias("hero_image_source_url"), F.col("hero.source_page").alias("hero_image_source_page"),
        F.col("hero.attribution").alias("hero_image_attribution"), F.col("hero.confidence").alias("hero_image_confidence"), format_flags(flags).alias("review_flags"),
        F.array_join(F.array_distinct(provenance), "|").alias("source_provenance"), F.col("identity_mode"), "_ord",
    )


def ingest_stats(rows: DataFrame) -> DataFrame:
    """One row of counters."""
    n = F.count_if
    kind, source = person_or_org(F.col("contributor_kind")), split_flags(F.col("source_provenance"))
    return rows.agg(
        F.count(F.lit(1)).alias("source_rows"), n(F.col("event_uid") != "").alias("uid_matches"), n(F.array_contains(source, "verification")).alias("verification_matches"),
        n(F.array_contains(source, "identity_report")).alias("identity_cache_matches"), n(F.array_contains(source, "identity_local_fallback")).alias("identity_local_fallbacks"),
        n((F.col("identity_mode") == "title") & F.array_contains(source, "identity_report")).alias("identity_title_fallback_matches"),
        n(kind == "person").alias("resolved_people"), n(kind == "org").alias("resolved_organizations"), n(kind == "multiple").alias("resolved_multiple_credits"),
        n(F.col("alias_name") != "").alias("aliases_found"), n(F.col("hero_image_url") != "").alias("hero_images_found"), n(F.col("hero_image_url") == "").alias("rows_missing_hero"),
        n(F.col("proof_external_url") != "").alias("proof_links_found"), n(F.col("contributor_display_name") == "").alias("rows_missing_primary_name"),
    )


def project_view(rows: DataFrame) -> DataFrame:
    """Nested documents with readiness, priority and flag labels."""
    flags = split_flags(F.col("review_flags"))
    missing = missing_required(F.col("project_title"), F.col("project_slug"), F.col("proof_external_url"))
    ready = upload_ready(F.col("project_title"), F.col("project_slug"), F.col("proof_external_url"), flags)
    pick = lambda *names: F.struct(*[text_of(F.col(n)).alias(a) for n, a in names])
    return rows.select(
        F.trim("project_title").alias("title"), F.col("project_year").alias("year"), F.col("event_uid").alias("uid"), F.trim("project_slug").alias("slug"), F.trim("proof_external_url").alias("proof_url"),
        F.col("project_summary").alias("summary"),
        F.struct(*[text_of(F.col(n)).alias(n) for n in ("source_artist_credit", "contributor_display_name", "additional_contributor_credits", "contributor_kind", "contributor_first_name", "contributor_last_name", "alias_name", "alias_confidence")], person_or_org(F.col("contributor_kind")).alias("person_or_org")).alias("people"),
        pick(("event_address", "event_address"), ("theme_camp", "theme_camp"), ("installation_type", "installation_type"), ("project_location", "project_location")).alias("place"),
        pick(("hero_image_url", "url"), ("hero_image_source_page", "source_page"), ("hero_image_attribution", "attribution"), ("hero_image_confidence", "confidence")).alias("hero"),
        flags.alias("review_flags"), F.array_intersect(flags, lit_array(ATTENTION)).alias("attention_flags"), split_flags(F.col("source_provenance")).alias("source_provenance"),
        (~ready).alias("needs_attention"), ready.alias("upload_ready"), review_priority(flags, missing, F.trim("hero_image_url") != "").alias("review_priority"),
        F.transform(flags, lambda f: F.initcap(F.replace(f, F.lit("_"), F.lit(" ")))).alias("flag_labels"),
    )


def checklist(view: DataFrame) -> DataFrame:
    """One row of conditional counts."""
    n = F.count_if
    return view.agg(
        F.count(F.lit(1)).alias("project_count"), n("upload_ready").alias("upload_ready_count"), n("needs_attention").alias("needs_attention_count"), n(F.col("proof_url") == "").alias("missing_proof_count"),
        n(F.col("hero.url") == "").alias("missing_hero_count"), n(F.col("hero.url") != "").alias("with_hero_image"), n(F.col("place.event_address") != "").alias("with_address"),
        n(F.col("people.contributor_display_name") != "").alias("with_contributor_display_name"),
    )


def flag_counts(view: DataFrame) -> DataFrame:
    return view.select(F.explode("review_flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n")).orderBy("flag")
