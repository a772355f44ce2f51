"""Decisions: match status, image choice and attribution, source types, review gates, readiness and priority."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from linkforge.functions.text import any_in, artist_similarity, blank, lit_array, near_contains, similarity, text_of
from linkforge.functions.urls import host, rejected_image
from linkforge.profile import DEFAULT, Profile

# Thresholds of match scores.
TITLE, DESCRIPTION, ARTIST, CONFLICT = 0.75, 0.35, 0.4, 0.5
# Review flags, and those that hold a row back.
ATTENTION = (
    "duplicate_candidate", "name_split_uncertain", "alias_uncertain", "contributor_kind_uncertain", "identity_needs_review", "hero_missing",
    "hero_needs_review", "missing_archive_cache",
)
ALLOWED = (*ATTENTION, "honorarium_unknown")
# Source types by priority.
SOURCE_TYPES = ("first_party", "official", "institutional", "public_art_archive", "press", "crowdfunding", "social", "other")
# Fields whose changes always need a person.
PROTECTED = ("project_title", "project_slug", "contributor_name", "contributor_slug", "project_year", "verification_status", "permission_status")


def match_status(title: Column, uid_match: Column, n_warnings: Column, active: Column, images: Column, needs_review: Column) -> Column:
    """First true: conflict, broken_link, likely_match, verified or verified_online, verified, likely_match."""
    differs = F.coalesce(~uid_match, F.lit(False))
    agrees = F.coalesce(uid_match, F.lit(False))
    return (
        F.when((title < CONFLICT) & ~agrees, "conflict")
        .when((active == 0) & (images > 0), "broken_link")
        .when((n_warnings > 0) & (differs | (title < TITLE)), "likely_match")
        .when((active > 0) & (title >= TITLE), F.when(needs_review, "verified").otherwise("verified_online"))
        .when(title >= TITLE, "verified")
        .otherwise("likely_match")
    )


def scores(target: Column, archive: Column) -> Column:
    """Struct of title, artist and description scores and uid_match; a score whose target field is missing is
    NULL in the result but still computed for warnings; uid_match is NULL only if neither side has a uid."""
    uid = F.when(text_of(target["uid"]).isin("") & text_of(archive["uid"]).isin(""), F.lit(None)).otherwise(
        (text_of(target["uid"]) != "") & (text_of(target["uid"]) == text_of(archive["uid"]))
    )
    has = lambda f: text_of(target[f]) != ""
    return F.struct(
        similarity(target["title"], archive["title"]).alias("title"),
        F.when(has("artist"), artist_similarity(target["artist"], archive["artist"])).alias("artist"),
        F.when(has("description"), similarity(target["description"], archive["description"])).alias("description"),
        uid.alias("uid_match"),
    )


def match_warnings(s: Column) -> Column:
    """Warnings of a score struct, in order."""
    shown = lambda c: F.format_string("%.2f", F.bround(c, 2))
    return F.array_compact(
        F.array(
            F.when(s["title"] < TITLE, F.concat(F.lit("Title match score below threshold ("), shown(s["title"]), F.lit(")."))),
            F.when(s["artist"] < ARTIST, F.concat(F.lit("Artist match score is low ("), shown(s["artist"]), F.lit(")."))),
            F.when(s["description"] < DESCRIPTION, F.concat(F.lit("Description match score is low ("), shown(s["description"]), F.lit(")."))),
            F.when(~s["uid_match"], F.lit("UID mismatch between target and archive record.")),
        )
    )


# Words that make an alternative text a photo credit.
CREDIT_WORDS = ("photo", "photograph", "credit", "©", "copyright", "by ")


def attribution(url: Column, alt: Column, p: Profile = DEFAULT) -> Column:
    """Struct photographer_credit, credit_text, source_type, confidence, review_required by host and text."""
    h, text = host(url), F.trim(alt)
    official = h.isin(*p.official_hosts)
    for o in p.official_hosts:
        official = official | h.endswith("." + o)
    hosted = F.contains(h, F.lit("googleusercontent.com"))
    stated = text_of(alt) != ""
    credit = stated & any_in(F.lower(text_of(alt)), CREDIT_WORDS)
    none = F.lit(None).cast("string")
    return F.struct(
        F.when(credit, text).otherwise(none).alias("photographer_credit"),
        F.when(credit, text).when(official, p.official_credit).when(stated & ~hosted, text).otherwise(none).alias("credit_text"),
        F.when(official, "official").when(hosted, "third_party_hosted").otherwise("other").alias("source_type"),
        F.when(credit, "directly_stated").when(official, "inferred").when(hosted, "missing").when(stated, "directly_stated").otherwise("missing").alias("confidence"),
        (~credit & ~official & (hosted | ~stated)).alias("review_required"),
    )


def image_active(status: Column, content_type: Column, length: Column, least: int = 5120) -> Column:
    """A probe that found an image: status 200 or 206, an image type if any, and not too small if sized."""
    kind = (text_of(content_type) == "") | F.lower(content_type).startswith("image/")
    return F.coalesce(status.isin(200, 206) & kind & (length.isNull() | (length >= least)), F.lit(False))


HERO = "struct<url:string,source_page:string,attribution:string,confidence:string,flags:array<string>,provenance:string>"


def _hero(url, page, credit, confidence, flag, provenance: str) -> Column:
    flags = F.when(flag, F.array(F.lit("hero_needs_review"))).otherwise(F.array().cast("array<string>"))
    return F.struct(
        url.alias("url"), text_of(F.trim(page)).alias("source_page"), text_of(credit).alias("attribution"), confidence.alias("confidence"), flags.alias("flags"), F.lit(provenance).alias("provenance")
    ).cast(HERO)


def choose_hero(verification: Column, images: Column, archive: Column, collector: Column, p: Profile = DEFAULT, probe: Column | None = None) -> Column:
    """The image of a project, from the first source that has one: verification, manifest (first active one not
    rejected), archive (first not rejected), collector, an optional probe table's column, none."""
    preferred = lambda u: any_in(host(u), p.official_hosts)
    usable = lambda u: (text_of(F.trim(u)) != "") & ~rejected_image(u)

    v_url, v_state, v_credit = F.trim(verification["hero_image_url"]), text_of(verification["hero_image_active"]), text_of(F.trim(verification["public_credit"]))
    v_active = F.lower(v_state).isin("true", "1", "yes")
    from_verification = F.when(
        (text_of(v_url) != "") & (v_active | (v_state == "")),
        _hero(v_url, verification["archive_url"], v_credit, F.when(~v_active, "needs_review").when(preferred(v_url), "high").otherwise("medium"), ~v_active | (v_credit == ""), "verification"),
    )
    kept = F.filter(images["images"], lambda i: usable(i["image_url"]) & F.coalesce(i["link_active"], F.lit(True)))
    m = F.get(kept, F.lit(0))
    m_credit = text_of(F.coalesce(blank(m["credit_text"]), blank(m["photographer_credit"])))
    m_review = F.coalesce(m["review_required"], F.lit(False)) | (m_credit == "")
    from_manifest = F.when(m.isNotNull(), _hero(F.trim(m["image_url"]), F.coalesce(blank(m["source_page_url"]), images["archive_url"]), m_credit, F.when(m_review, "needs_review").when(preferred(m["image_url"]), "high").otherwise("medium"), m_review, "image_manifest"))
    a = F.trim(F.get(F.filter(archive["image_urls"], usable), F.lit(0)))
    from_archive = F.when(a.isNotNull(), _hero(a, archive["canonical_source_url"], F.when(preferred(a), p.official_credit).otherwise(""), F.when(preferred(a), "medium").otherwise("needs_review"), ~preferred(a), "archive_index"))
    c = F.coalesce(blank(collector["hero_image_url"]), blank(collector["primary_image_url"]))
    c_credit = text_of(F.coalesce(blank(collector["public_credit"]), blank(collector["image_credit_text"])))
    c_page = F.coalesce(blank(collector["canonical_source_url"]), blank(collector["proof_external_url"]))
    from_collector = F.when(usable(c), _hero(c, c_page, c_credit, F.when(c_credit != "", "medium").otherwise("needs_review"), c_credit == "", "collector_export"))
    options = [from_verification, from_manifest, from_archive, from_collector]
    if probe is not None:
        options.append(F.when(usable(probe["image_url"]), _hero(probe["image_url"], probe["page_url"], F.lit(""), F.lit("needs_review"), F.lit(True), "og_fetch")))
    missing = F.struct(*[F.lit("").alias(x) for x in ("url", "source_page", "attribution", "confidence")], F.array(F.lit("hero_missing")).alias("flags"), F.lit("").alias("provenance")).cast(HERO)
    return F.coalesce(*options, missing)


# Parts of host names that tell a source's type, in the order of the tests.
HOST_PARTS = (
    ("institutional", ("museum", "university", ".edu", ".org")),
    ("crowdfunding", ("kickstarter", "indiegogo", "gofundme")),
    ("social", ("instagram", "facebook", "twitter", "x.com", "youtube")),
    ("press", ("news", "magazine", "journal", "blog")),
)


def source_type(url: Column, known_hosts: Column | None = None, p: Profile = DEFAULT) -> Column:
    """First match: a host known to be the artist's, the archive's domain, the public-art archive, host parts."""
    h = host(url)
    out = F.when(F.coalesce((h != "") & F.array_contains(known_hosts, h), F.lit(False)), "first_party") if known_hosts is not None else F.when(F.lit(False), "")
    for o in p.official_hosts:
        out = out.when(h.endswith(o), "official")
    out = out.when(F.contains(h, F.lit(p.art_archive_host)), "public_art_archive")
    for kind, parts in HOST_PARTS:
        out = out.when(any_in(h, parts), kind)
    return out.otherwise("other")


def source_priority(kind: Column) -> Column:
    return F.array_position(lit_array(SOURCE_TYPES), kind).cast("int")


def matching_identifiers(record: Column, haystack: Column, p: Profile = DEFAULT) -> Column:
    """Labels of what a text shares with a record (project_title, contributor_name, artist_collective, year,
    materials), in order."""
    low = F.lower(text_of(haystack))
    return F.array_compact(
        F.array(
            F.when(near_contains(low, record["project_title"]), "project title"),
            F.when(near_contains(low, record["contributor_name"]), "contributor name"),
            F.when(near_contains(low, record["artist_collective"]), "collective name"),
            F.when((text_of(record["year"]) != "") & F.contains(low, text_of(record["year"])), "event year"),
            F.when(any_in(low, p.event_phrases), "event reference"),
            F.when(near_contains(low, record["materials"]), "materials"),
        )
    )


def review_status(field: Column, classification: Column, kind: Column, confidence: Column, automatic: Column, threshold: float = 0.85) -> Column:
    """approved only in automatic mode, for unprotected fields, stated directly by a first party or an
    institution with enough confidence; unresolved otherwise."""
    ok = automatic & ~field.isin(*PROTECTED) & (classification == "directly_stated") & kind.isin("first_party", "institutional") & (confidence >= threshold)
    return F.when(F.coalesce(ok, F.lit(False)), "approved").otherwise("unresolved")


def format_flags(flags: Column) -> Column:
    """Distinct allowed flags in order of first appearance, joined by |."""
    return F.array_join(F.filter(F.array_distinct(flags), lambda f: f.isin(*ALLOWED)), "|")


def split_flags(cell: Column) -> Column:
    return F.array_remove(F.split(text_of(cell), r"\|"), "")


def missing_required(title: Column, slug: Column, proof: Column) -> Column:
    return blank(title).isNull() | blank(slug).isNull() | blank(proof).isNull()


def upload_ready(title: Column, slug: Column, proof: Column, flags: Column) -> Column:
    """Title, slug and proof are set, and no flag asks for attention."""
    return ~missing_required(title, slug, proof) & ~F.arrays_overlap(flags, lit_array(ATTENTION))


# What each flag adds to the review priority.
PRIORITY = (("hero_needs_review", 30), ("duplicate_candidate", 25), ("contributor_kind_uncertain", 20), ("alias_uncertain", 15), ("name_split_uncertain", 10), ("missing_archive_cache", 10))


def review_priority(flags: Column, missing: Column, has_hero: Column) -> Column:
    has = lambda f: F.array_contains(flags, f)
    score = F.when(missing, 100).otherwise(0) + F.when(has("hero_missing") | ~has_hero, 50).otherwise(0)
    for f, n in PRIORITY:
        score = score + F.when(has(f), n).otherwise(0)
    only = (F.size(flags) > 0) & (F.size(F.array_except(flags, lit_array(["honorarium_unknown"]))) == 0)
    return score + F.when(only, 1).otherwise(0)
