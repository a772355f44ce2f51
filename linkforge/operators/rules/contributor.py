"""Contributors from classified credits or cached identity rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from linkforge.functions.text import any_in, blank, clean_text, ordered_unique_ci, text_of
from linkforge.operators.rules.credit import HONORIFIC, is_legal_name, is_stage_name, with_credit

# Substrings of a padded credit that decide a contributor's kind, tested camp, studio, organization.
CAMP_HINTS = ("camp ", " camp", "theme camp")
STUDIO_HINTS = (" studio", " studios", " workshop", " works", " productions", " lab", " labs")
ORG_HINTS = (
    " foundation", " institute", " association", " society", " nonprofit", " non-profit", " company", " co.", " collective", " crew",
    " guild", " group", " team", " inc", " llc", " art department", " burners", " project", " projects",
)
KINDS = ("individual", "organization", "collective", "multiple", "studio", "theme_camp", "unknown")
# Cached fields any of which makes an identity row useful.
USEFUL = ("legal_name", "alias_name", "collective_name", "credit_type", "named_people")


def contributor_kind(credit_type: Column, credit: Column) -> Column:
    padded = F.concat(F.lit(" "), F.lower(text_of(credit)), F.lit(" "))
    return (
        F.when(any_in(padded, CAMP_HINTS), "theme_camp").when(any_in(padded, STUDIO_HINTS), "studio").when(any_in(padded, ORG_HINTS), "organization")
        .when(credit_type.isin("person", "person_with_alias"), "individual").when(credit_type.isin("collective", "hybrid"), "collective")
        .when(credit_type == "organization", "organization").when(credit_type == "multi_person", "multiple").otherwise("unknown")
    )


def person_or_org(kind: Column) -> Column:
    k = F.lower(text_of(kind))
    return F.when(k == "individual", "person").when(k.isin("organization", "collective", "studio", "theme_camp"), "org").when(k == "multiple", "multiple").otherwise("unknown")


def name_parts(name: Column) -> Column:
    """Struct first, last of a plain two- or three-word legal name (a middle initial is dropped), else NULL."""
    w = F.array_remove(F.split(F.regexp_replace(clean_text(name), HONORIFIC, ""), " "), "")
    initial = F.element_at(w, 2).rlike(r"^[A-Z]\.?$")
    part = lambda a, b: F.struct(a.alias("first"), b.alias("last"))
    split = (
        F.when(F.size(w) == 2, part(w[0], w[1]))
        .when((F.size(w) == 3) & initial, part(w[0], w[2]))
        .when(F.size(w) == 3, part(w[0], F.concat_ws(" ", w[1], w[2])))
    )
    return F.when(is_legal_name(name) & ~clean_text(name).rlike("(?iu)[;/&]| and "), split)


def _unlike(items: Column, *others: Column) -> Column:
    """Items that differ, in lower case, from all others; distinct."""
    def keep(x: Column) -> Column:
        ok = x != ""
        for o in others:
            ok = ok & ~(F.lower(x) == F.lower(text_of(o)))
        return ok

    return ordered_unique_ci(F.filter(items, keep), keep_blank=False)


def _flags(*pairs: tuple[Column, str]) -> Column:
    return F.array_distinct(F.array_compact(F.array(*[F.when(c, F.lit(f)) for c, f in pairs])))


def _finish(df: DataFrame, out: str, source: Column, split_kinds: tuple[str, ...] | None) -> DataFrame:
    """Pack _kind, _display, _extra, _alias, _confidence and _flags into the contributor struct."""
    parts = name_parts(F.col("_display"))
    ok = parts.isNotNull() if split_kinds is None else parts.isNotNull() & F.col("_kind").isin(*split_kinds)
    df = df.withColumn("_parts", F.when(ok, parts))
    unsplit = F.col("_parts").isNull() & (F.col("_kind") == "individual") & (F.col("_display") != "")
    flags = F.array_distinct(F.concat(F.col("_flags"), _flags((unsplit, "name_split_uncertain")), F.col("_late")))
    return df.withColumn(
        out,
        F.struct(
            source.alias("source_credit"), F.col("_display").alias("display_name"), F.array_join("_extra", "; ").alias("additional_credits"), F.col("_kind").alias("kind"),
            text_of(F.col("_parts")["first"]).alias("first_name"), text_of(F.col("_parts")["last"]).alias("last_name"),
            F.col("_alias").alias("alias_name"), F.col("_confidence").alias("alias_confidence"), flags.alias("review_flags"),
        ),
    ).drop("_parts", "_kind", "_display", "_extra", "_alias", "_confidence", "_flags", "_late")


def with_local_contributor(df: DataFrame, credit: str, out: str = "contributor") -> DataFrame:
    """Add the contributor struct that the rules give for a free-text credit."""
    c = clean_text(F.col(credit))
    k = F.col("_class")
    df = with_credit(df, credit, "_class").withColumn("_kind", F.when(c == "", "unknown").otherwise(contributor_kind(k["credit_type"], c)))
    lone = (k["credit_type"] == "alias_or_unknown") & is_stage_name(c)
    confidence = F.when(lone, "medium").otherwise(k["alias_confidence"])
    df = df.withColumn("_alias", F.when(confidence.isin("high", "medium", "low"), F.when(lone, c).otherwise(text_of(k["alias_name"]))).otherwise(""))
    df = df.withColumn("_confidence", F.when(F.col("_alias") != "", confidence).otherwise("none"))
    listed = F.array_remove(F.transform(F.split(text_of(k["legal_name"]), ";"), clean_text), "")
    people = F.when(F.contains(text_of(k["legal_name"]), F.lit(";")), listed).otherwise(k["named_people"])
    legal = text_of(F.when(F.contains(text_of(k["legal_name"]), F.lit(";")), listed[0]).otherwise(clean_text(k["legal_name"])))
    df = df.withColumn("_people", people).withColumn("_legal", legal)
    people, legal = F.col("_people"), F.col("_legal")
    none = F.array().cast("array<string>")
    rest = F.when(F.size(people) > 1, F.slice(people, 2, 1000)).otherwise(none)
    first = text_of(F.when(F.size(people) > 0, people[0]))
    lead = F.when(legal != "", legal).otherwise(first)
    group = F.coalesce(k["collective_name"], c)
    several = (k["credit_type"] == "multi_person") & (F.size(people) > 0)
    grouped = k["credit_type"].isin("collective", "hybrid")
    led = grouped & (lead != "") & is_legal_name(lead)
    display = F.when(several, first).when(led, lead).when(grouped, group).when(legal != "", legal).when((F.col("_alias") != "") & (k["credit_type"] == "alias_or_unknown"), F.col("_alias")).otherwise(c)
    extra = (
        F.when(several, rest)
        .when(led, _unlike(F.concat(F.array(group), rest), lead))
        .when(grouped, F.filter(people, lambda p: F.lower(p) != F.lower(group)))
        .when(legal != "", _unlike(people, legal, F.col("_alias")))
        .otherwise(none)
    )
    df = df.withColumn("_kind", F.when(several, "multiple").otherwise(F.col("_kind"))).withColumn("_display", F.when(c == "", "").otherwise(display)).withColumn("_extra", F.when(c == "", none).otherwise(extra))
    unclear = (c == "") | (contributor_kind(k["credit_type"], c) == "unknown")
    df = df.withColumn("_flags", _flags((unclear, "contributor_kind_uncertain"), ((F.col("_alias") != "") & (F.col("_confidence") != "high"), "alias_uncertain"))).withColumn("_late", none)
    return _finish(df.drop("_people", "_legal"), out, c, None).drop("_class")


def identity_is_useful(identity: Column) -> Column:
    """A cached identity says something: resolved or partial, or one of the telling fields is set."""
    some = F.lit(False)
    for f in USEFUL:
        some = some | blank(identity[f]).isNotNull()
    return identity.isNotNull() & (F.coalesce(F.lower(blank(identity["identity_status"])).isin("resolved", "partial"), F.lit(False)) | some)


def with_cached_contributor(df: DataFrame, identity: str, fallback: Column, out: str = "cached_contributor") -> DataFrame:
    """Add the contributor struct that a cached identity row (a struct of text fields) gives. Lists in cells are
    separated by ; or |; the first entity leads and the others are additional credits."""
    i = F.col(identity)
    none = F.array().cast("array<string>")
    split = lambda c: F.array_remove(F.transform(F.split(F.replace(clean_text(c), F.lit("|"), F.lit(";")), ";"), clean_text), "")
    legal = F.array_remove(F.transform(F.split(clean_text(i["legal_name"]), ";"), clean_text), "")
    credit = clean_text(F.coalesce(F.nullif(i["archive_credit"], F.lit("")), fallback))
    df = df.withColumn("_credit", credit).withColumn("_entities", F.when(F.size(legal) > 0, legal).otherwise(split(i["named_people"])))
    credit, entities = F.col("_credit"), F.col("_entities")
    kind = text_of(F.trim(i["credit_type"]))
    collective, alias = clean_text(i["collective_name"]), clean_text(i["alias_name"])
    lead = text_of(F.when(F.size(entities) > 0, entities[0]))
    rest = F.when(F.size(entities) > 1, F.slice(entities, 2, 1000)).otherwise(none)
    many = (kind == "multi_person") | ((F.size(entities) > 1) & ~kind.isin("person", "person_with_alias"))
    mapped = F.when((kind == "multi_person") | ((F.size(entities) > 1) & ~kind.isin("person", "person_with_alias", "collective", "hybrid")), "multiple").when(kind == "organization", "organization").otherwise(contributor_kind(kind, credit))
    df = df.withColumn("_mapped", mapped).withColumn("_kind", F.when(many, "multiple").otherwise(F.col("_mapped")))
    grouped = kind.isin("collective", "hybrid") | F.col("_mapped").isin("collective", "organization", "theme_camp", "studio")
    led = (lead != "") & is_legal_name(lead) & (collective != "") & (F.lower(collective) != F.lower(lead))
    fresh = (collective != "") & ~F.array_contains(F.transform(rest, F.lower), F.lower(collective))
    display = (
        F.when(many & (lead == "") & fresh, collective).when(many, F.when(lead != "", lead).otherwise(credit))
        .when(grouped & led, lead).when(grouped, F.coalesce(F.nullif(collective, F.lit("")), F.nullif(lead, F.lit("")), credit))
        .when(lead != "", lead).when(collective != "", collective).otherwise(credit)
    )
    df = df.withColumn("_display", display)
    extra = (
        F.when(many, _unlike(F.when(fresh & (lead != "") & is_legal_name(lead), F.concat(rest, F.array(collective))).otherwise(rest)))
        .when(grouped & led, _unlike(F.concat(F.array(collective), F.when(F.size(rest) > 1, F.slice(rest, 2, 1000)).otherwise(none))))
        .when(grouped, _unlike(rest, F.col("_display")))
        .when(lead != "", _unlike(F.when((collective != "") & (F.lower(collective) != F.lower(lead)), F.concat(rest, F.array(collective))).otherwise(rest), lead, alias))
        .otherwise(none)
    )
    own = (alias != "") & (lead == "") & (credit != "") & (F.lower(credit) != F.lower(alias)) & ((F.col("_display") == "") | (F.lower("_display") == F.lower(alias)))
    confidence = F.when(i["alias_confidence"].isin("high", "medium", "low"), i["alias_confidence"]).otherwise("low")
    df = df.withColumn("_extra", extra).withColumn("_display", F.when(own, credit).otherwise(F.col("_display"))).withColumn("_alias", alias)
    df = df.withColumn("_confidence", F.when(alias != "", confidence).otherwise("none"))
    df = df.withColumn("_flags", _flags((F.col("_mapped") == "unknown", "contributor_kind_uncertain"), ((alias != "") & (confidence != "high"), "alias_uncertain")))
    review = (F.lower(text_of(blank(i["identity_status"]))) == "needs_review") | kind.isin("alias_or_unknown", "alias_pair")
    df = df.withColumn("_late", _flags((review, "identity_needs_review")))
    return _finish(df, out, credit, ("individual", "multiple")).drop("_credit", "_entities", "_mapped")
