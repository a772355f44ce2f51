"""Enrichment: query generation, source ranking, proposals, overlays and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from linkforge.functions.text import alias_token, any_in, blank, clean_text, evidence_sentences, fabrication, materials, primary_name, quoted, sentences, tags, text_of
from linkforge.functions.urls import defragment, external_domain, host
from linkforge.functions.values import relevance
from linkforge.operators.links import first_per_group
from linkforge.operators.ordering import first_wins
from linkforge.operators.rules.decide import matching_identifiers, source_priority, source_type
from linkforge.profile import DEFAULT, Profile

# Fields that enrichment may fill.
ENRICHABLE = (
    "contributor_website", "project_tags", "project_materials", "project_fabrication_methods", "project_context_tags", "why_it_mattered",
    "what_they_did", "client_name", "collaboration_status", "contribution_category", "phase", "public_credit_language",
)
MATTERS = ("community", "memorial", "interactive", "particip")


def _said(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def search_queries(r: Column, p: Profile = DEFAULT) -> Column:
    """Distinct query texts for a record struct (project_title, contributor_name, year, artist_website,
    project_website, artist_location, artist_collective, materials), in order."""
    title, who = quoted(r["project_title"]), quoted(primary_name(r["contributor_name"]))
    event = F.lit(p.event_name)
    has = who != ""
    place = F.element_at(F.split(text_of(blank(r["artist_location"])), ","), 1)
    domain = external_domain(F.coalesce(blank(r["artist_website"]), blank(r["project_website"])), p.archive_host)
    queries = F.array(
        _said(title, who), _said(title, event), _said(title, event, text_of(r["year"])), _said(title, F.lit("materials")), _said(title, F.lit("fabrication")),
        _said(who, event, text_of(r["year"])),
        F.when(has, _said(who, F.when(alias_token(r["contributor_name"]).isNotNull(), F.concat_ws(" ", alias_token(r["contributor_name"]), event)))).otherwise(None),
        F.when(has, F.concat(who, F.lit(" kinetic installation"))), F.when(has & (place != ""), F.concat(who, F.lit(" artist "), place)),
        F.when(text_of(r["artist_collective"]) != "", _said(title, quoted(r["artist_collective"]))), F.when(text_of(r["materials"]) != "", _said(title, r["materials"])),
        F.when(domain.isNotNull(), _said(F.concat(F.lit("site:"), domain), title)),
    )
    return F.array_distinct(F.filter(F.array_compact(queries), lambda q: F.trim(q) != ""))


def identity_queries(c: Column, title: Column, year: Column, p: Profile = DEFAULT) -> Column:
    """Distinct queries for a classified credit (with field ``credit``); aliases have queries of their own."""
    t, credit, group = quoted(title, always=False), quoted(c["credit"], always=False), quoted(c["collective_name"], always=False)
    e = p.event_name
    alias = F.array(
        F.concat(credit, F.lit(f" {e} real name")), F.concat(credit, F.lit(' artist "real name"')), F.concat(credit, F.lit(f' aka OR "also known as" {e}')),
        F.concat_ws(" ", credit, t, F.lit("artist")), F.rtrim(F.concat_ws(" ", credit, F.lit(e), text_of(year.cast("string")))), F.concat(t, F.lit(' "'), c["credit"], F.lit('" artist name')),
    )
    has = group != ""
    plain = F.array(
        *[F.when(has, F.concat(group, F.lit(f" {e} {w}"))) for w in ("members", "founders")], F.when(has, F.concat(group, F.lit(f" {e} lead artist"))), F.when(has, F.concat_ws(" ", t, group)),
        F.when((text_of(c["alias_name"]) != "") & (c["alias_confidence"] == "high"), F.concat(quoted(c["alias_name"], always=False), F.lit(f" {e} real name"))),
        F.when((text_of(c["legal_name"]) != "") & c["needs_search"], F.concat(quoted(c["legal_name"], always=False), F.lit(f" {e}"))),
        F.trim(F.concat_ws(" ", t, F.lit(e), text_of(year.cast("string")), F.lit("artist"))),
    )
    return F.array_distinct(F.array_compact(F.when(c["credit_type"].isin("alias_or_unknown", "alias_pair"), alias).otherwise(plain)))


def collected_results(results: DataFrame, group: list[str], most: int = 10) -> DataFrame:
    """Discovered and searched results of each record, by source and position, distinct by bare URL, capped."""
    return first_per_group(results.withColumn("_key", defragment(F.col("url"))), group, F.col("_key"), "pos", most).drop("_key")


def excerpt(text: Column, record: Column, most: int = 600, p: Profile = DEFAULT) -> Column:
    """The first sentence that shares something with the record, with the evidence sentences; else the start."""
    hit = F.get(F.filter(sentences(text), lambda s: F.size(matching_identifiers(record, s, p)) > 0), F.lit(0))
    return F.substring(F.when(hit.isNotNull(), F.array_join(F.concat(F.array(hit), evidence_sentences(text)), " ")).otherwise(clean_text(text)), 1, most)


def ranked_sources(results: DataFrame, group: list[str], record: Column, most: int = 5, p: Profile = DEFAULT) -> DataFrame:
    """Sources of each record: by priority and snippet score (ties in order of position), the first ``most`` whose
    page shares two identifiers; then by relevance and priority as ``rank``. Columns: url, title, snippet, text,
    pos and the record's."""
    known = F.array_compact(F.array(*[F.nullif(host(record[f]), F.lit("")) for f in ("artist_website", "project_website")]))
    df = results.withColumn("source_type", source_type(F.col("url"), known, p)).withColumn("priority", source_priority(F.col("source_type")))
    df = df.withColumn("snippet_score", F.size(matching_identifiers(record, F.concat_ws(" ", "title", "snippet"), p)))
    df = df.withColumn("identifiers", matching_identifiers(record, F.concat_ws(" ", "title", "snippet", "text"), p)).where("text is not null and size(identifiers) >= 2")
    order = Window.partitionBy(*group).orderBy("priority", F.desc("snippet_score"), "pos")
    df = df.withColumn("accepted", F.row_number().over(order)).where(F.col("accepted") <= most)
    df = df.withColumn("relevance", relevance(F.col("priority"), F.col("identifiers"))).withColumn("excerpt", excerpt(F.col("text"), record, p=p))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("relevance"), "priority", "accepted")))


def proposals(sources: DataFrame, group: list[str], current: Column) -> DataFrame:
    """Per record and field the first proposal by source rank: field, value, url, confidence, classification,
    review_required. ``current`` is the struct of the row's present values; set fields get no proposal, but the
    website does."""
    e, low = F.col("excerpt"), F.lower("excerpt")
    unset = lambda f: text_of(current[f]) == ""

    def one(field: str, cond: Column, value: Column, confidence: float, stated: bool, review: bool = True) -> Column:
        return F.when(cond & (text_of(value) != ""), F.struct(
            F.lit(field).alias("field"), value.alias("value"), F.lit(confidence).alias("confidence"),
            F.lit("directly_stated" if stated else "strongly_inferred").alias("classification"), F.lit(review).alias("review_required"),
        ))

    every = F.array_compact(F.array(
        one("contributor_website", F.col("source_type") == "first_party", F.col("url"), 0.9, True, False),
        one("project_materials", unset("project_materials"), materials(e), 0.8, True),
        one("project_fabrication_methods", unset("project_fabrication_methods"), fabrication(e), 0.75, True),
        one("project_tags", unset("project_tags"), F.array_join(tags(low), "||"), 0.62, False),
        one("what_they_did", unset("what_they_did"), e, 0.7, True),
        one("why_it_mattered", unset("why_it_mattered") & any_in(low, MATTERS), e, 0.58, False),
    ))
    rows = sources.select(*group, "rank", "url", "source_type", F.explode(every).alias("x")).select(*group, "rank", "url", "source_type", "x.*")
    return first_wins(rows, [*[F.col(g) for g in group], F.col("field")], F.col("rank"))


def overlay_proposals(rows: DataFrame, found: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows with proposed values over their fields, and ``unresolved``: enrichable fields left without a value."""
    wide = found.groupBy(key).agg(*[F.max_by("value", F.when(F.col("field") == f, F.lit(1))).alias(f"_p_{f}") for f in fields])
    out = rows.join(wide, key, "left").select(*[F.coalesce(F.nullif(F.col(f"_p_{c}"), F.lit("")), F.col(c)).alias(c) if c in fields else F.col(c) for c in rows.columns])
    missing = [F.when(text_of(F.col(f)) == "", F.lit(f)) if f in rows.columns else F.lit(f) for f in ENRICHABLE]
    return out.withColumn("unresolved", F.array_compact(F.array(*missing)))
