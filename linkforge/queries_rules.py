"""Registered queries over the library's rules and plans, each by its own function and over whole tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from linkforge.functions import text as t, urls as u
from linkforge.operators import enrich, html, links
from linkforge.operators.lookup import Index, fallback_lookup, lookup_counts
from linkforge.operators.rules import decide
from linkforge.operators.rules.credit import with_credit
from linkforge.plans import export, identity, ingest, publish, verify, view
from linkforge.queries import _view
from linkforge.runtime import shared_path, table
from linkforge.sources import readers, sinks

# --- texts and URLs


def q60_visible_text(s, d):
    return table(s, d, "pages").select("page_id", t.visible_text(F.col("html")).alias("plain"))


def q60_names(s, d):
    """Titles without their site, names in capitals but for particles, texts in quotes."""
    name = F.concat_ws(" ", "p_name", F.lit("van"), F.lower("p_brand"))
    return table(s, d, "part").select(
        "p_partkey", t.strip_site_suffix(F.concat("p_name", F.lit("  |  "), F.col("p_type"), F.lit(" - x"))).alias("title"), t.title_name(F.when(F.col("p_size") > 25, name).otherwise(F.col("p_type"))).alias("name"),
        t.quoted(F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.col("p_type")), always=False).alias("quoted"),
    )


def q60_aliases(s, d):
    """Names and aliases of a credit line, and which of them are the same."""
    credit = F.concat("c_name", F.lit("  AKA "), F.lower("c_mktsegment"), F.lit(", of x - studio"))
    return table(s, d, "customer").select(
        "c_custkey", t.primary_name(credit).alias("name"), t.alias_token(credit).alias("alias"), t.aliases_match(F.col("c_name"), F.regexp_replace(F.upper("c_name"), "#", " - ")).alias("same"),
        t.aliases_match(F.col("c_name"), F.col("c_mktsegment")).alias("other"), t.alias_mentioned(F.col("c_mktsegment"), credit).alias("mentioned"),
    )


def q61_url_forms(s, d):
    """Links of every form resolved against each page, the last segment, hosts below a domain."""
    forms = F.explode(F.array(*[F.lit(x) for x in ("/root/x", "a/b", "../up", "?q=2", "#f", "//h.example/x", "mailto:a@b.c", "")])).alias("href")
    rows = table(s, d, "pages").select("page_id", "url", forms)
    return rows.select("page_id", "href", u.absolute(F.col("url"), F.col("href")).alias("target"), u.collection(F.col("url")).alias("last"), u.blocked_host(F.col("url"), ("example.com", "example.org")).alias("blocked"))


def q61_link_predicates(s, d):
    """Detail pages, discovery pages and pagination by path, query and class."""
    p = table(s, d, "pages")
    root = F.regexp_extract("url", "^(https?://[^/?#]*)", 1)
    made = p.select("page_id", "url", F.concat(root, F.lit("/Artwork/x")).alias("detail"), F.concat(root, F.lit("/archive")).alias("listing"))
    no = F.lit("")
    return made.select(
        "page_id", links.is_detail_url(F.col("url")).alias("is_detail"), links.is_detail_url(F.col("detail")).alias("made_detail"), links.is_discovery_url(F.col("url")).alias("is_discovery"),
        links.is_discovery_url(F.col("listing")).alias("made_discovery"), links.is_pagination(F.col("url"), no, no).alias("is_pagination"), u.page_kind(F.col("listing"), ("/artwork/",), "/archive/").alias("kind"),
    )


# --- verification


def _parts_as_archive(s, d):
    p = table(s, d, "part")
    images = F.when(F.col("p_size") > 30, F.array(F.concat(F.lit("http://i/"), F.col("p_partkey").cast("string")))).otherwise(F.array().cast("array<string>"))
    return p.select(
        F.col("p_partkey").cast("string").alias("uid"), F.col("p_name").alias("title"), t.normalize_title(F.col("p_name")).alias("normalized_title"), F.lit("").alias("artist_display_text"), F.col("p_type").alias("description"),
        images.alias("image_urls"), F.lit("").alias("image_alt_text"), F.concat(F.lit("http://p/"), F.col("p_partkey").cast("string")).alias("canonical_source_url"), F.col("p_partkey").alias("_ord"),
    )


def q62_match_scores(s, d):
    """Scores and warnings of parts against records that share some of their words."""
    p = table(s, d, "part")
    target = F.struct(F.col("p_partkey").cast("string").alias("uid"), F.col("p_name").alias("title"), F.when(F.col("p_size") > 10, F.col("p_brand")).alias("artist"), F.col("p_type").alias("description"))
    other = F.struct(F.col("p_size").cast("string").alias("uid"), F.concat_ws(" ", "p_name", "p_type").alias("title"), F.when(F.col("p_size") > 25, F.concat(F.lit("By: "), F.col("p_brand"))).otherwise(F.lit("Bo")).alias("artist"), F.concat_ws(" ", "p_type", "p_name", "p_brand").alias("description"))
    found = p.select("p_partkey", decide.scores(target, other).alias("s"))
    return found.select("p_partkey", F.round("s.title", 6).alias("title"), F.round("s.artist", 6).alias("artist"), F.round("s.description", 6).alias("description"), "s.uid_match", F.size(decide.match_warnings(F.col("s"))).cast("long").alias("n_warnings"))


def q62_verify_rows(s, d):
    """Parts as a listing, some without identifier, verified against all parts as the archive; and the summary."""
    listing = table(s, d, "part").select(F.when(F.col("p_size") > 20, F.col("p_partkey").cast("string")).alias("uid"), F.col("p_name").alias("title"), F.col("p_type").alias("description"), F.col("p_partkey").alias("_ord"))
    done = verify.verify(verify.targets_from_listing(listing), _parts_as_archive(s, d), listing)
    return done.select("archive_uid", F.col("verification_status").alias("status"), F.col("title_match_score").alias("title_score"), "uid_match", F.col("image_count").cast("long").alias("images"), F.size("warnings").cast("long").alias("n_warnings"), "hero_image_url").groupBy(
        "archive_uid", "status", "title_score", "uid_match", "images", "n_warnings", "hero_image_url"
    ).agg(F.count(F.lit(1)).alias("n"))


def q62_report_texts(s, d):
    """Arrays as cells and cells as arrays again, people as text, the last website of each nation."""
    c = table(s, d, "customer")
    cell = F.concat_ws(" | ", "c_mktsegment", "c_name")
    people = F.array(F.struct(F.col("c_name").alias("name"), F.lit("credited").alias("role"), (F.col("c_nationkey") / 100).alias("confidence")), F.struct(F.lit("Bo").alias("name"), F.lit("lead").alias("role"), F.lit(0.5).alias("confidence")))
    rows = c.select(F.col("c_custkey").alias("key"), F.concat_ws("+", F.reverse(readers.split_list(cell))).alias("value")).unionByName(c.select(F.col("c_custkey").alias("key"), sinks.people_cell(people).alias("value")))
    sites = readers.website_by_uid(c.select(F.col("c_nationkey").cast("string").alias("uid"), F.expr("if(c_acctbal > 0, concat('http://', c_custkey), '')").alias("website_url"), F.col("c_custkey").alias("_ord")))
    return rows.unionByName(sites.select(F.col("uid").cast("long").alias("key"), F.col("website_url").alias("value")))


def q62_lookup_counts(s, d):
    """How line items find their part: by the supplier's number, by title, not at all."""
    base = table(s, d, "lineitem").join(table(s, d, "part"), F.col("p_partkey") == F.col("l_partkey")).select(F.when(F.col("l_quantity") > 25, F.col("l_suppkey").cast("string")).alias("uid"), t.normalize_title(F.col("p_name")).alias("key"))
    cache = Index(_parts_as_archive(s, d), F.col("uid"), [F.col("normalized_title")], F.col("_ord"))
    return lookup_counts(fallback_lookup(base, cache, F.col("uid"), [F.col("key")], "hit"), ["hit"])


# --- batches


def q63_batch_manifest(s, d):
    """Events as candidates of their user's batch of two: counts, first and last position, status."""
    rows = table(s, d, "events").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("position"), F.when(F.col("value") > 90, "completed").alias("status"), (F.col("event_type") != "click").alias("valid"), F.col("event_type").alias("canonical_url"))
    return export.batch_counts(export.scrape_batch(rows, 2), 100)


def q63_first_preview(s, d):
    """The first valid one of the first five orders that have no preview yet."""
    rows = table(s, d, "orders").select(F.col("o_orderkey").alias("position"), (F.col("o_orderstatus") == "F").alias("previewed"), (F.col("o_orderpriority") > "2").alias("valid"))
    return export.first_valid_preview(rows).select("position")


def q63_kind_and_status(s, d):
    rows = table(s, d, "customer").select(F.col("c_mktsegment").alias("contributor_kind"), F.when(F.col("c_acctbal") > 0, "Approved").otherwise("Needs review").alias("review_status"))
    return export.by_kind_and_status(rows)


def q63_batch_catalog(s, d):
    """A folder for each region with the manifest of its batch: counted, else exported, else by its range."""
    root = shared_path(s, "query")
    for r in table(s, d, "region").orderBy("r_regionkey").collect():  # five rows
        given = [{"record_count": 7}, {"exported_count": 5}, {"first_position": 3, "last_position": 9}, {}, {"record_count": 0}][r.r_regionkey]
        publish.write_text(s, f"{root}/x/batches/batch_{r.r_regionkey}/manifest.json", json.dumps({"year": r.r_name} | given))
        publish.write_text(s, f"{root}/{r.r_name}/plain.txt", "x" * 20_000 * (r.r_regionkey + 1))
    found = readers.batch_catalog(s, f"{root}/x").select(F.lit("batch").alias("part"), F.concat_ws("|", "year", "name").alias("key"), F.col("records").cast("double").alias("n"))
    sizes = readers.disk_footprint(s, root).where("directory not in ('x', 'total_mb')")
    return found.unionByName(sizes.select(F.lit("folder").alias("part"), F.col("directory").alias("key"), F.col("mb").alias("n")))


# --- the view


def _ranked_view(s, d):
    return _view(s, d).withColumn("review_priority", F.when(F.col("needs_attention"), F.length("title")).otherwise(0))


def q64_filter_counts(s, d):
    """Rows of every named filter, with and without a text."""
    shown, out = _ranked_view(s, d), None
    for name in view.filters():
        for query in ("", " RING "):
            n = view.search(shown, name, query).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), F.lit(query.strip().lower()).alias("query"), "n")
            out = n if out is None else out.unionByName(n)
    return out


def q64_sorted_top(s, d):
    """The first ten of the view by each sort."""
    shown, out = _ranked_view(s, d), None
    for name in view.sorts():
        top = view.search(shown, sort=name).limit(10).select(F.lit(name).alias("sort"), "uid")
        out = top if out is None else out.unionByName(top)
    return out


def q64_project_view(s, d):
    """Parts as ingest rows, nested: flags that hold a row back, readiness, priority, labels."""
    p = table(s, d, "part")
    empty = ["project_summary", "source_artist_credit", "additional_contributor_credits", "contributor_first_name", "contributor_last_name", "alias_name", "alias_confidence", "event_address", "theme_camp", "installation_type", "project_location", "hero_image_source_page", "hero_image_attribution", "hero_image_confidence"]
    flags = F.concat_ws("|", F.when(F.col("p_size") > 25, "hero_missing"), F.when(F.col("p_type") == "SMALL", "honorarium_unknown"))
    rows = p.select(
        F.concat(F.lit(" "), F.col("p_name")).alias("project_title"), F.lit("2019").alias("project_year"), F.col("p_partkey").cast("string").alias("event_uid"), t.slugify(F.col("p_name")).alias("project_slug"), F.expr("if(p_size < 5, ' ', p_type)").alias("proof_external_url"),
        F.col("p_brand").alias("contributor_display_name"), F.lit("individual").alias("contributor_kind"), F.expr("if(p_size > 25, '', p_brand)").alias("hero_image_url"), flags.alias("review_flags"), F.lit("www").alias("source_provenance"), *[F.lit("").alias(c) for c in empty],
    )
    v = ingest.project_view(rows)
    return v.select("uid", "title", F.col("people.person_or_org").alias("kind"), F.col("hero.url").alias("hero"), F.array_join("attention_flags", "|").alias("attention"), "upload_ready", F.col("review_priority").cast("long").alias("priority"), F.array_join("flag_labels", "|").alias("labels"))


# --- identity and enrichment


def q65_collected_results(s, d):
    """Customers as search results of their segment: the first ten distinct ones by URL without fragment."""
    c = table(s, d, "customer").select("c_mktsegment", F.concat(F.lit("http://x/"), F.col("c_nationkey").cast("string"), F.lit("#"), F.col("c_custkey").cast("string")).alias("url"), F.col("c_custkey").alias("pos"))
    return enrich.collected_results(c, ["c_mktsegment"]).select("c_mktsegment", "url")


def q65_proposals(s, d):
    """Parts as sources of their brand: the first value that a source proposes for each field."""
    said = F.concat(F.expr("if(p_size > 10, concat('Made of ', p_type, '. '), '')"), F.expr("if(p_size > 20, concat('Constructed ', p_name, '. '), '')"), F.expr("if(p_size > 40, 'A community of light.', 'Plain.')"))
    sources = table(s, d, "part").select("p_brand", F.col("p_partkey").alias("rank"), F.concat(F.lit("http://p/"), F.col("p_partkey").cast("string")).alias("url"), F.when(F.col("p_type") == "SMALL", "first_party").otherwise("press").alias("source_type"), said.alias("excerpt"))
    current = F.struct(*[F.lit(x).alias(f) for f, x in (("project_materials", ""), ("project_fabrication_methods", None), ("project_tags", ""), ("what_they_did", "known"), ("why_it_mattered", ""))])
    return enrich.proposals(sources, ["p_brand"], current.cast("struct<project_materials:string,project_fabrication_methods:string,project_tags:string,what_they_did:string,why_it_mattered:string>")).select("p_brand", "field", "value", "url", "confidence", "classification", "review_required")


def q65_proposal_overlay(s, d):
    """Proposed materials and client names over what customers have, and how many fields are left open."""
    c = table(s, d, "customer")
    rows = c.select("c_custkey", F.expr("if(c_acctbal > 0, c_name, '')").alias("client_name"), F.lit("").alias("project_materials"))
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").cast("string").alias("value"))
    found = o.select("c_custkey", F.lit("project_materials").alias("field"), "value").unionByName(o.select("c_custkey", F.lit("client_name").alias("field"), F.lit("").alias("value")))
    return enrich.overlay_proposals(rows, found, "c_custkey", ["client_name", "project_materials"]).select("c_custkey", "client_name", "project_materials", F.size("unresolved").cast("long").alias("n_open"))


def q65_identity_overlay(s, d):
    """Suppliers as earlier results, customers of the same names or numbers over them; counted by status."""
    old = table(s, d, "supplier").select(F.when(F.col("s_acctbal") > 0, F.col("s_suppkey").cast("string")).alias("archive_uid"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("project_title"), F.lit("unresolved").alias("identity_status"), F.lit("empty").alias("credit_type"))
    new = table(s, d, "customer").select(F.when(F.col("c_acctbal") > 0, F.col("c_custkey").cast("string")).alias("archive_uid"), F.concat(F.lit("s"), F.col("c_custkey").cast("string")).alias("project_title"), F.lit("resolved").alias("identity_status"), F.col("c_mktsegment").alias("credit_type"))
    return identity.report_counts(identity.overlay(old, new))


def q65_resolved_credits(s, d):
    """Credits of customers by segment, resolved from the credit alone."""
    c = table(s, d, "customer")
    credit = F.expr("case c_mktsegment when 'BUILDING' then 'Ann Lee' when 'MACHINERY' then 'Bo Diaz aka Sparkle' when 'HOUSEHOLD' then 'Ann Lee and Bo Diaz' when 'FURNITURE' then '' else 'Sparkle' end")
    rows = with_credit(c.select(F.col("c_custkey").alias("key"), credit.alias("archive_artist"), F.lit("").alias("artist_website")), "archive_artist", "c")
    done = identity.resolve(rows)
    return done.select("key", "c.credit_type", "legal_name", "alias_name", F.size("people").cast("long").alias("n_people"), "identity_status")


def q65_excerpts(s, d):
    """The sentence of a part that shares something with its record, with the sentences on how it was made."""
    text = F.concat(F.lit("Plain words here. "), F.expr("if(p_size > 25, concat('About ', p_name, '!  '), '')"), F.lit("It is made of steel? "), F.expr("if(p_size > 40, 'Built by many.', 'The end.')"))
    record = F.struct(F.col("p_name").alias("project_title"), *[F.lit("").alias(c) for c in ("contributor_name", "artist_collective", "year", "materials")])
    return table(s, d, "part").select("p_partkey", enrich.excerpt(text, record).alias("excerpt"))


def q65_same_domain(s, d):
    """Links of each page to its own host, distinct without fragment; the first three."""
    rows = table(s, d, "pages").select("page_id", "url", F.posexplode(html.hrefs(F.col("html"))).alias("pos", "href"))
    return links.same_domain(rows.withColumnRenamed("url", "seed"), F.col("seed"), F.col("href"), ["page_id"], "pos", 3).select("page_id", "url")


# --- the year ingest


def _ingested(s, d):
    """Parts as the listing; caches hold the larger ones: verification by identifier, archive, images, collector by title
    and year, identities. Names of parts repeat, so titles lead to the first of each."""
    p = table(s, d, "part").withColumn("key", F.col("p_partkey").cast("string")).withColumn("year", F.lit("2019")).withColumn("title", F.concat_ws(" ", "p_name", "key"))
    no = F.lit(None).cast("string")
    named = lambda *names: [no.alias(n) for n in names]
    listing = p.select(
        F.when(F.col("p_size") > 5, F.col("key")).alias("uid"), "title", t.normalize_title(F.col("title")).alias("normalized_title"), F.lit(2019).alias("year"), F.expr("if(p_type = 'SMALL', concat('http://l/', key), '')").alias("legacy_link"),
        F.lit("").alias("artist_url"), F.col("p_type").alias("description"), F.col("p_type").alias("kind"), F.col("p_brand").alias("address"), F.lit("").alias("camp"), F.col("p_partkey").alias("_ord"),
    )
    at = F.col("p_partkey").alias("_ord")
    verification = p.where("p_size > 10").select(F.col("key").alias("archive_uid"), F.col("title").alias("project_title"), "year", F.concat(F.lit("http://v/"), "key").alias("archive_url"), F.lit("verified").alias("verification_status"), *named("www_uid", "archive_artist", "hero_image_url", "hero_image_active", "public_credit"), at)
    archive = p.where("p_size > 20").select(F.col("key").alias("uid"), "title", "year", F.lit("Ann Lee").alias("artist_display_text"), F.expr("if(p_size > 30, concat('http://a/', key), null)").alias("canonical_source_url"), *named("website_url", "description", "artist_location"), F.array(F.concat(F.lit("http://i/"), "key")).alias("image_urls"), at)
    picture = F.struct(F.concat(F.lit("http://m/"), "key").alias("image_url"), F.lit(True).alias("link_active"), F.lit("Bo").alias("credit_text"), no.alias("photographer_credit"), F.lit(False).alias("review_required"), no.alias("source_page_url"))
    images = p.where("p_size > 35").select(F.col("key").alias("archive_uid"), F.col("title").alias("project_title"), F.array(picture).alias("images"), no.alias("archive_url"), at)
    mapped = F.struct(F.lit("Cy Fox").alias("contributor_name"), *named("proof_external_url", "contributor_website", "project_summary", "project_location", "hero_image_url", "public_credit_language"))
    original = F.struct(F.expr("if(p_size > 15, 'full', '')").alias("honoraria_status"), *named("honorarium_status", "artist_display_text", "artist_location", "primary_image_url", "image_credit_text", "canonical_source_url"))
    collector = p.where("p_size < 20").select(no.alias("uid"), "title", "year", mapped.alias("mapped"), original.alias("original"), at)
    person = [F.lit("Di Ray").alias("archive_credit"), F.lit("person").alias("credit_type"), F.lit("Di Ray").alias("legal_name"), F.lit("resolved").alias("identity_status")]
    identities = p.where("p_size > 45").select(F.col("key").alias("uid"), F.col("title").alias("project_title"), "year", *person, *named("alias_name", "alias_confidence", "collective_name", "named_people", "artist_website"), at)
    return ingest.ingest_rows(listing, ingest.Caches(verification, archive, images, collector, identities))


def q66_ingest_rows(s, d):
    """Parts through the five lookups: fields by precedence, image, flags and provenance."""
    return _ingested(s, d).select(
        "project_title", "event_uid", "contributor_name", "contributor_kind", "proof_external_url", "hero_image_url", "hero_image_confidence", "verification_status", "honorarium_status", "project_summary", "review_flags", "source_provenance",
    )


def q66_ingest_stats(s, d):
    n = ingest.ingest_stats(_ingested(s, d))
    return n.select("source_rows", "uid_matches", "verification_matches", "identity_cache_matches", "resolved_people", "hero_images_found", "rows_missing_hero", "proof_links_found", "rows_missing_primary_name")


QUERIES = {n: f for n, f in list(globals().items()) if n.startswith("q") and n[1:3].isdigit()}
