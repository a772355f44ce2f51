"""Registered queries: one or more for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from linkforge.functions import text as t, urls as u, values as v
from linkforge.operators import contract, enrich, html, keyed, lines, links, ordering, people
from linkforge.operators.lookup import Index, fallback_lookup, keyed_union
from linkforge.operators.rules import decide
from linkforge.operators.rules.contributor import contributor_kind, name_parts, person_or_org
from linkforge.operators.rules.credit import people_of, with_credit
from linkforge.operators.schema import Field, Mapping, Schema, first_failures, project, validate
from linkforge.plans import export, ingest, pages as page_plans, verify, view
from linkforge.runtime import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Not registered: these look at parts of a table, to make absences or a second state. Tests run them; ``queries_state``
#: has their like over whole tables.
PARTIAL = ("q18_uid_title_fallback", "q40_manifest_diff", "q42_upsert_keep_first_seen", "q43_anti_insert", "q45_resume_selection", "q45_cached_search", "q51_publish_readiness")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _title() -> Column:
    return html.title_text(F.col("html"))


# --- scalar functions


@query
def q01_norm_title(s, d):
    return table(s, d, "pages").select("page_id", t.normalize_title(t.text_of(_title())).alias("key"))


@query
def q02_slug_part(s, d):
    part = table(s, d, "part").select(F.col("p_partkey").alias("id"), t.slugify(F.col("p_name")).alias("slug"), t.source_slug(F.col("p_name"), length=12).alias("short"))
    supplier = table(s, d, "supplier").select((-F.col("s_suppkey")).alias("id"), t.slugify(F.col("s_name")).alias("slug"), t.source_slug(F.col("s_name"), length=12).alias("short"))
    return part.unionByName(supplier)


@query
def q03_clean_whitespace(s, d):
    return table(s, d, "documents").select("doc_id", t.clean_text(F.col("text")).alias("clean"))


@query
def q04_first_nonblank(s, d):
    docs, labels = table(s, d, "documents"), table(s, d, "labels")
    quality = F.when(F.col("quality") == 1, F.concat(F.lit(" q"), F.col("toxic").cast("string"), F.lit(" ")))
    return docs.join(labels, "doc_id", "left").select("doc_id", t.first_nonblank(quality, F.when(F.col("n_chars") < 500, F.lit("  ")), F.col("source")).alias("picked"))


@query
def q05_clean_cell_literals(s, d):
    cell = F.when(F.col("event_id") % 5 == 0, F.lit(" NULL ")).when(F.col("event_id") % 5 == 1, F.lit("-")).otherwise(F.concat(F.lit(" "), F.col("event_type")))
    return table(s, d, "events").select("event_id", t.clean_cell(cell).alias("cell"))


@query
def q06_pipe_join(s, d):
    return table(s, d, "part").select("p_partkey", t.pipe_join(F.concat_ws(";", "p_brand", "p_type"), F.col("p_brand"), F.col("p_size").cast("string"), F.lit('["x|y", "none", "z"]')).alias("joined"))


@query
def q07_jaccard_benchmark(s, d):
    """Similar pairs by an inverted index on tokens, not by comparing all with all."""
    docs = table(s, d, "documents").select("doc_id", F.array_distinct(t.tokens(F.col("text"))).alias("dt"))
    items = table(s, d, "benchmark").select("item_id", t.tokens(F.col("text")).alias("bt"))
    a = docs.select("doc_id", F.size("dt").alias("na"), F.explode("dt").alias("w"))
    b = items.select("item_id", F.size("bt").alias("nb"), F.explode("bt").alias("w"))
    pairs = a.join(b, "w").groupBy("doc_id", "item_id", "na", "nb").agg(F.count(F.lit(1)).alias("k"))
    score = F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))
    return pairs.select("doc_id", "item_id", F.round(score, 6).alias("score")).where("score >= 0.3")


@query
def q08_near_contains(s, d):
    """Pairs of a document's source and a supplier-like needle: a document mentions all but one word of a label."""
    needles = F.array(*[F.lit(x) for x in ("license version apache", "general public license", "all rights reserved", "token")])
    docs = table(s, d, "documents").select("doc_id", "text", F.explode(needles).alias("needle"))
    return docs.where(t.near_contains(F.col("text"), F.col("needle"))).select("doc_id", "needle")


def _record() -> Column:
    return F.struct(F.lit("general public license").alias("project_title"), F.col("source").alias("contributor_name"), F.lit("apache license").alias("artist_collective"), F.lit("2.0").alias("year"), F.lit("rights reserved").alias("materials"))


@query
def q09_identifiers(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(decide.matching_identifiers(_record(), F.col("text")), "|").alias("labels"))


@query
def q10_tags_from_text(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(t.tags(F.lower("text")), "|").alias("tags"), t.materials(F.col("text")).alias("materials"))


@query
def q11_strip_html(s, d):
    return table(s, d, "pages").select("page_id", t.strip_tags(F.col("html")).alias("plain"))


def _tracked(url: Column) -> Column:
    return F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "^https?://", "HTTPS://"), F.lit("?utm_source=x&b=2&a=1&c=%20y&gclid=7#part "))


@query
def q12_url_normalize(s, d):
    return table(s, d, "pages").select("page_id", u.normalize_url(_tracked(F.col("url"))).alias("url"), u.candidate_url(_tracked(F.col("url"))).alias("candidate"))


@query
def q13_url_host_kind(s, d):
    return table(s, d, "pages").select("page_id", u.host(F.col("url")).alias("host"), decide.source_type(F.col("url")).alias("kind"), u.is_http(F.col("url")).alias("valid"))


@query
def q14_sha_record_id(s, d):
    return table(s, d, "pages").select("page_id", v.record_id(F.col("url")).alias("record_id"))


@query
def q14_url_parts(s, d):
    url = F.concat(F.col("url"), F.lit("/2019/x?yyyy=2021#a2IZ9"))
    return table(s, d, "pages").select("page_id", u.url_year(url).alias("year"), u.uid_of(url).alias("uid"), u.external_domain(url, "archive.example.org").alias("domain"), u.rejected_image(url).alias("rejected"), F.size(u.site_urls(F.col("url"))).cast("long").alias("n_site_urls"))


@query
def q14_json_values(s, d):
    e = table(s, d, "events")
    return e.select("event_id", F.get_json_object("props", "$.k").alias("k"), v.year_text(F.col("ts")).alias("year"), v.as_int(F.get_json_object("props", "$.k")).alias("as_int"))


@query
def q14_arrays(s, d):
    e = table(s, d, "embeddings")
    return e.select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"), F.size(t.ordered_unique(F.transform("embedding", lambda x: F.round(x, 1).cast("string")))).cast("long").alias("n_distinct"))


# --- winners, lookups, unions


@query
def q15_first_wins_text(s, d):
    docs = table(s, d, "documents").select("doc_id", "source", t.normalize_title(t.text_of(F.col("text"))).alias("key"))
    return ordering.first_wins(docs, [F.col("key")], F.col("doc_id")).select("doc_id", "source")


@query
def q16_last_wins_status(s, d):
    e = table(s, d, "events")
    return ordering.last_wins(e, [F.col("user_id")], F.struct("ts", "event_id")).select("user_id", "event_id", "event_type")


@query
def q17_best_by_rank(s, d):
    docs = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    rank = F.coalesce(F.col("quality") * 2, F.lit(0)) + F.when(F.col("n_chars") > 1000, 1).otherwise(0)
    return ordering.best_by(docs.withColumn("rank", rank.cast("long")), [F.col("source"), F.col("lang")], F.col("rank"), F.col("doc_id")).select("source", "lang", "doc_id", "rank")


@query
def q17_people_merge(s, d):
    """Per document the people of falling confidence, distinct in lower case."""
    c = table(s, d, "conversations")
    names = F.regexp_extract_all("text", F.lit(" ([A-Z][a-z]+)"), F.lit(1))
    rows = c.select("conv_id", (F.col("turn") * 1.0).alias("confidence"), F.col("turn"), F.posexplode(names).alias("i", "name")).withColumn("pos", F.col("turn") * 100_000 + F.col("i"))
    merged = ordering.merged_people(rows, ["conv_id"])
    return merged.select("conv_id", F.array_join(F.transform(F.slice("people", 1, 3), lambda p: F.lower(p["name"])), "|").alias("top"), F.size("people").cast("long").alias("n"))


@query
def q18_uid_title_fallback(s, d):
    part, li = table(s, d, "part"), table(s, d, "lineitem")
    cache = Index(part.where("p_partkey % 3 != 0"), F.col("p_partkey").cast("string"), [t.normalize_title(F.col("p_name"))], F.col("p_partkey"))
    base = li.select("l_orderkey", "l_linenumber", "l_partkey").join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title")), "l_partkey")
    found = fallback_lookup(base, cache, F.col("l_partkey").cast("string"), [t.normalize_title(F.col("title"))], "hit")
    return found.select("l_orderkey", "l_linenumber", "l_partkey", F.col("hit.p_partkey").alias("hit_key"), "hit_mode")


@query
def q19_conflict_veto(s, d):
    part = table(s, d, "part")
    differ = F.col("_hit.p_brand") != F.col("_other.p_brand")
    cache = Index(part, F.lit(None).cast("string"), [t.normalize_title(F.col("p_name")), F.col("p_type")], F.col("p_partkey"), differ)
    found = fallback_lookup(part.select("p_partkey", "p_name", "p_type"), cache, F.lit(None).cast("string"), [t.normalize_title(F.col("p_name")), F.col("p_type")], "hit")
    return found.select("p_partkey", F.col("hit.p_partkey").alias("hit_key"), "hit_mode")


@query
def q20_five_way_merge(s, d):
    """Customers with five lookups, a field by precedence and the provenance of what hit."""
    c = table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    orders, li, nation, supplier = (table(s, d, x) for x in ("orders", "lineitem", "nation", "supplier"))
    latest = ordering.last_wins(orders, [F.col("o_custkey")], F.struct("o_orderdate", "o_orderkey")).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    line = ordering.first_wins(li, [F.col("l_orderkey")], F.struct("l_linenumber", "l_partkey", "l_suppkey")).select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate", "l_suppkey")
    out = c.join(latest, "c_custkey", "left").join(line, "o_orderkey", "left").join(nation, c.c_nationkey == nation.n_nationkey, "left")
    own = ordering.first_wins(supplier, [F.col("s_nationkey")], F.col("s_suppkey")).select(F.col("s_nationkey").alias("sn"), F.col("s_name").alias("local_supplier"))
    out = out.join(own, out.c_nationkey == own.sn, "left").join(supplier.select(F.col("s_suppkey").alias("sk"), "s_name"), F.col("l_suppkey") == F.col("sk"), "left")
    hit = lambda c_, n: F.when(F.col(c_).isNotNull(), F.lit(n))
    source = F.array_join(F.array_compact(F.array(F.lit("base"), hit("o_orderkey", "orders"), hit("l_suppkey", "lines"), hit("n_name", "nation"), hit("local_supplier", "local"), hit("s_name", "supplier"))), "|")
    return out.select("c_custkey", t.first_nonblank(F.col("s_name"), F.col("local_supplier"), F.col("n_name")).alias("picked"), source.alias("provenance"))


@query
def q21_dup_flags(s, d):
    p = table(s, d, "part")
    again = F.row_number().over(Window.partitionBy("p_brand", "p_type").orderBy("p_partkey")) > 1
    shared = F.count(F.lit(1)).over(Window.partitionBy("p_name")) > 1
    flags = F.array_compact(F.array(F.when(again, F.lit("duplicate_candidate")), F.when(shared, F.lit("duplicate_candidate")), F.when(F.col("p_size") > 40, F.lit("hero_missing")), F.lit("not_a_flag")))
    return p.select("p_partkey", decide.format_flags(flags).alias("flags"))


@query
def q22_keyed_union(s, d):
    key = lambda df, k, n, nat, src: df.select(F.col(k).alias("id"), F.col(n).alias("name"), F.col(nat).alias("nation"), F.lit(src).alias("src"))
    supplier, customer = key(table(s, d, "supplier"), "s_suppkey", "s_name", "s_nationkey", "supplier"), key(table(s, d, "customer"), "c_custkey", "c_name", "c_nationkey", "customer")
    return keyed_union([supplier, customer], F.col("id"), F.col("id")).select("id", "name", "nation", "src")


# --- schema, validation, contract

_SCHEMA = Schema("1", (
    Field("project_title", True, rules=("non_empty",)), Field("project_slug", True, rules=("slug",)), Field("project_year", data_type="integer", rules=("year_or_empty",)),
    Field("contributor_website", data_type="url", rules=("url_or_empty",)), Field("status", default_value="draft", rules=("one_of:draft,final",)), Field("note"),
))
_MAPPINGS = [Mapping("p_name", "project_title", "copy"), Mapping("p_name", "project_slug", "slugify"), Mapping("p_size", "project_year", "copy"), Mapping("p_brand", "contributor_website", "url_or_empty"), Mapping("__default__", "note", "default:n/a"), Mapping("p_type", "status", "copy")]


@query
def q23_schema_projection(s, d):
    return project(table(s, d, "part"), _SCHEMA, _MAPPINGS, keep=["p_partkey"])


@query
def q24_validation_errors(s, d):
    rows = validate(project(table(s, d, "part"), _SCHEMA, _MAPPINGS, keep=["p_partkey"]), _SCHEMA)
    return rows.select("p_partkey", F.explode("errors").alias("e")).select("p_partkey", F.col("e.field").alias("field"), F.col("e.message").alias("message"))


@query
def q24_first_failures(s, d):
    rows = validate(project(table(s, d, "part"), _SCHEMA, _MAPPINGS, keep=["p_partkey"]), _SCHEMA)
    return first_failures(rows, "p_partkey").select("p_partkey", F.size("errors").cast("long").alias("n_errors"))


def _upload(s, d) -> DataFrame:
    kinds = F.element_at(F.array(*[F.lit(k) for k in ("individual", "studio", "collective", "multiple", "person")]), (F.col("page_id") % 5 + 1).cast("int"))
    return table(s, d, "pages").select(
        "page_id", F.when(F.col("page_id") % 7 != 0, _title()).alias("project_title"), t.slugify(t.text_of(_title())).alias("project_slug"), kinds.alias("contributor_kind"),
        F.when(F.col("page_id") % 7 != 0, F.concat(F.lit("Name "), F.col("page_id").cast("string"))).otherwise("").alias("contributor_display_name"), F.when(F.col("page_id") % 7 != 0, F.col("url")).otherwise("none").alias("proof_external_url"),
        F.when(F.col("page_id") % 3 == 0, "duplicate_candidate").otherwise("").alias("review_flags"), F.lit("2019").alias("project_year"), F.lit("draft").alias("permission_status"),
    )


@query
def q25_accept_reject_split(s, d):
    return export.split_counts(export.accept_reject(_upload(s, d), F.col("page_id")))


@query
def q25_contract_rows(s, d):
    return export.accept_reject(_upload(s, d), F.col("page_id")).select("row_number", "contributor_kind", "artist_name", "organization_name", "proof_confidence", "review_status", "permission_status", "import_notes", "accepted")


@query
def q26_enum_map(s, d):
    o = table(s, d, "orders")
    return o.select("o_orderkey", contract.contract_kind(F.element_at(F.split("o_orderpriority", "-"), 2)).alias("kind"), contract.confidence(F.element_at(F.split("o_orderpriority", "-"), 2)).alias("confidence"))


@query
def q27_contract_detect(s, d):
    o = table(s, d, "orders").withColumn("contract_version", F.when(F.col("o_orderstatus") == "F", "csv_v1").when(F.col("o_orderstatus") == "O", "csv_v0").otherwise(" none "))
    return contract.detect_contract(o).select(F.array_join("versions", "|").alias("versions"), "blanks", "rows", "is_contract")


@query
def q28_flatten_row(s, d):
    return verify.flat_report(table(s, d, "labels").select("doc_id", (F.col("quality") == 1).alias("good"), (F.col("doc_id") / 7).alias("score"), F.array(F.lit("a"), F.lit("b")).alias("warnings")))


@query
def q29_status_decision(s, d):
    docs = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    score = (F.col("doc_id") % 101) / F.lit(100.0)
    status = decide.match_status(score, F.col("quality") == 1, F.col("doc_id") % 2, F.col("doc_id") % 3, F.col("doc_id") % 3 + F.col("doc_id") % 2, F.col("toxic") == 1)
    return docs.select("doc_id", status.alias("status"))


@query
def q30_status_summary(s, d):
    o = table(s, d, "orders").select(F.col("o_orderstatus").alias("verification_status"), (F.col("o_orderkey") % 7).cast("long").alias("image_count"), (F.col("o_orderkey") % 3).cast("long").alias("active_image_count"))
    return verify.summary(o)


@query
def q31_image_choice(s, d):
    found = html.hrefs(F.col("html"))
    return table(s, d, "pages").select("page_id", F.get(F.filter(found, lambda x: ~u.rejected_image(x) & (x != "")), F.lit(0)).alias("image"), decide.attribution(F.col("url"), F.lit("Photo by A"))["confidence"].alias("confidence"))


# --- credits and people


def _credit() -> Column:
    n = F.col("c_custkey") % 6
    name = F.concat(F.lit("Ada Lovelace"), F.col("c_nationkey").cast("string"))
    return (
        F.when(n == 0, "Jane Doe aka Sparkle").when(n == 1, F.concat(F.lit("The "), F.initcap(F.lower("c_mktsegment")), F.lit(" Collective"))).when(n == 2, "Ann Lee and Bo Kim, Cy Roe")
        .when(n == 3, "Max (Blaze) Power").when(n == 4, "Ada Lovelace").otherwise(F.lower("c_mktsegment"))
    )


@query
def q32_credit_class(s, d):
    return with_credit(table(s, d, "customer").select("c_custkey", _credit().alias("credit")), "credit").select("c_custkey", "c.credit_type", "c.legal_name", "c.alias_name", F.array_join("c.named_people", "|").alias("people"), F.col("c.alias_confidence").alias("confidence"))


@query
def q32_contributor_kind(s, d):
    k = contributor_kind(F.lit("person"), F.concat_ws(" ", "c_name", F.lower("c_mktsegment"), F.lit("works")))
    return table(s, d, "customer").select("c_custkey", k.alias("kind"), person_or_org(k).alias("side"), name_parts(F.concat(F.lit("Dr. Ann B. "), F.initcap(F.lower("c_mktsegment"))))["last"].alias("last"))


@query
def q33_people_dedupe(s, d):
    found = people.people_in(table(s, d, "documents"), ["doc_id"], "text")
    return found.select("doc_id", F.array_join(F.transform("people", lambda p: F.lower(p["name"])), "|").alias("people"))


@query
def q33_split_people(s, d):
    return table(s, d, "customer").select("c_custkey", F.array_join(people_of(_credit()), "|").alias("people"), F.array_join(t.artist_names(_credit()), "|").alias("names"))


# --- pages and lines


@query
def q34_link_extract(s, d):
    return table(s, d, "pages").select("page_id", F.explode(html.hrefs(F.col("html"))).alias("href")).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


@query
def q35_link_routing(s, d):
    pages = table(s, d, "pages").select(F.col("page_id").alias("page"), F.posexplode(html.hrefs(F.col("html"))).alias("pos", "href"), F.lit("").alias("text"), F.lit(None).cast("string").alias("rel"), F.lit(None).cast("string").alias("css"))
    routed = links.route_links(pages, F.lit("https://archive.example.org/archive/"))
    return routed.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query
def q36_islands(s, d):
    e = table(s, d, "events").select("user_id", "event_id", "event_type", "ts").withColumn("pos", F.struct("ts", "event_id"))
    change = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("pos"))
    runs = lines.islands(e.withColumn("_c", change.isNull() | (change != F.col("event_type"))), ["user_id"], "pos", F.col("_c"))
    return runs.groupBy("user_id", "island", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query
def q37_lookahead_start(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("page"), F.struct("ts", "event_id").alias("line"), F.when(F.col("event_type") == "click", "by: x").when(F.col("event_type") == "view", "year: 2019").otherwise("Some title").alias("text"), F.lit(None).cast("string").alias("href"), "event_id")
    return lines.record_starts(e).where("is_start").select("event_id")


@query
def q38_html_events(s, d):
    parsed = html.parse_pages(table(s, d, "pages"))
    return html.page_events(parsed).groupBy("page", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("value")).alias("chars"))


@query
def q38_inline_records(s, d):
    """Records of listing pages made from the catalog: a page per nation, a block per supplier."""
    block = F.concat(
        F.lit('<article><a href="https://archive.example.org/archive/#a2I'), F.col("s_suppkey").cast("string"), F.lit('">'), F.col("s_name"), F.lit("</a><p>by: Artist "), F.col("s_suppkey").cast("string"),
        F.lit("</p><p>from: Town</p><p>year: 2019</p><p>Made of wood and light.</p><img src='/i/"), F.col("s_suppkey").cast("string"), F.lit(".jpg' alt='Photo'><p>URL: </p><p>http://x.example/"), F.col("s_suppkey").cast("string"), F.lit("</p></article>"),
    )
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", block.alias("b")))), lambda x: x["b"]), "")
    page = table(s, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("page_id")).agg(F.concat(F.lit("<html><body>"), joined, F.lit("</body></html>")).alias("html"))
    found = page_plans.inline_records(page, F.lit("https://archive.example.org/archive/"))
    return found.select(F.col("page").alias("page_id"), "source_position", "title", "artist_display_text", "artist_location", "year", "description", "website_url", "source_url", F.array_join("image_urls", "|").alias("images"), "image_alt_text")


# --- ordered scans, state


@query
def q39_attempt_ceiling(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") != "P").alias("attempted"), (F.col("o_orderstatus") == "F").alias("succeeded"))
    return keyed.attempt_window(o, ["o_custkey"], F.col("o_orderkey"), F.lit(3)).select("o_custkey", "o_orderkey")


@query
def q40_manifest_diff(s, d):
    p = table(s, d, "pages")
    return keyed.manifest_diff(p.where("page_id % 10 != 3").select("url", F.col("page_id").alias("position")), p.where("page_id % 10 != 7").select("url", F.when(F.col("page_id") % 9 == 0, F.col("page_id") + 1).otherwise(F.col("page_id")).alias("position"))).select("url", "label")


@query
def q41_next_unprocessed(s, d):
    o = table(s, d, "orders")
    cand = o.select(F.col("o_orderkey").cast("string").alias("canonical_url"), F.col("o_orderkey").alias("position"))
    done = o.where("o_orderkey < 500 or o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("canonical_url"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("skipped").alias("status"))
    return keyed.next_unprocessed(cand, done)


@query
def q42_upsert_keep_first_seen(s, d):
    e = table(s, d, "events")
    state = lambda part, order: ordering.last_wins(e.where(part), [F.col("user_id")], F.struct("ts", "event_id")).select("user_id", F.col("event_type").alias("status"), F.col("ts").alias("first_seen"))
    return keyed.upsert(state("event_id % 2 = 0", 0), state("event_id % 2 = 1", 1), ["user_id"], {"first_seen": "min"})


@query
def q43_anti_insert(s, d):
    e = table(s, d, "events").select("user_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("event_type"), F.col("event_id").alias("pos"))
    return keyed.anti_insert(e.where("pos % 3 = 0").select("user_id", "event_type"), e.where("pos % 3 != 0"), ["user_id", "event_type"]).select("user_id", "event_type", "pos")


@query
def q44_overlay_latest_change(s, d):
    rows = table(s, d, "customer").select(F.col("c_custkey").alias("project_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    e = table(s, d, "events")
    changes = e.select(F.col("user_id").alias("project_id"), F.when(F.col("event_type") == "click", "name").otherwise("segment").alias("field"), F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("v"), F.col("event_id").cast("string"))).alias("final_value"), F.when(F.col("event_id") % 3 == 0, "rejected").otherwise("approved").alias("review_status"), F.col("event_id").alias("change_id"))
    return keyed.overlay_changes(rows, changes, "project_id", ["name", "segment"])


@query
def q45_strict_majority(s, d):
    return ordering.strict_majority(table(s, d, "orders"), ["o_custkey"], F.nullif(F.col("o_orderstatus"), F.lit("P"))).select("o_custkey", "winner", "votes", "total")


@query
def q45_resume_selection(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("project_id"), F.col("o_orderkey").alias("batch_index"))
    status = F.element_at(F.array(*[F.lit(x) for x in ("approved", "failed", "skipped", "no_sources_found")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    latest = table(s, d, "orders").where("o_orderkey % 5 != 0").select(F.col("o_orderkey").alias("project_id"), status.alias("status"))
    return keyed.select_records(o, latest, "resume", 200).select("project_id")


@query
def q45_cached_search(s, d):
    e = table(s, d, "events")
    cache = e.where("event_id % 2 = 0").select(F.col("user_id").alias("key"), F.col("ts").alias("retrieved_at"), F.col("event_id").alias("answer"))
    queries = e.select(F.col("user_id").alias("key")).distinct()
    hits, misses = keyed.cached_search(queries, cache.withColumn("retrieved_at", F.struct("retrieved_at", "answer").getField("retrieved_at")), F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"), 10)
    return hits.select("key").withColumn("state", F.lit("hit")).unionByName(misses.withColumn("state", F.lit("miss")))


# --- ranking, review, view


@query
def q46_rank_top5(s, d):
    rows = table(s, d, "documents").select("source", "doc_id", F.col("n_chars"), F.concat(F.lit("https://"), F.lower("source"), F.when(F.col("doc_id") % 3 == 0, F.lit(".museum.example")).otherwise(F.lit(".blog.example"))).alias("url"))
    rows = rows.withColumn("priority", decide.source_priority(decide.source_type(F.col("url"))))
    rank = F.row_number().over(Window.partitionBy("source").orderBy("priority", F.desc("n_chars"), "doc_id"))
    return rows.withColumn("rank", rank.cast("long")).where("rank <= 5").select("source", "rank", "doc_id", v.relevance(F.col("priority"), F.array(F.lit("a"), F.lit("b"))).cast("long").alias("relevance"))


@query
def q46_search_queries(s, d):
    c = table(s, d, "customer")
    r = F.struct(F.col("c_name").alias("project_title"), F.lit("Ann Lee aka Bo - Studio").alias("contributor_name"), F.lit("2019").alias("year"), F.lit(None).cast("string").alias("artist_website"), F.lit("http://www.x.example/a").alias("project_website"), F.lit("Oakland, CA").alias("artist_location"), F.lit("").alias("artist_collective"), F.lit("wood").alias("materials"))
    return c.select("c_custkey", F.posexplode(enrich.search_queries(r)).alias("pos", "query")).select("c_custkey", F.col("pos").cast("long").alias("pos"), "query")


@query
def q47_review_gate(s, d):
    e = table(s, d, "events")
    field = F.when(F.col("event_type") == "click", "project_title").otherwise("contributor_website")
    status = decide.review_status(field, F.when(F.col("event_id") % 2 == 0, "directly_stated").otherwise("strongly_inferred"), F.when(F.col("event_id") % 3 == 0, "first_party").otherwise("press"), F.lit(0.5) + (F.col("event_id") % 50) / 100, F.col("event_id") % 7 != 0)
    return e.select("event_id", status.alias("status"))


def _view(s, d) -> DataFrame:
    p = table(s, d, "part")
    return p.select(
        F.col("p_name").alias("title"), F.col("p_partkey").cast("string").alias("uid"), t.slugify(F.col("p_name")).alias("slug"), F.col("p_type").alias("proof_url"), F.struct(F.when(F.col("p_size") > 25, F.lit("")).otherwise(F.col("p_brand")).alias("url")).alias("hero"),
        F.struct(F.col("p_brand").alias("contributor_display_name"), F.lit("").alias("source_artist_credit")).alias("people"), F.struct(F.lit("").alias("theme_camp")).alias("place"), F.when(F.col("p_size") > 25, F.array(F.lit("hero_missing"))).otherwise(F.array().cast("array<string>")).alias("review_flags"),
        (F.col("p_size") > 25).alias("needs_attention"), (F.col("p_size") <= 25).alias("upload_ready"), F.lit(0).alias("review_priority"),
    )


@query
def q48_named_filter_search(s, d):
    return view.search(_view(s, d), "missing_hero", " Brand#1").select("uid", "title")


@query
def q49_export_by_keys(s, d):
    p = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("event_uid"), t.slugify(F.col("p_name")).alias("project_slug"), F.col("p_name").alias("project_title"))
    wanted = table(s, d, "supplier").select(F.explode(F.array(F.col("s_suppkey").cast("string"), F.lit("no such key"))).alias("key"))
    return view.export_by_keys(p, wanted)


@query
def q50_facets(s, d):
    docs = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    flags = F.array_compact(F.array(F.when(F.col("quality").isNull(), F.lit("missing_archive_cache")), F.when(F.col("toxic") == 1, F.lit("identity_needs_review")), F.when(F.col("quality") == 0, F.lit("hero_needs_review"))))
    return docs.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query
def q50_priority(s, d):
    docs = table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left")
    flags = F.array_compact(F.array(F.when(F.col("quality").isNull(), F.lit("honorarium_unknown")), F.when(F.col("toxic") == 1, F.lit("duplicate_candidate")), F.when(F.col("quality") == 0, F.lit("hero_needs_review"))))
    ready = decide.upload_ready(F.col("source"), F.col("lang"), F.col("text"), flags)
    return docs.select("doc_id", decide.review_priority(flags, t.blank(F.col("text")).isNull(), F.col("n_chars") > 100).cast("long").alias("priority"), ready.alias("ready"))


@query
def q51_publish_readiness(s, d):
    """Flagship: which pages are ready to publish, and why not the others. Pages are looked up in documents by id,
    then by normalized title; the choice of source, flags, priority and readiness follow."""
    pages = table(s, d, "pages").select("page_id", "url", _title().alias("title"))
    docs = table(s, d, "documents").where("doc_id % 4 != 1").select("doc_id", "source", "n_chars", F.element_at(F.split("text", "\n"), 1).alias("doc_title"))
    cache = Index(docs, F.col("doc_id").cast("string"), [t.normalize_title(F.col("doc_title"))], F.col("doc_id"))
    base = fallback_lookup(pages, cache, F.col("page_id").cast("string"), [t.normalize_title(t.text_of(F.col("title")))], "doc")
    labels = Index(table(s, d, "labels"), F.col("doc_id").cast("string"), [F.lit(None).cast("string")], F.col("doc_id"))
    base = fallback_lookup(base, labels, F.col("doc.doc_id").cast("string"), [F.lit(None).cast("string")], "label")
    when = lambda c, f: F.when(c, F.lit(f))
    flags = F.array_compact(F.array(when(F.col("doc").isNull(), "missing_archive_cache"), when(F.col("label.quality") == 0, "hero_needs_review"), when(F.col("label.toxic") == 1, "identity_needs_review"), when(F.col("label").isNull(), "honorarium_unknown")))
    base = base.withColumn("flags", flags).withColumn("link", u.normalize_url(F.col("url")))
    # as in the ingest, a title without a-z and 0-9 has a stand-in for its slug and is not missing
    slug = F.coalesce(F.nullif(t.slugify(t.text_of(F.col("title"))), F.lit("")), F.lit("untitled"))
    miss = decide.missing_required(F.col("title"), slug, F.col("link"))
    return base.select(
        "page_id", F.col("link").alias("url"), t.normalize_title(t.text_of(F.col("title"))).alias("key"), F.col("doc_mode").alias("found_by"), F.col("doc.source").alias("source"), decide.format_flags(F.col("flags")).alias("flags"),
        decide.review_priority(F.col("flags"), miss, F.coalesce(F.col("doc.n_chars") > 100, F.lit(False))).cast("long").alias("priority"),
        decide.upload_ready(F.col("title"), slug, F.col("link"), F.col("flags")).alias("upload_ready"),
    )
