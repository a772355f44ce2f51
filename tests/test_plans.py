"""Pipelines end to end on small tables, files and folders."""

import json
import os

import pytest
from pyspark.sql import functions as F

from linkforge.operators.html import detail_records, parse_pages
from linkforge.operators.links import candidates, route_links
from linkforge.operators.html import page_links
from linkforge.operators.schema import Field, Schema
from linkforge.plans import export, identity, ingest, pages, verify, view
from linkforge.operators.rules.credit import with_credit
from linkforge.profile import Profile
from linkforge.sources import readers, sinks, web
from linkforge.streaming.upserts import stream_upserts

P = Profile(official_hosts=("archive.example.org",), listing_file_pattern=r"^Listing-(\d{4}).*\.csv$")

LISTING = """
<html><head><title>2019 Archive</title></head><body>
<article><h2><a href="#a2Ione">Tree of Light</a></h2><p>by: Ann Lee</p><p>from: Oslo</p><p>year: 2019</p><p>A big tree.</p><p>It glows.</p><img src="/i/1.jpg" alt="Photo by Bo"><p>URL: <a href="http://tree.example">http://tree.example</a></p><p>Contact: x@y.org</p></article>
<article><h2>Moon</h2><p>by: Bo Kim</p><p>year: 2019</p><p>A moon.</p><p><a href="https://x.org/donate">Donate to this project</a></p></article>
</body></html>"""


def test_listing_pages(spark):
    df = spark.createDataFrame([(1, LISTING), (2, None), (3, "<p>nothing")], "page_id long, html string")
    url = F.lit("https://archive.example.org/archive/2019/")
    got = pages.inline_records(df, url, P).orderBy("source_position").collect()
    assert [r.title for r in got] == ["Tree of Light", "Moon"]
    tree, moon = got
    assert (tree.title, tree.artist_display_text, tree.artist_location, tree.year, tree.description) == ("Tree of Light", "Ann Lee", "Oslo", "2019", "A big tree. It glows.")
    assert (tree.website_url, tree.contact, tree.image_urls, tree.image_alt_text) == ("http://tree.example", "x@y.org", ["https://archive.example.org/i/1.jpg"], "Photo by Bo")
    assert tree.source_url.endswith("#a2Ione") and moon.description == "A moon." and moon.image_urls == []
    full = pages.installation_records(pages.inline_records(df, url, P), url, P).orderBy("source_position").collect()
    assert full[0].uid == "a2Ione" and full[1].missing_fields == ["primary_image_url", "photographer_credit"] and 0 < full[1].extraction_confidence < 1


def test_detail_page_and_links(spark):
    html = """<html><head><link rel="canonical" href="/installation/tree/"><title>Tree | Site</title></head><body><h1>Tree</h1><div class="artist">Ann Lee</div>
    <div class="description"><b>Big</b> tree</div><img src="/i/2.jpg"><a href="http://ann.example">Ann</a><a href="/installation/moon/?utm_source=x">Moon</a><a href="?page=2" rel="next">more</a>
    <a href="#top">top</a><a href="mailto:a@b.c">m</a><a href="/archive/2018/">old</a><a href="/help">h</a></body></html>"""
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    parsed = parse_pages(df)
    record = detail_records(parsed, F.lit("https://archive.example.org/installation/tree/?utm_source=a"), "archive.example.org").first()
    assert (record.title, record.artist_display_text, record.description) == ("Tree", "Ann Lee", "Big tree")
    assert record.website_url == "http://ann.example" and record.canonical_source_url == "https://archive.example.org/installation/tree/"
    routed = route_links(page_links(parsed), F.lit("https://archive.example.org/archive/"), P)
    got = sorted(r.reason for r in routed.collect())
    assert got == sorted(["external_website", "candidate", "pagination_not_authorized", "non_http_link", "archive_or_discovery_page_outside_boundary", "internal_non_installation_link"])
    assert [r.url for r in candidates(routed).collect()] == ["https://archive.example.org/installation/moon/"]


@pytest.fixture()
def caches(spark, tmp_path):
    (tmp_path / "Listing-2019_ART.csv").write_text('﻿Title,Description,UID,Link,Extra\nTree,"Big\ntree",u1,https://l/2019-installations/1,-\nMoon,,,,\nMoon,again,u3,,\ntitle,x,,,\n', encoding="utf-8")
    (tmp_path / "Listing-2018_ART.csv").write_text("Title,Description,UID\nOld,x,u9\n")
    rows = readers.listing_dir(spark, str(tmp_path), 2019, P)
    index = {"records": [{"year": "2019", "title": "Tree", "uid": "u1", "artist_display_text": "Ann Lee", "canonical_source_url": "https://archive.example.org/t", "image_urls": ["https://x/logo.png", "https://archive.example.org/t.jpg"]}]}
    (tmp_path / "index.json").write_text(json.dumps(index))
    (tmp_path / "images.json").write_text(json.dumps({"images": [{"project_title": "Moon", "archive_uid": None, "images": [{"image_url": "https://m/x.jpg", "link_active": True, "credit_text": "Bo"}]}]}))
    (tmp_path / "export.json").write_text(json.dumps([{"mapped_values": {"project_title": "Moon", "contributor_name": "Bo Kim", "project_year": "2019"}, "original_scraped_values": {}, "source_position": 1, "record_status": "completed"}]))
    verification = spark.createDataFrame([("u1", None, "Tree", "2019", "https://archive.example.org/t", "Ann", "verified", None, None, None, 1)], "archive_uid string, www_uid string, project_title string, year string, archive_url string, archive_artist string, verification_status string, hero_image_url string, hero_image_active string, public_credit string, _ord int")
    identity_rows = spark.createDataFrame([("u1", "Tree", "2019", "Ann Lee", "person", "Ann Lee", None, None, None, None, "resolved", "http://ann", 1)], "uid string, project_title string, year string, archive_credit string, credit_type string, legal_name string, alias_name string, alias_confidence string, collective_name string, named_people string, identity_status string, artist_website string, _ord int")
    c = ingest.Caches(verification, readers.archive_index(spark, str(tmp_path / "index.json")), readers.image_manifest(spark, str(tmp_path / "images.json")), readers.collector_exports(spark, str(tmp_path / "export.json")), identity_rows)
    return rows, c


def test_ingest_and_view(spark, caches, tmp_path):
    rows, c = caches
    assert rows.count() == 3
    out = ingest.ingest_rows(rows, c, P)
    got = {(r.project_title, r.event_uid): r for r in out.collect()}
    tree, moon = got["Tree", "u1"], got["Moon", ""]
    assert (tree.contributor_name, tree.proof_external_url, tree.hero_image_url, tree.contributor_website) == ("Ann Lee", "https://archive.example.org/t", "https://archive.example.org/t.jpg", "http://ann")
    assert tree.source_provenance == "www|verification|archive_index|identity_report|hero:archive_index" and tree.review_flags == "honorarium_unknown"
    assert moon.contributor_name == "Bo Kim" and moon.hero_image_url == "https://m/x.jpg" and moon.review_flags.startswith("missing_archive_cache|duplicate_candidate")
    stats = ingest.ingest_stats(out).first()
    assert (stats.source_rows, stats.uid_matches, stats.identity_cache_matches, stats.hero_images_found) == (3, 2, 1, 3)
    v = ingest.project_view(out).cache()
    assert ingest.checklist(v).first().upload_ready_count == 1
    assert {r.flag: r.n for r in ingest.flag_counts(v).collect()}["duplicate_candidate"] == 2
    assert [r.title for r in view.search(v, "ready", "ann").collect()] == ["Tree"]
    keys = spark.createDataFrame([("u1",), ("nothing",)], "key string")
    assert view.export_by_keys(out.drop("_ord"), keys).count() == 1
    assert view.kept_and_skipped(out).first().kept == 1 and view.file_label(" Missing Hero! ") == "missing-hero"
    sinks.write_single_csv(out.select("project_title", "review_flags"), str(tmp_path / "out.csv"))
    assert (tmp_path / "out.csv").read_bytes().startswith(b"\xef\xbb\xbfproject_title,review_flags\r\n")


def test_verify(spark, caches):
    rows, c = caches
    targets = verify.select_targets("all", c.archive, rows)
    probes = spark.createDataFrame([("https://archive.example.org/t.jpg", 200, "image/jpeg", 9000)], "url string, status int, content_type string, content_length long")
    got = {r.project_title: r for r in verify.verify(targets, c.archive, rows, probes, P).collect()}
    assert got["Tree"].verification_status == "verified_online" and got["Tree"].active_image_count == 1 and got["Moon"].verification_status == "unresolved"
    flat = {r.project_title: r for r in verify.flat_report(verify.verify(targets, c.archive, rows, None, P)).collect()}
    assert flat["Tree"].verification_status == "broken_link" and flat["Tree"].title_match_score == "1.00" and flat["Tree"].uid_match == "True"


def test_listing_guards(spark, tmp_path):
    with pytest.raises(readers.ListingError):
        readers.check_header(["project_title", "Title", "Description"])
    with pytest.raises(readers.ListingError):
        readers.check_header(["Title"])
    with pytest.raises(readers.ListingError):
        readers.resolve_year("Listing-2019.csv", "2020", P)
    df = spark.createDataFrame([("/2019-installations/a", 1), ("/2019-installations/b", 2), ("/2018-installations/c", 3), ("x", 4)], "legacy_link string, _ord int")
    assert readers.link_year(df, P).first().winner == "2019"


def test_identity(spark):
    rows = spark.createDataFrame([("k1", "firefly", "http://ff.example"), ("k2", "Jane Doe", None), ("k3", "Spark Collective", None)], "key string, archive_artist string, artist_website string")
    told = spark.createDataFrame([("k1", "http://ff.example/about", 1, "Firefly (Jane Roe) builds."), ("k3", "http://x.example", 1, "Spark Collective. Lead artist: Ann Lee.")], "key string, url string, pos int, text string")
    got = {r.key: r for r in identity.resolve(with_credit(rows, "archive_artist", "c"), told).collect()}
    assert (got["k1"].legal_name, got["k1"].alias_name, got["k1"].identity_status) == ("Jane Roe", "firefly", "resolved")
    assert got["k2"].identity_status == "resolved" and got["k3"].identity_status == "partial" and got["k3"].legal_name == "Ann Lee"


def test_batches_and_contract_files(spark, tmp_path):
    rows = [(1, i, "completed" if i == 1 else None, i != 2, f"u{min(i, 4)}") for i in range(1, 7)]
    df = spark.createDataFrame(rows, "source_id int, position int, status string, valid boolean, canonical_url string")
    seen = {r.position: r.outcome for r in export.scrape_batch(df, 2).collect()}
    assert seen == {1: "skipped", 2: "failed", 3: "completed", 4: "completed"}
    assert export.batch_counts(export.scrape_batch(df, 2), 2).first().status == "completed"
    up = spark.createDataFrame([(1, "person", "Ann Lee", "Tree"), (2, "", "", "")], "n int, contributor_kind string, contributor_display_name string, project_title string")
    export.export_contract(up, F.col("n"), str(tmp_path / "out"), P)
    assert spark.read.option("header", True).csv(str(tmp_path / "out/accepted")).count() == 1
    assert [r.row_number for r in spark.read.option("header", True).csv(str(tmp_path / "out/rejected")).collect()] == ["3"]
    assert sinks.write_batch(df, str(tmp_path / "b")).endswith("batch_001") and sinks.next_number(spark, str(tmp_path / "b")) == 2
    with pytest.raises(ValueError):
        sinks.write_batch(df, str(tmp_path / "b"), overwrite=1)
    with pytest.raises(ValueError):
        sinks.write_valid_csv(spark.createDataFrame([("",)], "a string"), Schema("1", (Field("a", True),)), str(tmp_path / "c"))


def test_web_through_cache(spark):
    def get(url, politeness):
        return (url, url, 200, "text/html", b"<p>x", "h", None) if "ok" in url else (url, url, None, None, None, None, "down")

    urls = spark.createDataFrame([("http://ok#f",), ("http://bad",), ("http://not-allowed",), ("http://cached",)], "url string")
    allowed = spark.createDataFrame([("http://ok",), ("http://bad",)], "url string")
    cache = spark.createDataFrame([("http://cached", "<p>y")], "url string, html string")
    fetched = web.through_cache(urls, cache, lambda misses: web.text_pages(web.fetch(misses, allowed, web.Politeness(delay=0), get)))
    assert {r.url: r.html for r in fetched.collect()} == {"http://cached": "<p>y", "http://ok": "<p>x"}
    body = json.dumps({"results": [{"title": "T", "url": "http://a", "content": "s"}, {"title": "U", "url": "http://b", "content": "s"}]})
    answers = spark.createDataFrame([("q", body)], "query string, body string")
    assert [r.url for r in web.normalized_results(answers, "searxng", 1).collect()] == ["http://a"]
    assert web.choose_provider("auto", {}).name == "none"


def test_stream_upserts(spark, tmp_path):
    os.makedirs(tmp_path / "in")
    schema = "k int, v string, n int"
    for i, rows in enumerate(([{"k": 1, "v": "a", "n": 1}, {"k": 1, "v": "b", "n": 2}], [{"k": 1, "v": "c", "n": 3}, {"k": 2, "v": "x", "n": 1}])):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        stream_upserts(spark, str(tmp_path / "in"), str(tmp_path / "state"), schema, ["k"], "n", str(tmp_path / "cp")).awaitTermination()
    assert {r.k: r.v for r in readers.state_table(spark, str(tmp_path / "state"), schema).collect()} == {1: "c", 2: "x"}


def test_status_counts_and_footprint(spark, tmp_path):
    from linkforge.operators import keyed

    records = spark.createDataFrame([(i,) for i in "abcdef"], "project_id string")
    latest = spark.createDataFrame([("a", "approved"), ("b", "failed"), ("c", "skipped"), ("d", "rejected"), ("x", "approved"), ("y", "failed")], "project_id string, status string")
    assert keyed.count_finished(latest).first().n == 4
    want = {"retry_failed": 1, "re_export_approved": 1, "reprocess_changed_rules": 5, "enrich_unprocessed": 2}
    assert {a: keyed.default_requested_count(records, latest, a).first().n for a in want} == want
    for name, size in (("b/deep/x.bin", 1_234_567), ("b/y.bin", 20_000), ("a/z.bin", 5_000_000), ("loose.bin", 9)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(bytes(size))
    (tmp_path / "empty").mkdir()
    assert [tuple(r) for r in readers.disk_footprint(spark, str(tmp_path)).collect()] == [("a", 5.0), ("b", 1.25), ("empty", 0.0), ("total_mb", 6.25)]
    assert readers.disk_footprint(spark, f"{tmp_path}/none").count() == 0


def test_positions_of_new_rows(spark):
    """Of two new rows of one position the later has it; the old holder and the earlier one are moved away."""
    from linkforge.operators import keyed

    kinds = "source_id int, canonical_url string, position int, record_row_id int, first_discovered_at string, record_json string, row_json string"
    old = spark.createDataFrame([(1, "o", 1, 1, "t0", "{}", None), (1, "p", 2, 2, "t0", "{}", None)], kinds)
    new = spark.createDataFrame([(1, "a", 1, 10, "t1", None, None), (1, "b", 1, 11, "t1", None, None), (1, "p", 3, 12, "t1", None, "{}")], kinds)
    got = {r.canonical_url: (r.position, r.first_discovered_at, r.record_json) for r in keyed.upsert_by_canonical(old, new).collect()}
    assert got == {"o": (-1, "t0", "{}"), "a": (-10, "t1", None), "b": (1, "t1", None), "p": (3, "t0", "{}")}


def test_targets_keep_their_direction(spark):
    """Later archive rows overwrite, the first listing row stands, whatever the numbers of the rows."""
    kinds = "uid string, title string, artist_display_text string, description string, image_urls array<string>, image_alt_text string, _ord int"
    for shift in (0, 7, 1000):
        archive = spark.createDataFrame([("u", "T", f"artist{i}", None, [], None, i + shift) for i in range(4)], kinds)
        listing = spark.createDataFrame([("v", "V", None, f"text{i}", [], None, i + shift) for i in range(4)] + [("u", "T", None, "x", [], None, 99)], kinds)
        got = {r.uid: (r.artist, r.description, r.source) for r in verify.select_targets("all", archive, listing).collect()}
        assert got == {"u": ("artist3", None, "archive"), "v": (None, "text0", "listing")}


def test_equal_confidence_goes_by_page_order(spark):
    rows = spark.createDataFrame([("k", "Spark Collective", None)], "key string, archive_artist string, artist_website string")
    for names in (("Ann Lee", "Bo Kim"), ("Bo Kim", "Ann Lee"), ("Cy Roe", "Ann Lee")):
        told = spark.createDataFrame([("k", f"http://{'zyx'[i]}.example", i + 1, f"Spark Collective. Lead artist: {n}.") for i, n in enumerate(names)], "key string, url string, pos int, text string")
        got = identity.resolve(with_credit(rows, "archive_artist", "c"), told).first()
        places = {p.name: p.pos for p in got.people}
        assert places[names[0]] < places[names[1]]


def test_state_survives_a_crash_between_renames(spark, tmp_path):
    path, schema = str(tmp_path / "state"), "k int"
    sinks.replace_state(spark.createDataFrame([(1,)], schema), path)
    os.rename(path, f"{path}.old")
    assert readers.state_table(spark, path, schema).first().k == 1
    sinks.replace_state(spark.createDataFrame([(2,)], schema), path)
    assert [r.k for r in readers.state_table(spark, path, schema).collect()] == [2] and not os.path.exists(f"{path}.next")


def test_batch_sources(spark, tmp_path):
    """Records as an array or in an object; JSON first, then the state table, then CSV; ids count rows before the filter."""
    rows = [{"mapped_values": {"project_title": f"T{i}"}, "original_scraped_values": {"record_id": "r1"} if i == 0 else {}, "record_status": s} for i, s in enumerate(("completed", "failed", None, ""))]
    for name, doc in (("array", rows), ("records", {"records": rows}), ("items", {"items": rows})):
        (tmp_path / f"{name}.json").write_text(json.dumps(doc))
        got = readers.load_batch(spark, str(tmp_path / f"{name}.json"), None, "")
        assert [(r.project_id, r.batch_index, r.title) for r in got.orderBy("batch_index").collect()] == [("r1", 1, "T0"), ("record-3", 2, "T2"), ("record-4", 3, "T3")]
    state = spark.createDataFrame([("completed", None, "http://s", "S", None, 1), ("failed", "x", None, "F", None, 2)], "record_status string, record_id string, source_url string, title string, contributor string, _ord int")
    assert [r.project_id for r in readers.load_batch(spark, str(tmp_path / "none.json"), state, "").collect()] == ["http://s"]
    (tmp_path / "b.csv").write_text("project_title,record_id\nA,1\nB,\n")
    assert [r.project_id for r in readers.load_batch(spark, str(tmp_path / "none.json"), None, str(tmp_path / "b.csv")).orderBy("batch_index").collect()] == ["1", "record-2"]
    assert readers.load_batch(spark, str(tmp_path / "none.json"), None, str(tmp_path / "none.csv")) is None


def test_robots_rules(spark):
    pages = {"http://a.example/robots.txt": b"User-agent: *\nDisallow: /private\n\nUser-agent: linkforge\nDisallow: /mine\n", "http://a.example/private": b"x", "http://a.example/mine": b"x", "http://b.example/private": b"y"}

    def get(url, politeness):
        body = pages.get(url)
        return (url, url, 200, "text/html", body, "h", None) if body else (url, url, 404, None, None, None, "HTTP 404")

    urls = spark.createDataFrame([("http://a.example/private",), ("http://a.example/mine",), ("http://b.example/private",), ("http://b.example/private",)], "url string")
    got = {r.url: (r.status, r.error) for r in web.fetch_politely(urls, web.Politeness(delay=0), get).collect()}
    assert got == {"http://a.example/private": (200, None), "http://a.example/mine": (None, "robots.txt disallows fetching this URL"), "http://b.example/private": (200, None)}
    other = {r.url: r.allowed for r in web.robots_allowed(urls, spark.createDataFrame([("http://a.example/robots.txt", pages["http://a.example/robots.txt"])], "url string, body binary"), "other").collect()}
    assert not other["http://a.example/private"] and other["http://a.example/mine"] and other["http://b.example/private"]
