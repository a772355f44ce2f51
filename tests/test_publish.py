"""Outputs of whole runs: a year's files, reports, packages, published views, sitemaps, the command line."""

import json

import pytest
from pyspark.sql import functions as F

from linkforge import __main__ as command
from linkforge.operators.schema import Field, Schema
from linkforge.plans import export, publish
from linkforge.profile import Profile
from linkforge.sources import readers, sinks

P = Profile(official_hosts=("archive.example.org",))
CORE = ["project_title", "project_slug", "project_year", "proof_external_url", "client_name"]
MORE = ["event_uid", "review_flags", "source_provenance"]


@pytest.fixture()
def files(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/Listing-2019_ART.csv").write_text("Title,Description,UID\nTree,Big,u1\nMoon,,\n")
    (tmp_path / "verification.csv").write_text("archive_uid,project_title,year,archive_url,verification_status\nu1,Tree,2019,https://archive.example.org/t,verified\n")
    (tmp_path / "identity.csv").write_text("uid,project_title,year,archive_credit,credit_type,legal_name,identity_status\nu1,Tree,2019,Ann Lee,person,Ann Lee,resolved\n")
    (tmp_path / "archive.json").write_text(json.dumps({"records": [{"year": "2019", "title": "Tree", "uid": "u1", "canonical_source_url": "https://archive.example.org/t", "image_urls": ["https://archive.example.org/t.jpg"]}]}))
    (tmp_path / "images.json").write_text(json.dumps({"images": [{"project_title": "Moon", "images": [{"image_url": "https://m/x.jpg", "link_active": True, "credit_text": "Bo"}]}]}))
    (tmp_path / "collector.json").write_text(json.dumps([{"mapped_values": {"project_title": "Moon", "project_year": "2019"}, "original_scraped_values": {}}]))
    fields = [{"order": i + 1, "name": n, "required": n in CORE[:2], "data_type": "string", "null_behavior": "empty", "default_value": "", "validation_rules": ["non_empty"] if n in CORE[:2] else []} for i, n in enumerate(CORE)]
    (tmp_path / "schema.json").write_text(json.dumps({"schema_version": "1", "columns": fields}))
    return tmp_path


def test_year_from_the_command_line(spark, files, capsys):
    """Listing and caches in; upload, core, review queue, view and summary out; then a package of what is ready."""
    args = [f"--{n}={files}/{n}.{e}" for n, e in (("verification", "csv"), ("identity", "csv"), ("archive", "json"), ("images", "json"), ("collector", "json"), ("schema", "json"))]
    stop, type(spark).stop = type(spark).stop, lambda self: None
    try:
        command.main(["ingest", f"--listing={files}/in", f"--out={files}/out", "--year=2019", f"--extensions={','.join(MORE)}", *args])
        paths = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
        upload = {r.project_title: r for r in readers.read_csv(spark, paths["upload"]).collect()}
        assert list(upload["Tree"].asDict())[:-1] == CORE + MORE and upload["Tree"].proof_external_url == "https://archive.example.org/t"
        assert spark.read.option("header", True).csv(paths["core"]).columns == CORE
        assert {r.project_title for r in readers.read_csv(spark, paths["review_queue"]).collect()} == {"Tree", "Moon"}
        summary = json.loads(publish.read_text(spark, paths["summary"]))
        assert (summary["year"], summary["project_count"], summary["upload_ready_count"], summary["review_queue_count"], summary["identity_cache_matches"]) == (2019, 2, 1, 2, 1)
        command.main(["deploy", f"--upload={paths['upload']}", f"--out={files}/package", "--year=2019", f"--schema={files}/schema.json"])
        manifest = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
        assert manifest == json.loads(publish.read_text(spark, f"{files}/package/manifest.json")) == {"year": 2019, "kept": 1, "skipped": 1, "failures": 0, "forced": False}
    finally:
        type(spark).stop = stop
    assert publish.publish_view(spark, paths["view"], f"{files}/www", 2019) == publish.resolve_view(spark, [f"{files}/none", f"{files}/www"], 2019)
    (files / "www/2018").mkdir()
    assert publish.prepared_years(spark, [f"{files}/www", f"{files}/none"]) == [2019] and publish.resolve_view(spark, [f"{files}/www"], 2018) is None


def test_packages_are_refused_unless_forced(spark, tmp_path):
    schema = Schema("1", (Field("project_title", True, rules=("non_empty",)), Field("project_slug", True, rules=("slug",)), Field("proof_external_url", data_type="url")))
    rows = spark.createDataFrame([("Tree", "Not A Slug", "http://t", "")], "project_title string, project_slug string, proof_external_url string, review_flags string")
    with pytest.raises(publish.NotReady):
        publish.deploy(rows, str(tmp_path / "a"), schema, 2019)
    with pytest.raises(publish.NotReady):
        publish.deploy(rows.limit(0), str(tmp_path / "a"), schema, 2019)
    assert publish.deploy(rows, str(tmp_path / "a"), schema, 2019, force=True) == {"year": 2019, "kept": 1, "skipped": 0, "failures": 1, "forced": True}


def test_reports(spark, tmp_path):
    up = spark.createDataFrame([(1, "person", "Ann Lee", "Tree"), (2, "", "", "")], "n int, contributor_kind string, contributor_display_name string, project_title string")
    judged = export.accept_reject(up, F.col("n"), P)
    paths = publish.write_contract_reports(judged, str(tmp_path), P)
    assert sorted(paths) == ["compatibility_report.md", "import_report.md", "validation_report.md"]
    text = publish.read_text(spark, paths["import_report.md"])
    assert "| accepted | 1 |" in text and "| person / " in text
    assert "Row needs at least one of project_title, artist_name, organization_name, or proof_external_url" in publish.read_text(spark, paths["validation_report.md"])
    assert "| missing columns | none |" in publish.read_text(spark, paths["compatibility_report.md"])


def test_enrichment_outputs(spark, tmp_path):
    schema = Schema("1", (Field("project_title", True, rules=("non_empty",)), Field("client_name")))
    rows = spark.createDataFrame([(1, "Tree", ""), (2, "Moon", "x")], "project_id long, project_title string, client_name string")
    changes = spark.createDataFrame([(1, "client_name", "ACME", "approved", 1), (2, "client_name", "y", "rejected", 2), (2, "project_title", "z", "unresolved", 3)], "project_id long, field string, final_value string, review_status string, change_id long")
    manifest = publish.write_enrichment(rows, changes, schema, str(tmp_path), 5)
    assert manifest == {"requested": 5, "records": 2, "approved_changes": 1, "rejected_changes": 1, "unresolved_changes": 1, "enriched_records": 2}
    assert {r.project_title: r.client_name for r in readers.read_csv(spark, f"{tmp_path}/enriched").collect()} == {"Tree": "ACME", "Moon": "x"}
    assert readers.read_csv(spark, f"{tmp_path}/review").count() == 3


def test_archive_index_round_trip(spark, tmp_path):
    index = spark.createDataFrame([("2019", "Tree", "u1", ["http://i"], 1)], "year string, title string, uid string, image_urls array<string>, _ord int")
    results = spark.createDataFrame([("verified", 1, 1, ["a"], [("http://i",)], "Tree", "u1", "http://t")], "verification_status string, image_count int, active_image_count int, warnings array<string>, images array<struct<image_url:string>>, project_title string, archive_uid string, archive_url string")
    publish.write_verification(results, index, str(tmp_path))
    assert [(r.title, r.uid, r.image_urls) for r in readers.archive_index(spark, f"{tmp_path}/archive_index").collect()] == [("Tree", "u1", ["http://i"])]


def test_sitemaps_recurse_and_stop(spark):
    loc = lambda kind, urls: f"<{kind}>" + "".join(f"<url><loc>{u}</loc></url>" for u in urls) + f"</{kind}>"
    bodies = {"a": loc("sitemapindex", ["b", "c", "a"]), "b": loc("urlset", ["p1", "p2&amp;x"]), "c": loc("sitemapindex", ["d", "b"]), "d": loc("urlset", ["p3", "p1"])}
    fetch = lambda urls: spark.createDataFrame([(r.url, bodies[r.url]) for r in urls.collect() if r.url in bodies], "url string, body string")
    seeds = spark.createDataFrame([("a",), ("gone",)], "url string")
    got = publish.crawl_sitemaps(seeds, fetch)
    assert [tuple(r) for r in got.collect()] == [("p1", "b", 1), ("p2&x", "b", 1), ("p3", "d", 2)]
    assert [r.url for r in publish.crawl_sitemaps(seeds, fetch, most_sitemaps=3).collect()] == ["p1", "p2&x"] and publish.crawl_sitemaps(seeds, fetch, most_urls=1).count() == 1
    report = publish.discovery_report(spark.createDataFrame([("candidate",)], "reason string"), got)
    assert "| candidate | 1 |" in report and "| b | 2 |" in report
