"""Whole runs: a year from listing to written outputs, reports, published views, deployable packages."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from linkforge.operators.contract import COLUMNS, EXTENSIONS
from linkforge.operators.keyed import overlay_changes
from linkforge.operators.links import sitemap_urls
from linkforge.operators.schema import Schema
from linkforge.plans import export, ingest, view
from linkforge.profile import DEFAULT, Profile
from linkforge.runtime import checkpointed
from linkforge.sources import readers, sinks


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """A small text file, written beside its place and renamed into it."""
    fs, where = _path(spark, path)
    _, staged = _path(spark, f"{path}.tmp")
    out = fs.create(staged, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(where, False)
    fs.rename(staged, where)
    return path


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, where = _path(spark, path)
    return "\n".join(r.value for r in spark.read.text(path).collect()) if fs.exists(where) else None  # a small file


def _with_all(rows: DataFrame, names: list[str]) -> DataFrame:
    """The named columns in order; those that rows lack are ''."""
    if len(set(names)) != len(names):
        raise ValueError("repeated headers")
    return rows.select(*[F.col(n) if n in rows.columns else F.lit("").alias(n) for n in names])


def write_ingest(rows: DataFrame, folder: str, core: list[str], extensions: list[str], year: int | None = None) -> dict[str, str]:
    """The outputs of a year: upload (core and extension columns), core, review queue (rows with a flag), view and
    summary. Returns where each lies."""
    rows = checkpointed(rows)
    shown = ingest.project_view(rows)
    paths = {n: f"{folder}/{n}" for n in ("upload", "core", "review_queue", "view", "flag_counts")} | {"summary": f"{folder}/summary.json"}
    sinks.write_csv(_with_all(rows, [*core, *extensions]), paths["upload"])
    sinks.write_csv(_with_all(rows, core), paths["core"])
    sinks.write_csv(_with_all(rows.where("review_flags != ''"), [*core, *extensions]), paths["review_queue"])
    sinks.write_json(shown, paths["view"])
    counts = ingest.flag_counts(shown)
    sinks.write_json(counts, paths["flag_counts"])
    queue = rows.agg(F.count_if(F.col("review_flags") != "").alias("review_queue_count"))
    totals = {"year": year}
    for one in (ingest.checklist(shown), queue, ingest.ingest_stats(rows)):
        totals |= one.first().asDict()  # one row each
    write_text(rows.sparkSession, paths["summary"], json.dumps(totals, sort_keys=True))
    return paths


def run_year(spark: SparkSession, listing: str, year: int, caches: dict[str, str], folder: str, core: list[str], extensions: list[str], p: Profile = DEFAULT) -> dict[str, str]:
    """Read a year's listing and caches (verification and identity as CSV, archive, images and collector as JSON),
    merge them and write the outputs."""
    loaded = ingest.Caches(
        _csv_cache(spark, caches["verification"], ingest.VERIFICATION + ("project_title", "year")), readers.archive_index(spark, caches["archive"]), readers.image_manifest(spark, caches["images"]),
        readers.collector_exports(spark, caches["collector"]), _csv_cache(spark, caches["identity"], ingest.IDENTITY + ("project_title", "year")),
    )
    return write_ingest(ingest.ingest_rows(readers.listing_dir(spark, listing, year, p), loaded, p), folder, core, extensions, year)


def _csv_cache(spark: SparkSession, path: str, names: tuple[str, ...]) -> DataFrame:
    raw = readers.read_csv(spark, path)
    return raw.select(*[F.col(n) if n in raw.columns else F.lit(None).cast("string").alias(n) for n in names], "_ord")


# --- reports


def _counted(df: DataFrame) -> list[tuple[str, object]]:
    return [(" / ".join(map(str, r[:-1])), r[-1]) for r in df.collect()]  # one row for each kind


def write_contract_reports(judged: DataFrame, folder: str, p: Profile = DEFAULT) -> dict[str, str]:
    """Three reports of an export in markdown: import counts, validation messages, compatibility of the columns."""
    spark = judged.sparkSession
    counts = export.split_counts(judged).first().asDict()
    messages = judged.select(F.explode(F.concat("errors", "warnings")).alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "m").limit(50)  # the report's purpose
    parts = {
        "import_report.md": sinks.markdown_table(list(counts.items()), "Import") + sinks.markdown_table(_counted(export.by_kind_and_status(judged)), "Rows by kind and status"),
        "validation_report.md": sinks.markdown_table(_counted(messages), "Messages by frequency"),
        "compatibility_report.md": sinks.markdown_table([("contract version", p.contract_version), ("standard columns", ", ".join(COLUMNS)), ("extension columns", ", ".join(EXTENSIONS)), ("missing columns", ", ".join(c for c in (*COLUMNS, *EXTENSIONS) if c not in judged.columns) or "none")], "Compatibility"),
    }
    return {n: write_text(spark, f"{folder}/{n}", text) for n, text in parts.items()}


def write_verification(results: DataFrame, archive: DataFrame, folder: str) -> None:
    """The verification outputs and the archive index that they were made with, as one JSON document."""
    sinks.write_report(results, folder)
    records = archive.drop("_ord").agg(F.to_json(F.struct(F.collect_list(F.struct(*[c for c in archive.columns if c != "_ord"])).alias("records"))).alias("value"))  # an index of one archive
    records.write.mode("overwrite").text(f"{folder}/archive_index")


def write_enrichment(rows: DataFrame, changes: DataFrame, schema: Schema, folder: str, requested: int) -> dict[str, int]:
    """All rows with approved changes laid over, the changes for review, and a manifest of counts."""
    sinks.write_valid_csv(overlay_changes(rows, changes, "project_id", [n for n in schema.names if n in rows.columns]), schema, f"{folder}/enriched")
    sinks.write_csv(changes.orderBy("project_id", "field", "change_id"), f"{folder}/review")
    n = F.count_if
    counts = changes.agg(n(F.col("review_status").isin("approved", "edited")).alias("approved_changes"), n(F.col("review_status") == "rejected").alias("rejected_changes"), n(F.col("review_status") == "unresolved").alias("unresolved_changes"), F.count_distinct("project_id").alias("enriched_records"))
    manifest = {"requested": requested, "records": rows.count(), **counts.first().asDict()}
    write_text(rows.sparkSession, f"{folder}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


# --- published views and packages


def publish_view(spark: SparkSession, view_path: str, root: str, year: int) -> str:
    """Copy a prepared view to where viewers look for it."""
    target = f"{root}/{year}/view"
    spark.read.json(view_path).write.mode("overwrite").option("ignoreNullFields", False).json(target)
    return target


def resolve_view(spark: SparkSession, roots: list[str], year: int) -> str | None:
    """The first place, in order of preference, that has a view of the year."""
    for root in roots:
        fs, where = _path(spark, f"{root}/{year}/view/_SUCCESS")
        if fs.exists(where):
            return f"{root}/{year}/view"
    return None


def prepared_years(spark: SparkSession, roots: list[str]) -> list[int]:
    """Years with a published view, newest first."""
    years = set()
    for root in roots:
        fs, where = _path(spark, root)
        if fs.exists(where):
            years |= {int(x.getPath().getName()) for x in fs.listStatus(where) if x.isDirectory() and x.getPath().getName().isdigit()}
    return sorted((y for y in years if resolve_view(spark, roots, y)), reverse=True)


class NotReady(ValueError):
    """A package holds rows that are not fit to publish."""


def deploy(rows: DataFrame, folder: str, schema: Schema, year: int, force: bool = False) -> dict[str, object]:
    """A package of one year: the ready rows as CSV, what keeps the others back, and a manifest. Refused if rows of
    it break the schema, and if none is ready; with ``force`` it is written all the same."""
    spark, rows = rows.sparkSession, checkpointed(rows)
    kept = view.ready_only(rows)
    counts = view.kept_and_skipped(rows).first()
    failures = view.validation_report(_with_all(kept, schema.names).withColumn("row", F.monotonically_increasing_id()), schema, "row")
    n_failures = failures.count()  # a report of 25 rows at most
    if (n_failures or not counts.kept) and not force:
        raise NotReady(f"{counts.kept} rows ready, {n_failures} of the first break the schema")
    sinks.write_csv(_with_all(kept, schema.names), f"{folder}/upload")
    sinks.write_json(failures, f"{folder}/failures")
    manifest = {"year": year, "kept": counts.kept, "skipped": counts.skipped, "failures": n_failures, "forced": bool(force and (n_failures or not counts.kept))}
    write_text(spark, f"{folder}/manifest.json", json.dumps(manifest, sort_keys=True))
    return manifest


# --- discovery


def crawl_sitemaps(seeds: DataFrame, fetch: Callable[[DataFrame], DataFrame], most_sitemaps: int = 10, most_urls: int = 5000) -> DataFrame:
    """url, sitemap and level of the pages that sitemaps (url) name, indexes followed. ``fetch`` gives url and body of
    those it can get. The caps are the operator's purpose: sitemaps read and pages kept, first by level, then by URL."""
    spark = seeds.sparkSession
    seen = checkpointed(seeds.select("url").distinct().orderBy("url").limit(most_sitemaps))
    wave, left, level, pages = seen, most_sitemaps, 0, spark.createDataFrame([], "url string, sitemap string, level int")
    while left > 0 and not wave.isEmpty():  # at most one turn for each sitemap
        bodies = fetch(wave).select(F.col("url").alias("sitemap"), F.col("body").cast("string").alias("xml"))
        found = checkpointed(bodies.select("sitemap", F.explode(sitemap_urls(F.col("xml"))).alias("url"), F.col("xml").rlike("(?i)<sitemapindex").alias("index")))
        pages = pages.unionByName(found.where("not index").select("url", "sitemap", F.lit(level).alias("level")))
        left -= wave.count()
        wave = checkpointed(found.where("index").select("url").distinct().join(seen, "url", "left_anti").orderBy("url").limit(max(left, 0)))
        seen, level = checkpointed(seen.unionByName(wave)), level + 1
    first = pages.groupBy("url").agg(F.min(F.struct("level", "sitemap")).alias("f")).select("url", F.col("f.sitemap").alias("sitemap"), F.col("f.level").alias("level"))
    return first.orderBy("level", "url").limit(most_urls)


def discovery_report(routed: DataFrame, pages: DataFrame) -> str:
    """What discovery found, in markdown: links by reason, pages by sitemap."""
    by_reason = routed.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy("reason")
    by_sitemap = pages.groupBy("sitemap").agg(F.count(F.lit(1)).alias("n")).orderBy("sitemap")
    return sinks.markdown_table(_counted(by_reason), "Links by reason") + sinks.markdown_table(_counted(by_sitemap), "Pages by sitemap")
