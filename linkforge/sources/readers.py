"""Readers: listing CSVs, keyed caches in CSV and JSON, batches, state tables, configuration.

Every reader gives the source order as ``_ord``; winners are decided by it later, never by scan order."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from linkforge.functions.text import blank, normalize_title, strip
from linkforge.operators.ordering import first_wins, row_numbers, strict_majority
from linkforge.profile import DEFAULT, Profile

CSV = {"header": True, "multiLine": True, "escape": '"', "encoding": "UTF-8", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
# The listing's columns and titles that are no projects.
REQUIRED, OPTIONAL, NO_TITLES = ("Title", "Description"), ("Extra", "Link", "UID", "Camp", "Where", "Type"), ("title", "camp", "xxxx")


class ListingError(ValueError):
    """A listing file is not what it should be."""


def read_csv(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows as strings with ``_ord``: file, then place in the file."""
    df = spark.read.options(**CSV).csv(list(paths))
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row")).alias("_ord"))


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def check_header(names: list[str]) -> None:
    """A listing has Title and Description, in any case and place, and is no export of ours."""
    low = {n.strip().lower() for n in names}
    if low & {"project_title", "event_uid"}:
        raise ListingError("this looks like an export, not a listing")
    if missing := [n for n in REQUIRED if n.lower() not in low]:
        raise ListingError(f"missing column(s) {missing}")


def listing(df: DataFrame, year: Column) -> DataFrame:
    """Listing rows (title, description, artist_url, legacy_link, uid, camp, address, kind, year, normalized_title,
    _ord) from a raw CSV frame; headers match in any case. Rows without a real title go; '-' is NULL."""
    check_header([c for c in df.columns if c != "_ord"])
    names = {c.strip().lower(): c for c in df.columns}

    def get(name: str) -> Column:
        found = names.get(name.lower())
        cell = F.nullif(strip(F.col(f"`{found}`")), F.lit("")) if found else F.lit(None).cast("string")
        return F.nullif(cell, F.lit("-"))

    title = strip(F.col(f"`{names['title']}`"))
    out = df.select(
        year.cast("int").alias("year"), title.alias("title"), get("Description").alias("description"), get("Extra").alias("artist_url"), get("Link").alias("legacy_link"),
        get("UID").alias("uid"), get("Camp").alias("camp"), get("Where").alias("address"), get("Type").alias("kind"), "_ord",
    )
    out = out.where((F.coalesce(F.col("title"), F.lit("")) != "") & ~F.lower("title").isin(*NO_TITLES))
    return out.withColumn("normalized_title", normalize_title(F.col("title")))


def listing_dir(spark: SparkSession, path: str, year: int | None = None, p: Profile = DEFAULT, glob: str = "*.csv") -> DataFrame:
    """All listing files of a folder, the year taken from the file name. A year reads only the files of that
    year: names are pruned before any is opened. Repeated records (identifier, else title) count once."""
    pattern = glob if year is None else re.sub(r"\*", f"*{year}*", glob, count=1)
    raw = spark.read.options(**CSV, pathGlobFilter=pattern).csv(path)
    raw = raw.select("*", F.struct(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("row")).alias("_ord"))
    named = F.regexp_extract(F.col("_ord.file"), p.listing_file_pattern, 1)
    rows = listing(raw.where(named != ""), F.regexp_extract(F.col("_ord.file"), p.listing_file_pattern, 1))
    rows = rows if year is None else rows.where(F.col("year") == year)
    return dedupe_listing(rows)


def dedupe_listing(rows: DataFrame) -> DataFrame:
    """First row per identifier or, without one, per title; both share one namespace."""
    return first_wins(rows, [F.coalesce(blank(F.col("uid")), F.col("normalized_title"))], F.col("_ord"))


def link_year(rows: DataFrame, p: Profile = DEFAULT, sample: int = 200) -> DataFrame:
    """One row: the year that more than half of the first ``sample`` matching links name."""
    year = F.nullif(F.regexp_extract(F.coalesce("legacy_link", F.lit("")), p.link_year_pattern, 1), F.lit(""))
    first = rows.select(year.alias("y"), "_ord").where("y is not null").orderBy("_ord").limit(sample)
    return strict_majority(first, [], F.col("y"))


def resolve_year(file_name: str, voted: str | None, p: Profile = DEFAULT) -> int:
    """The year of file name and links; they must not contradict each other."""
    named = re.search(p.listing_file_pattern, file_name)
    if named and voted and named[1] != voted:
        raise ListingError(f"file name says {named[1]}, links say {voted}")
    year = voted or (named and named[1])
    if not year:
        raise ListingError("no year in file name or links")
    return int(year)


ARCHIVE = "year string, title string, normalized_title string, artist_display_text string, artist_location string, description string, website_url string, canonical_source_url string, uid string, image_urls array<string>, image_alt_text string"
IMAGE = "image_url string, final_url string, http_status int, content_type string, content_length bigint, link_active boolean, alt_text string, photographer_credit string, credit_text string, source_page_url string, source_type string, attribution_confidence string, review_required boolean, validation_error string"
MANIFEST = f"project_title string, archive_uid string, archive_url string, images array<struct<{','.join(x.strip().replace(' ', ':', 1) for x in IMAGE.split(','))}>>"


def _exploded(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.posexplode(column).alias("_ord", "r")).select("r.*", "_ord")


def archive_index(spark: SparkSession, path: str) -> DataFrame:
    inner = ",".join(x.strip().replace(" ", ":", 1) for x in ARCHIVE.split(","))
    return _exploded(read_json(spark, path, f"records array<struct<{inner}>>"), "records")


def image_manifest(spark: SparkSession, path: str) -> DataFrame:
    inner = ",".join(x.strip().replace(" ", ":", 1) for x in re.split(r",\s(?=\w+ )", MANIFEST))
    return _exploded(read_json(spark, path, f"images array<struct<{inner}>>"), "images")


def collector_exports(spark: SparkSession, path: str) -> DataFrame:
    """Exported records (an array, or an object that holds one as records or items): two maps of values, and title,
    identifier and year coalesced from both."""
    maps = "mapped_values map<string,string>, original_scraped_values map<string,string>, source_position int, record_status string"
    inner = ",".join(x.strip().replace(" ", ":", 1) for x in re.split(r",\s(?=\w+ )", maps))
    raw = read_json(spark, path, f"{maps}, records array<struct<{inner}>>, items array<struct<{inner}>>")
    own = F.struct(*[c.split()[0] for c in re.split(r",\s(?=\w+ )", maps)])
    df = raw.select(F.explode(F.coalesce("records", "items", F.array(own))).alias("r")).select("r.*").withColumnsRenamed({"mapped_values": "mapped", "original_scraped_values": "original"})
    both = lambda a, b: F.coalesce(blank(F.col("mapped")[a]), blank(F.col("original")[b]))
    return df.select("*", both("project_title", "title").alias("title"), both("event_uid", "uid").alias("uid"), both("project_year", "year").alias("year"), F.monotonically_increasing_id().alias("_ord"))


def export_records(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records; anything else is an error."""
    df = read_json(spark, path)
    if "_corrupt_record" in df.columns:
        raise ValueError(f"{path} is no JSON array of records")
    return df.select("*", F.monotonically_increasing_id().alias("_ord"))


def split_list(c: Column, sep: str = r" \| ") -> Column:
    """A joined cell as an array again."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), sep), "")


def website_by_uid(rows: DataFrame, uid: str = "uid", website: str = "website_url") -> DataFrame:
    """Last website per identifier."""
    return rows.where(f"coalesce({uid}, '') != '' and coalesce({website}, '') != ''").groupBy(uid).agg(F.max_by(website, "_ord").alias(website))


def batch_catalog(spark: SparkSession, root: str) -> DataFrame:
    """Batches found below a folder by their manifests: year, name, path, record count (manifest, else its range)."""
    df = spark.read.option("multiLine", True).schema("year string, record_count bigint, exported_count bigint, first_position bigint, last_position bigint").option("recursiveFileLookup", True).option("pathGlobFilter", "manifest.json").json(root)
    folder = F.regexp_replace("_metadata.file_path", "/[^/]*$", "")
    count = F.coalesce("record_count", "exported_count", F.col("last_position") - F.col("first_position") + 1, F.lit(0))
    return df.select("year", F.regexp_extract(folder, "([^/]*)$", 1).alias("name"), folder.alias("path"), count.alias("records")).orderBy("year", "name", "path")


def batch_records(rows: DataFrame, keep_blank_status: bool) -> DataFrame:
    """Completed records with coalesced id, title and contributor and a dense ``batch_index``. Fallback ids count
    rows before the filter."""
    status = blank(F.col("record_status"))
    keep = (status == "completed") | (status.isNull() if keep_blank_status else F.lit(False))
    numbered = row_numbers(row_numbers(rows, F.col("_ord"), "_n").where(keep), F.col("_n"), "batch_index")
    ident = F.coalesce(blank(F.col("record_id")), blank(F.col("source_url")), F.concat(F.lit("record-"), F.col("_n").cast("string")))
    return numbered.select("*", ident.alias("project_id")).drop("_n")


def first_nonempty(*found: Callable[[], DataFrame | None]) -> DataFrame | None:
    """The first table with a row; readers are asked in order, and one whose file is missing gives none."""
    for read in found:
        try:
            df = read()
            if df is not None and not df.isEmpty():
                return df
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return None


def load_batch(spark: SparkSession, json_path: str, state: DataFrame | None, csv_path: str) -> DataFrame | None:
    """The records of a batch: its JSON export (completed or without status), else the state table's completed rows,
    else its CSV."""
    text = lambda df: df.select(*[F.col(c) if c == "_ord" else F.col(c).cast("string").alias(c) for c in df.columns])

    def exported() -> DataFrame:
        df = collector_exports(spark, json_path)
        o = F.col("original")
        return batch_records(df.select("record_status", o["record_id"].alias("record_id"), o["canonical_source_url"].alias("source_url"), "title", F.col("mapped")["contributor_name"].alias("contributor"), "_ord"), True)

    def from_csv() -> DataFrame:
        df = read_csv(spark, csv_path)
        get = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
        return batch_records(text(df.select(F.lit("completed").alias("record_status"), get("record_id").alias("record_id"), get("proof_external_url").alias("source_url"), get("project_title").alias("title"), get("contributor_name").alias("contributor"), "_ord")), False)

    return first_nonempty(exported, lambda: None if state is None else batch_records(state, False), from_csv)


def load_config(path: str, defaults: dict) -> dict:
    """A JSON configuration over defaults; unknown keys are errors."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    if extra := set(data) - set(defaults):
        raise ValueError(f"unknown settings {sorted(extra)}")
    return defaults | data


def state_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet state table; a missing one is empty. Missing columns are added as NULL. A version that a swap has
    set aside stands in for the one that did not get to its place."""
    wanted = T._parse_datatype_string(schema)
    for where in (path, f"{path}.old"):
        try:
            df = spark.read.option("mergeSchema", True).parquet(where)
            break
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
    else:
        return spark.createDataFrame([], wanted)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted.fields])


def disk_footprint(spark: SparkSession, root: str) -> DataFrame:
    """directory and mb (two decimals) of the folders in ``root``, with their subfolders, and a row total_mb, the sum
    of the others; no row if ``root`` is missing. Listed by the driver from the store's metadata."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows = []
    if store.exists(where):
        folders = [x.getPath() for x in store.listStatus(where) if x.isDirectory()]
        rows = sorted((x.getName(), round(store.getContentSummary(x).getLength() / 1_000_000, 2)) for x in folders)
        rows.append(("total_mb", round(sum(mb for _, mb in rows), 2)))
    return spark.createDataFrame(rows, "directory string, mb double")
