"""The query surface over prepared rows: named filters, search, sorts, export by keys, cap-reported validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from linkforge.functions.text import normalize_title, slugify, text_of
from linkforge.operators.rules.decide import split_flags, upload_ready
from linkforge.operators.schema import Schema, first_failures, validate

SEARCHED = ("title", "uid", "slug", "people.contributor_display_name", "people.source_artist_credit", "place.theme_camp")


def filters() -> dict[str, Column]:
    has = lambda f: F.array_contains("review_flags", f)
    return {
        "all": F.lit(True), "ready": F.col("upload_ready"), "attention": F.col("needs_attention"), "missing_hero": F.col("hero.url") == "", "hero_review": has("hero_needs_review"),
        "missing_proof": F.col("proof_url") == "", "duplicates": has("duplicate_candidate"), "uncertain_names": has("alias_uncertain") | has("name_split_uncertain"), "unknown_kind": has("contributor_kind_uncertain"),
    }


def sorts() -> dict[str, list[Column]]:
    return {"priority": [F.desc("review_priority"), F.asc("title"), F.asc("uid")], "title": [F.asc("title"), F.asc("uid")], "contributor": [F.asc("people.contributor_display_name"), F.asc("title"), F.asc("uid")]}


def search(view: DataFrame, name: str = "all", query: str = "", sort: str = "priority") -> DataFrame:
    """Rows of a named filter that contain the query in any of the searched fields, in lower case, sorted."""
    hay = F.lower(F.concat_ws(" ", *[text_of(F.col(c)) for c in SEARCHED]))
    rows = view.where(filters()[name])
    return (rows.where(F.contains(hay, F.lit(query.strip().lower()))) if query.strip() else rows).orderBy(*sorts()[sort])


def export_by_keys(rows: DataFrame, keys: DataFrame, uid: str = "event_uid", slug: str = "project_slug", title: str = "project_title") -> DataFrame:
    """Rows of which the identifier, slug or title is among the keys (column key)."""
    own = [F.trim(c) for c in (uid, slug, title)]
    wanted = keys.select("key").where("key != ''").distinct()
    marked = rows
    for i, c in enumerate(own):  # one left join for each key column; the wanted side is distinct, so rows neither multiply nor go
        marked = marked.join(wanted.select(F.col("key").alias(f"_k{i}")), c == F.col(f"_k{i}"), "left")
    return marked.where("coalesce(_k0, _k1, _k2) is not null").drop("_k0", "_k1", "_k2")


def file_label(label: str) -> str:
    """A file name's part from a filter label."""
    return "-".join("".join(c if c.isascii() and c.isalnum() else " " for c in label.lower()).split()) or "all"


def ready_only(rows: DataFrame) -> DataFrame:
    """Rows fit to publish; without a flags column only the required fields count."""
    flags = split_flags(F.col("review_flags")) if "review_flags" in rows.columns else F.array().cast("array<string>")
    return rows.where(upload_ready(F.col("project_title"), F.col("project_slug"), F.col("proof_external_url"), flags))


def kept_and_skipped(rows: DataFrame) -> DataFrame:
    flags = split_flags(F.col("review_flags")) if "review_flags" in rows.columns else F.array().cast("array<string>")
    ready = upload_ready(F.col("project_title"), F.col("project_slug"), F.col("proof_external_url"), flags)
    return rows.agg(F.count_if(ready).alias("kept"), F.count_if(~ready).alias("skipped"))


def validation_report(rows: DataFrame, schema: Schema, row: str, most: int = 25) -> DataFrame:
    """The first failing rows, each with its messages."""
    return first_failures(validate(rows, schema), row, most).select(row, "errors")


def facets(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def keys_of(rows: DataFrame) -> Column:
    return F.array_distinct(F.array(F.trim("event_uid"), slugify(F.col("project_title")), normalize_title(F.col("project_title"))))
