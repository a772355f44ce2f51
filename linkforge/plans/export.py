"""Batches and contract exports: map, validate, split, write, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from linkforge.operators.contract import COLUMNS, EXTENSIONS, to_contract, validate_contract
from linkforge.operators.keyed import attempt_window, overlay_changes
from linkforge.operators.ordering import first_wins
from linkforge.operators.schema import Mapping, Schema, project, validate
from linkforge.profile import DEFAULT, Profile
from linkforge.runtime import checkpointed
from linkforge.sources.sinks import write_csv, write_json


def accept_reject(rows: DataFrame, order: Column, p: Profile = DEFAULT) -> DataFrame:
    """Contract rows with errors, warnings, accepted and the row number of a CSV file, header included (first row 2).

    Numbers are exact ranks over the whole file: a range partitioning by the order, and offsets per partition."""
    keyed = rows.withColumn("_order", order)
    # checkpointed, as both the counts and the rows must see the same partitions
    ranged = checkpointed(keyed.repartitionByRange("_order").sortWithinPartitions("_order").withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = ranged.select(part.alias("_part")).groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))  # a row for each partition
    mapped = validate_contract(to_contract(ranged, p, keep=["_id"]), p).withColumn("_part", part)
    numbered = mapped.join(F.broadcast(starts), "_part").withColumn("row_number", F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1) + 2)
    return numbered.drop("_id", "_part", "_start").withColumn("accepted", F.size("errors") == 0)


def split_counts(judged: DataFrame) -> DataFrame:
    n = F.count_if
    return judged.agg(
        F.count(F.lit(1)).alias("rows"), n("accepted").alias("accepted"), n(~F.col("accepted")).alias("rejected"), n(F.size("warnings") > 0).alias("with_warnings"),
        n(F.col("review_status") == "Needs review").alias("needs_review"), n(F.col("proof_external_url") == "").alias("missing_proof"), n(F.col("image_urls") == "").alias("missing_image"),
    )


def by_kind_and_status(judged: DataFrame) -> DataFrame:
    return judged.groupBy("contributor_kind", "review_status").agg(F.count(F.lit(1)).alias("n")).orderBy("contributor_kind", "review_status")


def export_contract(rows: DataFrame, order: Column, folder: str, p: Profile = DEFAULT) -> None:
    """Accepted and rejected CSVs, rejection reasons and counts."""
    judged = accept_reject(rows, order, p).cache()
    names = [*COLUMNS, *EXTENSIONS]
    write_csv(judged.where("accepted"), f"{folder}/accepted", names)
    write_csv(judged.where("not accepted").select("row_number", *names, "errors"), f"{folder}/rejected", sep=" | ")
    write_json(split_counts(judged), f"{folder}/summary")
    judged.unpersist()


def scrape_batch(candidates: DataFrame, requested: int, order: str = "position", group: list[str] = ["source_id"]) -> DataFrame:  # noqa: B006
    """Which candidates a batch attempts, and what becomes of each.

    ``candidates`` has status (of earlier runs), valid (the page parsed to a valid record) and canonical_url. Completed
    rows are skipped for free; a valid row that repeats an earlier valid one's canonical URL is a skipped attempt."""
    first = first_wins(candidates.where("valid and coalesce(status, '') != 'completed'"), [*[F.col(g) for g in group], F.col("canonical_url")], F.col(order)).select(*group, order, F.lit(True).alias("_first"))
    df = candidates.join(first, [*group, order], "left")
    done = F.coalesce(F.col("status") == "completed", F.lit(False))
    df = df.withColumn("attempted", ~done).withColumn("succeeded", ~done & F.coalesce("_first", F.lit(False)))
    seen = attempt_window(df, group, F.col(order), F.lit(requested))
    outcome = F.when(done | (F.col("valid") & ~F.col("succeeded")), "skipped").when(F.col("succeeded"), "completed").otherwise("failed")
    return seen.withColumn("outcome", outcome).drop("_first")


def batch_counts(seen: DataFrame, requested: int) -> DataFrame:
    """Counts, positions (0 counts as none) and status of a batch."""
    n, pos = F.count_if, F.nullif(F.col("position"), F.lit(0))
    out = seen.agg(
        n("attempted").alias("attempted"), n(F.col("outcome") == "completed").alias("succeeded"), n(F.col("outcome") == "failed").alias("failed"), n(F.col("outcome") == "skipped").alias("skipped"),
        F.min(pos).alias("first_position"), F.max(pos).alias("last_position"),
    )
    return out.withColumn("status", F.when(F.col("succeeded") >= requested, "completed").otherwise("partial"))


def first_valid_preview(candidates: DataFrame, most: int = 5) -> DataFrame:
    """The first valid one of the first few candidates without a preview."""
    return candidates.where("not previewed").orderBy("position").limit(most).where("valid").orderBy("position").limit(1)


def preview(records: DataFrame, schema: Schema, mappings: list[Mapping]) -> DataFrame:
    """A record's mapped row as (field, value, errors), all fields of it."""
    row = validate(project(records.limit(1), schema, mappings), schema)
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(n).alias("value")) for n in schema.names]))
    out = row.select("errors", cells.alias("c")).select("c.*", F.transform(F.filter("errors", lambda e: e["field"] == F.col("c.field")), lambda e: e["message"]).alias("errors"))
    return out


def enriched_rows(rows: DataFrame, changes: DataFrame, schema: Schema) -> DataFrame:
    return overlay_changes(rows, changes, "project_id", schema.names)
